"""Removal of repeated byte strings by prefix-free parsing.

Every window of ``length`` bytes has a trigger: the place where the rolling hash over ``gram`` bytes is smallest within
it.  Neighbouring windows with one trigger form a phrase, so phrases overlap by length - 1 bytes, every window lies
within exactly one phrase, and a phrase depends on nothing but its own bytes.  The corpus is a dictionary of distinct
phrases and a parse that says where each occurs.

* A phrase that occurs more than once in the parse repeats with all its windows.
* Windows of different phrases can be equal only if their triggers are.  The phrases of a trigger that has several
  meet in one shard, where the suffix array of this part of the dictionary is built by prefix doubling, up to
  ``length`` bytes; suffixes that stand together with a common prefix that long repeat.

Parse counts and dictionary order together tell for each window of the corpus whether its bytes start anywhere else.
The parse needs no suffix array of its own, as phrases overlap by a whole window less one byte.

Nulls and edge cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows repeat each
other; a null ``doc_id`` is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from footmark.llm.blocks import Block, pack, per_document, unpack

#: Windows that are parsed at once; a bound for memory.
CHUNK = 1 << 20
MULTIPLIER = 0xD1342543DE82EF95
SPREAD = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = powers(MULTIPLIER, CHUNK + 4096)
INVERSE = powers(pow(MULTIPLIER, -1, 1 << 64), CHUNK + 4096)


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each gram, from sums of byte values times powers."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SPREAD[data] * POWERS[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * INVERSE[:len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def phrases(text: bytes, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(trigger, first window, number of windows) of each phrase."""
    out = []
    for at in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)
        h = rolling(data, gram)
        place = sliding_minimum((h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        place = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        windows = np.diff(np.r_[start, len(place)])
        out += zip(h[place[start]].tolist(), (start + at).tolist(), windows.tolist())
    return out


def repeated_windows(dictionary: list[bytes], length: int) -> list[np.ndarray]:
    """For each phrase, which of its windows occur at another place of the dictionary.

    Ranks of 8 bytes come from the bytes themselves; each round of prefix doubling sorts pairs of ranks.  Every phrase
    is followed by zeros that no window reaches.
    """
    gap = 2 * length
    sizes = np.array([len(p) for p in dictionary], np.int64)
    at = np.cumsum(np.r_[0, sizes + gap])[:-1]
    text = np.zeros(int((sizes + gap).sum()) + gap, np.uint8)
    for p, a in zip(dictionary, at):
        text[a:a + len(p)] = np.frombuffer(p, np.uint8)
    used = np.concatenate([np.arange(a, a + n) for a, n in zip(at, sizes)])
    place = np.full(len(text), 0, np.int64)  # rank 0: behind a phrase
    first = np.zeros(len(used), np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | text[used + i].astype(np.uint64)
    place[used] = ranks(first)
    reach = 8
    while 2 * reach <= length:
        place[used] = ranks(place[used].astype(np.uint64) << np.uint64(32) | place[used + reach].astype(np.uint64))
        reach *= 2
    starts = np.concatenate([np.arange(a, a + n - length + 1) for a, n in zip(at, sizes)])
    last = place[starts].astype(np.uint64) << np.uint64(32) | place[starts + length - reach].astype(np.uint64)
    order = np.argsort(last)  # the suffix array, windows only
    same = last[order][1:] == last[order][:-1]
    repeated = np.zeros(len(starts), bool)
    repeated[order] = np.r_[False, same] | np.r_[same, False]
    return np.split(repeated, np.cumsum(sizes - length + 1)[:-1])


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
    return out


def runs(flags: np.ndarray) -> np.ndarray:
    """Pairs [from, to) of the runs of true values."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).reshape(-1, 2)


class RepeatedBytes:
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def __init__(self, length: int = 400, gram: int = 128, keep_text: bool = False):
        self.length, self.gram, self.keep_text = length, gram, keep_text

    def parse(self, block: Block):
        """Distinct phrases (trigger, hash) in order, and all occurrences (document, first window, windows, phrase)."""
        triggers, hashes, rows = [], [], []
        for d, text in enumerate(block.texts):
            for trigger, start, windows in phrases(text, self.length, self.gram):
                triggers.append(trigger)
                hashes.append(xxhash.xxh3_64_intdigest(text[start:start + windows + self.length - 1]))
                rows.append((d, start, windows))
        keys = np.array([triggers, hashes], np.uint64).T.reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys = keys[order]
        new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)] if len(keys) else np.zeros(0, bool)
        occurrences = np.array(rows, np.int64).reshape(-1, 3)[order]
        return keys[new], occurrences, np.cumsum(new) - 1

    def by_bucket(self, keys: np.ndarray, buckets: int):
        """(bucket, the numbers of its keys)."""
        bucket = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
        return [(int(bucket[part[0]]), part) for part in np.split(order, edge[1:])] if len(order) else []

    def ask(self, block, buckets):
        keys, _, phrase = self.parse(block)
        several = np.bincount(phrase, minlength=len(keys)) > 1
        return {b: pack(keys[own], several[own]) for b, own in self.by_bucket(keys, buckets)}

    def answer(self, payloads):
        """For each key: 1 if the phrase occurs again, 2 if this block shall send it, as the first of those that have it."""
        parts = [unpack(p, 2) for p in payloads]
        keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k, _ in parts]
        several = np.concatenate([np.frombuffer(s, bool) for _, s in parts])
        every = np.concatenate(keys)
        order = np.lexsort((every[:, 1], every[:, 0]))  # stable: blocks stay in order
        ordered = every[order]
        new = np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)]
        phrase = np.cumsum(new) - 1
        again = (np.bincount(phrase) > 1) | (np.bincount(phrase, several[order]) > 0)
        trigger = ordered[new][:, 0]
        number = np.cumsum(np.r_[True, trigger[1:] != trigger[:-1]]) - 1
        varied = (np.bincount(number) > 1)[number]
        found = np.empty(len(every), np.uint8)
        found[order] = again[phrase] + 2 * (varied[phrase] & new)
        return [x.tobytes() for x in np.split(found, np.cumsum([len(k) for k in keys])[:-1])]

    def send(self, block, answers, buckets):
        keys, occurrences, phrase = self.parse(block)
        said = np.zeros(len(keys), np.uint8)
        shards = self.by_bucket(keys, buckets)
        for b, own in shards:
            said[own] = np.frombuffer(answers[b], np.uint8)
        first = np.searchsorted(phrase, np.arange(len(keys)))
        out, asked = {}, []
        for b, own in shards:
            chosen = own[said[own] > 1]
            if len(chosen):
                texts = []
                for d, start, windows in occurrences[first[chosen]].tolist():
                    texts.append(block.texts[d][start:start + windows + self.length - 1])
                out[b] = pack(np.array([len(t) for t in texts], np.int32), b"".join(texts))
                single = said[chosen] == 2  # the others repeat as a whole
                asked.append(np.c_[np.full(single.sum(), b), np.flatnonzero(single), occurrences[first[chosen[single]]]])
        whole = occurrences[(said[phrase] & 1) > 0] if len(phrase) else occurrences
        return out, pack(whole, np.concatenate(asked) if asked else np.zeros((0, 5), np.int64))

    def match(self, payloads):
        """Bits of the repeated windows, phrase by phrase, for each payload."""
        texts, owner = [], []
        for i, p in enumerate(payloads):
            sizes, data = unpack(p, 2)
            at = 0
            for n in np.frombuffer(sizes, np.int32).tolist():
                texts.append(bytes(data[at:at + n]))
                at += n
                owner.append(i)
        found: dict[int, list] = defaultdict(list)
        if texts:
            for i, bits in zip(owner, repeated_windows(texts, self.length)):
                found[i].append(bits)
        return [pack(np.array([len(b) for b in found[i]], np.int32), np.packbits(np.concatenate(found[i]))) for i in range(len(payloads))]

    def finish(self, block, own, replies):
        whole, asked = (np.frombuffer(x, np.int64) for x in unpack(own, 2))
        spans = defaultdict(list)
        for d, start, windows in whole.reshape(-1, 3).tolist():
            spans[d].append((start, start + windows - 1 + self.length))
        bits = {}
        for shard, reply in replies.items():
            sizes, packed = unpack(reply, 2)
            sizes = np.frombuffer(sizes, np.int32)
            bits[shard] = np.split(np.unpackbits(np.frombuffer(packed, np.uint8), count=int(sizes.sum())), np.cumsum(sizes)[:-1])
        for shard, number, d, start, _ in asked.reshape(-1, 5).tolist():
            for a, b in runs(bits[shard][number].astype(bool)).tolist():
                spans[d].append((start + a, start + b - 1 + self.length))
        out = defaultdict(list)
        for d, text in enumerate(block.texts):
            removed = np.zeros(len(text) + 1, np.int32)
            for a, b in spans[d]:
                removed[a] += 1
                removed[b] -= 1
            gone = np.cumsum(removed[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans[d] else text
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(runs(gone)))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if self.keep_text else None)
        return out


def remove_repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 128, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the kept bytes."""
    found = per_document(docs, RepeatedBytes(length, gram, keep_text))
    return found if keep_text else found.drop("kept")
