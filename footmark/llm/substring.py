"""Removal of repeated phrases with sharded Aho-Corasick automata.

A window is ``n`` consecutive words.  Its anchor is the ``gram``-word phrase in it whose hash is smallest; neighbouring
windows with one anchor form a passage.  Equal windows have equal anchors, so what repeats can be found by anchor:

1. blocks of documents ask which of their anchors occur in other blocks too;
2. passages with such an anchor go, each distinct one once per block, to the shard of the anchor, which confirms the
   windows that occur in more than one document and compiles the runs of confirmed windows into one automaton over
   words (pyahocorasick, integer sequences);
3. the passages of all documents are streamed through the automaton of their shard, which locates every occurrence
   and tells the smallest document id that holds each window;
4. a document loses the words of every window that also starts in a document with a smaller id.

Words are runs of characters other than space and the control characters tab to carriage return, unchanged.

Nulls and edge cases: a null text has no words; texts of fewer than ``n`` words lose nothing; a null ``doc_id`` is
larger than every id; documents with one id do not take words from each other; repeated rows are kept; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.blocks import NO_ID, Block, pack, per_document, unpack
from footmark.llm.suffix import sliding_minimum

FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hashed_runs(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += values[j:j + m] * FACTORS[j]
    return mixed(h)


class WordHashes(dict):
    """Hashes of words; frequent ones are computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: Of this process: blocks of one worker share words.
WORDS = WordHashes()


class Passages:
    """The passages of a block: start (in the words of the block), number of windows, anchor."""

    def __init__(self, block: Block, n: int, gram: int):
        own = [t.split() for t in block.texts]
        self.words = [w for x in own for w in x]
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.hashes = np.fromiter(map(WORDS.__getitem__, self.words), np.uint64, len(self.words))
        self.begins = np.cumsum(np.r_[0, self.sizes])[:-1]
        # Windows that end within their document.
        room = np.zeros(len(self.words) + 1, np.int32)
        long = self.sizes >= n
        np.add.at(room, self.begins[long], 1)
        np.add.at(room, (self.begins + self.sizes)[long] - n + 1, -1)
        windows = np.flatnonzero(np.cumsum(room[:-1]) > 0)
        if not len(windows):
            self.start = self.windows = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = hashed_runs(self.hashes, gram)
        place = sliding_minimum((grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), n - gram + 1)[windows]
        new = np.r_[True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]
        first = np.flatnonzero(new)
        self.start, self.windows = windows[first], np.diff(np.r_[first, len(windows)])
        self.anchor = grams[(place[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        self.doc = np.searchsorted(self.begins + self.sizes, self.start, side="right")


def by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, the numbers of its keys)."""
    if not len(keys):
        return []
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, edge)]


class Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class RepeatedPhrases:
    schema = "n_words long, n_removed long, kept_sha256 string, kept string"

    def __init__(self, n: int = 13, gram: int = 5, keep_text: bool = False):
        self.n, self.gram, self.keep_text = n, gram, keep_text

    def ask(self, block, buckets):
        anchors = np.unique(Passages(block, self.n, self.gram).anchor)
        return {b: anchors[own].tobytes() for b, own in by_bucket(anchors, buckets)}

    def answer(self, payloads):
        """A bit for each anchor: whether another block has it."""
        keys = [np.frombuffer(p, np.uint64) for p in payloads]
        _, number, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        return [np.packbits(x).tobytes() for x in np.split(count[number] > 1, np.cumsum([len(k) for k in keys])[:-1])]

    def send(self, block, answers, buckets):
        found = Passages(block, self.n, self.gram)
        anchors, number = np.unique(found.anchor, return_inverse=True)
        ids = np.array(block.ids, np.int64)[found.doc]
        low, high = np.full(len(anchors), NO_ID), np.full(len(anchors), -NO_ID)
        np.minimum.at(low, number, ids)
        np.maximum.at(high, number, ids)
        again = low < high
        for b, own in by_bucket(anchors, buckets):
            again[own] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(own)).astype(bool)
        rows = np.flatnonzero(again[number])
        if not len(rows):
            return {}, pack(np.zeros((0, 5), np.int64))
        # Distinct passages: the first and the last window cover all words of one.
        windows = hashed_runs(found.hashes, self.n)
        start, size, anchor = found.start[rows], found.windows[rows], found.anchor[rows]
        keys = (size, windows[start + size - 1], windows[start], anchor)
        order = np.lexsort(keys)
        new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
        passage = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        low, high = np.minimum.reduceat(ids[rows][order], head), np.maximum.reduceat(ids[rows][order], head)
        out, shard_of, offset_of = {}, np.empty(len(head), np.int64), np.empty(len(head), np.int64)
        chosen = order[head]
        for b, own in by_bucket(anchor[chosen], buckets):
            part = chosen[own]
            texts = [b" ".join(found.words[a:a + k + self.n - 1]) for a, k in zip(start[part].tolist(), size[part].tolist())]
            out[b] = pack(size[part].astype(np.int32), low[own], high[own], b"\n".join(texts))
            shard_of[own], offset_of[own] = b, np.cumsum(np.r_[0, size[part]])[:-1]
        at = rows[order]
        return out, pack(np.c_[shard_of[passage], offset_of[passage], found.doc[at], start[order], size[order]])

    def match(self, payloads):
        """The smallest document id of each window of each passage; NO_ID where only one document has it."""
        import ahocorasick
        if not payloads:
            return []
        parts = [unpack(p, 4) for p in payloads]
        sizes, low, high = (np.concatenate([np.frombuffer(p[i], t) for p in parts]).astype(np.int64)
                            for i, t in enumerate((np.int32, np.int64, np.int64)))
        # Passages that several blocks sent are streamed once.
        distinct = Numbers()
        which = np.fromiter((distinct[t] for p in parts for t in bytes(p[3]).split(b"\n")), np.int64, len(sizes))
        size = np.empty(len(distinct), np.int64)
        size[which] = sizes
        least, most = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID)
        np.minimum.at(least, which, low)
        np.maximum.at(most, which, high)
        found, edge = self.locate(ahocorasick, list(distinct), size, least, most)
        begin = np.cumsum(np.r_[0, sizes])
        step = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
        reply = found[np.repeat(edge[:-1][which], sizes) + step]
        return [x.tobytes() for x in np.split(reply, np.cumsum([int(np.frombuffer(p[0], np.int32).sum()) for p in parts])[:-1])]

    def locate(self, ahocorasick, passages: list[bytes], size: np.ndarray, low: np.ndarray, high: np.ndarray):
        """For each window of each passage the smallest id that holds it, or NO_ID; and where passages begin."""
        numbers = Numbers({b"": 0})  # an empty word stands between passages
        words = b"  ".join(passages).split(b" ")
        flat = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
        begins = np.cumsum(np.r_[0, size + self.n])[:-1]
        edge = np.cumsum(np.r_[0, size])
        windows = np.arange(edge[-1]) + np.repeat(begins - edge[:-1], size)
        h = hashed_runs(mixed(flat * np.uint64(0xD1342543DE82EF95)), self.n)[windows]
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        head, group = np.flatnonzero(new), np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.minimum.reduceat(np.repeat(low, size)[order], head)[group]
        last = np.maximum.reduceat(np.repeat(high, size)[order], head)[group]
        confirmed = first < last
        # Runs of confirmed windows are the phrases of the automaton.
        cut = np.zeros(len(h) + 1, bool)
        cut[edge] = True
        opens = np.flatnonzero(confirmed & (cut[:-1] | ~np.r_[False, confirmed[:-1]]))
        closes = np.flatnonzero(confirmed & (cut[1:] | ~np.r_[confirmed[1:], False])) + 1
        found = np.full(len(h), NO_ID, np.int64)
        if len(opens):
            text = flat.tolist()
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for i, (at, k) in enumerate(zip(windows[opens].tolist(), (closes - opens).tolist())):
                automaton.add_word(tuple(text[at:at + k + self.n - 1]), i)
            automaton.make_automaton()
            ending = np.zeros(len(flat), np.int64)  # the window after that which ends at a word
            ending[windows + self.n - 1] = np.arange(1, len(h) + 1)
            ending, source, length = ending.tolist(), opens.tolist(), (closes - opens).tolist()
            for end, i in automaton.iter(tuple(text)):
                to, k = ending[end], length[i]
                found[to - k:to] = first[source[i]:source[i] + k]
        return found, edge

    def finish(self, block, own, replies):
        rows = np.frombuffer(unpack(own, 1)[0], np.int64).reshape(-1, 5)
        ids = np.array(block.ids, np.int64)
        words = [t.split() for t in block.texts]
        sizes = np.array([len(w) for w in words], np.int64)
        begins = np.cumsum(np.r_[0, sizes])
        change = np.zeros(int(begins[-1]) + 1, np.int64)
        for shard, reply in replies.items():
            first = np.frombuffer(reply, np.int64)
            part = rows[rows[:, 0] == shard]
            size = part[:, 4]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(np.r_[0, size])[:-1], size)
            hit = first[np.repeat(part[:, 1], size) + step] < np.repeat(ids[part[:, 2]], size)
            at = (np.repeat(part[:, 3], size) + step)[hit]
            np.add.at(change, at, 1)
            np.add.at(change, at + self.n, -1)
        gone = np.cumsum(change)[:-1] > 0
        out = defaultdict(list)
        for d, own_words in enumerate(words):
            lost = gone[begins[d]:begins[d + 1]]
            n = int(lost.sum())
            kept = b" ".join([w for w, x in zip(own_words, lost.tolist()) if not x] if n else own_words)
            out["n_words"].append(len(own_words))
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode() if self.keep_text else None)
        return out


def remove_repeated_phrases(docs: DataFrame, n: int = 13, gram: int = 5, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, the kept words joined by one space."""
    found = per_document(docs, RepeatedPhrases(n, gram, keep_text))
    return found if keep_text else found.drop("kept")


def without_repeated_phrases(docs: DataFrame, n: int = 13, gram: int = 5) -> DataFrame:
    """The documents with all their columns; texts that lose words are the kept words joined by one space, others stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = per_document(docs, RepeatedPhrases(n, gram, True), ["text", *others])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("keep_0"))
    return found.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), text.alias("text"),
                        *[F.col(f"keep_{i + 1}").alias(c) for i, c in enumerate(others)]).select(*docs.columns)
