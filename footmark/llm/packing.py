"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``limit`` ids.  Only the number of pieces of each length reaches the
driver (at most ``limit`` counters, whatever the size of the corpus).  There singles, pairs and triples of lengths
are indexed by their sum; lengths are filled with a combination that fits the gap exactly, as often as the counters
allow, and what is left goes best-fit.  The plan is a list of patterns with multiplicities; each piece finds its
place by its rank among the pieces of its length.

Nulls and edge cases: a null text is an empty document (one piece that holds the end id alone); a null ``doc_id`` is
kept as it is; repeated rows are separate documents; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices, stage

#: White space for str.split() that is none for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_WITH_IDS = PIECES + ", ids binary"


#: Ends of words that the tokenizer splits off as one piece of their own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """The ids of words as little-endian bytes.

    The tokenizer never joins words across white space, so a text's ids are the ids of its words.  A word of Latin
    letters with punctuation behind it is two pieces; the letters of many such words are encoded as one text and cut
    where a token ends a word.  Other words are encoded one by one.  Words are kept in two generations of at most
    ``most`` (or of one batch): when one is full the older goes, and words in use move on without being encoded again.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > self.most:
            self.older, self.words = self.words, {}
            new = words
        older, letters, parts = self.older, [], []
        for word in new:
            if word in older:
                self.words[word] = older[word]
            elif word.isascii() and word.isalpha() and word.islower():
                letters.append(word)
            else:
                core = word.rstrip(TAIL)
                if core.isalpha() and (core.isascii() or max(core) < "\u0250" and "\u0130" not in core):  # its lower case has a mark
                    parts.append((word, core.lower(), word[len(core):]))
                else:
                    self.words[word] = self.encode(word).tobytes()
        for core in {core for _, core, _ in parts}.difference(letters, self.words):
            if core in older:
                self.words[core] = older[core]
            else:
                letters.append(core)
        self.learn_letters(letters)
        for word, core, tail in parts:
            if tail not in self.tails:
                self.tails[tail] = self.encode(tail).tobytes()
            self.words[word] = self.words[core] + self.tails[tail]

    def learn_letters(self, new: list[str]) -> None:
        for at in range(0, len(new), 1000):
            part = new[at:at + 1000]
            ids = self.encode(" ".join(part))
            edge = np.flatnonzero(self.ends[ids]) + 1
            if len(edge) == len(part):
                raw = ids.tobytes()
                edge = (4 * edge).tolist()
                self.words.update(zip(part, map(raw.__getitem__, map(slice, [0, *edge], edge))))
            else:
                self.words.update((word, self.encode(word).tobytes()) for word in part)


@cache
def word_ids(path: str, most: int) -> WordIds:
    """One for each process: tasks of a worker share what it has learned."""
    return WordIds(path, most)


def split_words(text: str) -> list[str]:
    if any(c in text for c in ODD_SPACE):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, keep_ids: bool = False,
                 words_kept: int = 300_000) -> DataFrame:
    """One row for each piece of a document's ids followed by ``end_id``: doc_id, piece, start, length, ids_crc32
    and, on request, the ids as little-endian 32-bit numbers.

    ``words_kept`` bounds the words that a Python worker remembers (about 200 bytes each, twice); it changes the speed only.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(batches):
        ids = word_ids(tokenizer, words_kept)
        for batch in slices(batches, most=2 << 20):
            words = [split_words(t) if t else [] for t in batch.column("text").to_pylist()]
            ids.learn(set().union(*words))
            out = defaultdict(list)
            for doc, own in zip(batch.column("doc_id").to_pylist(), words):
                whole = b"".join(map(ids.words.__getitem__, own)) + end
                for k, at in enumerate(range(0, len(whole), 4 * limit)):
                    piece = whole[at:at + 4 * limit]
                    for name, value in (("doc_id", doc), ("piece", k), ("start", at // 4), ("length", len(piece) // 4),
                                        ("ids_crc32", zlib.crc32(piece)), ("ids", piece)):
                        out[name].append(value)
            yield out

    return arrow_map(docs.select("doc_id", "text"), work, PIECES_WITH_IDS if keep_ids else PIECES)


class Complements:
    """Available lengths with indexes of their single, pair and triple sums."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.left = np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        small = np.arange(1, gap // 2 + 1)
        fit = small[(self.left[small] > 0) & (self.left[gap - small] > 0) & ((2 * small != gap) | (self.left[small] > 1))]
        return (gap - int(fit[-1]), int(fit[-1])) if len(fit) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3:
            return None
        lengths = np.flatnonzero(self.left[:gap - 1])
        if not len(lengths):
            return None
        sums = np.zeros(gap + 1, bool)  # sums of two lengths below the gap
        have = self.left[:gap + 1] > 0
        for a in lengths:
            sums[a:] |= have[:gap + 1 - a]
        for a in lengths[::-1]:
            if sums[gap - a]:
                self.left[a] -= 1
                rest = self.pair(int(gap - a))
                self.left[a] += 1
                if rest:
                    return (int(a), *rest)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Uses a combination as often as the counters allow."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.left[x] -= k * times
        return times


def plan_sequences(counts: dict[int, int], limit: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, in order) and how many sequences have each."""
    index, plan = Complements(counts, limit), []
    for length in range(limit, 0, -1):
        while index.left[length]:
            if length == limit:
                plan.append(((length,), index.take((length,))))
                continue
            index.left[length] -= 1
            gap = limit - length
            rest = index.single(gap) or index.pair(gap) or index.triple(gap)
            index.left[length] += 1
            if rest is None:
                break
            plan.append(((length, *rest), index.take((length, *rest))))
    return plan + best_fit(index.left, limit)


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counters: all pieces of a length are placed at once, fullest sequences first."""
    open_by_gap: dict[int, list] = defaultdict(list)  # gap -> [pattern, sequences]
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = limit - sum(pattern)
        if not open_by_gap[gap]:
            insort(gaps, gap)
        open_by_gap[gap].append((pattern, times))

    for length in range(limit, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = limit // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = gaps[at]
            pattern, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps.pop(at)
            each = gap // length
            full = min(times, n // each)
            if full:
                put(pattern + (length,) * each, full)
                n -= full * each
            if full < times and n:
                put(pattern + (length,) * n, 1)
                n, full = 0, full + 1
            if full < times:
                put(pattern, times - full)
    return [x for gap in gaps for x in open_by_gap[gap]]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset) for each place of a pattern."""
    used: Counter = Counter()
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], used[length] + times, base, offset))
            used[length] += times
            offset += length
        base += times
    return rows


def pack(pieces: DataFrame, limit: int = 2048, per_bucket: int = 500_000) -> DataFrame:
    """Adds sequence_id and offset to pieces.  ``pieces`` must be a written table, as it is read three times.

    Ranks are counted in (length, bucket) groups of about ``per_bucket`` rows at most, with a running sum over the
    buckets of a length, so that a length with a third of all rows is no single group.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-max(counts.values(), default=0) // per_bucket))
    rows = spark.createDataFrame(slots(plan_sequences(counts, limit)),
                                 "length long, rank_from long, rank_to long, first_sequence long, offset long")
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = (keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (keyed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("before")))
    placed = ranked.join(F.broadcast(rows), ["length"]).where("rank >= rank_from AND rank < rank_to")
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
                         "offset")


def packed_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, keep_ids: bool = False,
                     words_kept: int = 300_000) -> DataFrame:
    pieces = token_pieces(docs, tokenizer, limit, keep_ids=keep_ids, words_kept=words_kept)
    return pack(stage(pieces, "pieces"), limit)
