"""Packing by powers of two: every sequence is one piece of one document, so none is padded and none crosses documents.

A document's ids are cut into pieces of ``limit`` ids and, for the rest, one piece for each binary digit of its length,
longest first.  Pieces of equal length form a bucket; a training batch takes sequences of one bucket, so its rows have
one length.  Each task numbers the pieces it writes, by length; how many pieces of a length came before a task is a
running sum over the tasks' counters.  No row is shuffled to be numbered, and a length with a third of all rows is no group.

Nulls and edge cases: a null text is an empty document (one piece that holds the end id alone); a null ``doc_id`` is
kept as it is; repeated rows are separate documents; a text of any length is cut like the others; other columns are
ignored, whatever their names; an empty table gives an empty result.  ``limit`` must be a power of two.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices, stage

# --- fixed values: how the public byte-level vocabulary cuts a text before it is encoded ---
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --- end of fixed values ---

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, slot long"
PIECES_WITH_IDS = PIECES + ", ids binary"


class ByteIds:
    """Ids of texts, by the vocabulary and the merges of a tokenizer file.

    The byte-pair encoder of tiktoken, several times faster on words it meets for the first time, is set up from the
    file and gives the tokenizer's ids.  What it cannot cut (white space of a million characters) the tokenizer encodes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        letters = byte_letters()
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if token not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from
    the code point 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def byte_ids(path: str) -> ByteIds:
    """One for each process."""
    return ByteIds(path)


def binary_lengths(n: int, limit: int) -> list[int]:
    """``n`` as pieces of ``limit``, then one piece for each binary digit of the rest, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def binary_pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document's ids followed by ``end_id``: doc_id, start, length, ids_crc32, doc_tokens,
    the task that made it, its number among the task's pieces of that length and, on request, the ids as little-endian
    32-bit numbers."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"{limit} is no power of two")
    end = np.array([end_id], "<u4")

    def work(batches):
        ids, task = byte_ids(tokenizer), TaskContext.get().partitionId()
        slots: dict[int, int] = defaultdict(int)
        for batch in slices(batches, most=2 << 20):
            out = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                whole = np.concatenate((ids.encode(text or ""), end))
                raw, n, at = memoryview(whole).cast("B"), len(whole), 0
                for length in binary_lengths(n, limit):
                    piece = raw[4 * at:4 * (at + length)]
                    for name, value in (("doc_id", doc), ("start", at), ("length", length), ("ids_crc32", zlib.crc32(piece)),
                                        ("doc_tokens", n), ("task", task), ("slot", slots[length])):
                        out[name].append(value)
                    if keep_ids:
                        out["ids"].append(bytes(piece))
                    slots[length] += 1
                    at += length
            if out:
                yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work,
                     PIECES_WITH_IDS if keep_ids else PIECES)


def bucket_pieces(pieces: DataFrame, batch_tokens: int = 65_536) -> DataFrame:
    """Sequences from pieces: sequence_id (those of a length follow each other, longest first), offset, and the batch
    of its bucket that a sequence falls into, each of ``batch_tokens`` ids at most (one sequence at least).

    ``pieces`` must be a written table, as tasks may number their rows anew when they run again.  The driver sees one
    counter for each length, of which there are as many as the limit has binary digits.
    """
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    first, base = F.lit(0), 0
    for row in sorted(counts.groupBy("length").agg(F.sum("n").alias("n")).collect(), reverse=True):
        first = F.when(F.col("length") == row["length"], F.lit(base)).otherwise(first)
        base += row["n"]
    rank = F.col("before") + F.col("slot")
    columns = [c for c in pieces.columns if c not in ("task", "slot")]
    return (pieces.join(before, ["length", "task"])
            .select(*columns, (first + rank).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                    F.floor(rank / F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))).alias("batch")))


def packed_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, keep_ids: bool = False, batch_tokens: int = 65_536) -> DataFrame:
    pieces = stage(binary_pieces(docs, tokenizer, limit, keep_ids=keep_ids), "binary-pieces")
    return bucket_pieces(pieces, batch_tokens)
