"""Questions between blocks of documents, for operators that look for repeats in whole texts.

Documents are dealt by a hash of their content to blocks of about ``BLOCK_BYTES`` of text.  A block works on all its
documents at once, as numpy arrays, and talks to the rest of the corpus in two rounds:

1. it *asks* a bucket about the keys it holds (each key once for a block, whatever the number of its documents that
   hold it); the bucket *answers* each block;
2. with the answers it *sends* the few passages that matter to a shard; the shard *matches* them and replies;
3. with the replies the block *finishes* its documents.

Payloads are packed, one row for each block and bucket, so a shuffle moves a few bytes per key and never the texts of
other blocks.  A key that a third of all documents hold reaches its bucket once per block.  Buckets, shards and blocks
grow in number with the corpus, not in size.  All functions see the documents of a block in the same order, so a
block, bucket or shard that is computed again after the loss of an executor gives the same payloads.

The block exchange of the texts occurs three times in the plan and is made once (Spark reuses equal exchanges).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_BYTES = 4 << 20
#: Stands for a null id: larger than every other.
NO_ID = (1 << 63) - 1


@dataclass
class Block:
    ids: list[int]  # NO_ID for null
    texts: list[bytes]


class Operator(Protocol):
    schema: str  # of the result, after doc_id

    def ask(self, block: Block, buckets: int) -> dict[int, bytes]: ...

    def answer(self, payloads: list[bytes]) -> list[bytes]: ...

    def send(self, block: Block, answers: dict[int, bytes], buckets: int) -> tuple[dict[int, bytes], bytes]:
        """Payloads by shard, and what the block itself needs again in the end."""

    def match(self, payloads: list[bytes]) -> list[bytes]: ...

    def finish(self, block: Block, own: bytes, replies: dict[int, bytes]) -> dict[str, list]: ...


MAIL = "block int, place int, own boolean, payload binary"
MAIL_ARROW = pa.schema([("block", pa.int32()), ("place", pa.int32()), ("own", pa.bool_()), ("payload", pa.binary())])


def mail(block: list[int], place: list[int], own: list[bool], payload: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((block, place, own, payload), MAIL_ARROW)], schema=MAIL_ARROW)


def block_of(table: pa.Table) -> tuple[Block, list[int]]:
    """The documents in an order that does not depend on how they arrived, and their rows."""
    rows = sorted((NO_ID if d is None else d, t or "", i) for i, (d, t) in
                  enumerate(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())))
    return Block([d for d, _, _ in rows], [t.encode() for _, t, _ in rows]), [i for _, _, i in rows]


def letters(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("place").to_pylist(), table.column("payload").to_pylist()))


def per_document(docs: DataFrame, operator: Operator, keep: list[str] = ()) -> DataFrame:
    """One row for each document: doc_id, what the operator finds, and the columns to keep as keep_0, keep_1, ..."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = max(8, blocks // 2)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep) if c != "text"], key.alias("block"))
    kinds = StructType.fromDDL("doc_id long, " + operator.schema)
    found = set(StructType.fromDDL(operator.schema).names)
    source = {f"keep_{i}": "text" if c == "text" else f"keep_{i}" for i, c in enumerate(keep)} | {"doc_id": "doc_id"}
    for name, column in source.items():
        if name != "doc_id":
            kinds = kinds.add(name, texts.schema[column].dataType)
    result = to_arrow_schema(kinds)

    def ask(table: pa.Table) -> pa.Table:
        own = table.column("block")[0].as_py()
        out = operator.ask(block_of(table)[0], buckets)
        return mail([own] * len(out), list(out), [False] * len(out), list(out.values()))

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return table.set_column(3, MAIL_ARROW.field(3), pa.array(operator.answer(table.column("payload").to_pylist()), pa.binary()))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return mail([], [], [], [])
        block = left.column("block")[0].as_py()
        out, own = operator.send(block_of(left)[0], letters(right), buckets)
        return mail([block] * (len(out) + 1), [*out, block % buckets], [False] * len(out) + [True], [*out.values(), own])

    def match(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending"), ("block", "ascending")])
        payloads = table.column("payload").to_pylist()
        n = len(payloads) - sum(table.column("own").to_pylist())
        return table.set_column(3, MAIL_ARROW.field(3), pa.array(operator.match(payloads[:n]) + payloads[n:], pa.binary()))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return result.empty_table()
        (block, order), own = block_of(left), right.column("own")
        kept = right.filter(own).column("payload")[0].as_py()
        out = operator.finish(block, kept, letters(right.filter(pc.invert(own))))
        rows = left.take(pa.array(order, pa.int64()))
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) if f.name in found else rows.column(source[f.name]).cast(f.type)
                                     for f in result], schema=result)

    by_block = texts.groupBy("block")
    answers = by_block.applyInArrow(ask, MAIL).groupBy("place").applyInArrow(answer, MAIL)
    sent = by_block.cogroup(answers.groupBy("block")).applyInArrow(send, MAIL)
    replies = sent.groupBy("place").applyInArrow(match, MAIL)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(finish, kinds)


def pack(*arrays) -> bytes:
    """Arrays or byte strings as one byte string, with their lengths."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def unpack(payload: bytes, n: int) -> list[memoryview]:
    sizes, at, out = struct.unpack(f"<{n}q", payload[:8 * n]), 8 * n, []
    view = memoryview(payload)
    for size in sizes:
        out.append(view[at:at + size])
        at += size
    return out
