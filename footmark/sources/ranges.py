"""Files of any size as rows of byte ranges.

``binaryFile`` gives a file as one value and refuses those above its limit.  Here a file is as many rows as it has
ranges, dealt to tasks evenly, so an image of a disk is read by many tasks at once and none holds more than a range.
Neighbouring ranges overlap: what lies across a border is whole in one of them, and counts where it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

RANGE_BYTES = 16 << 20
OVERLAP = 64 << 10


def open_file(uri: str) -> pa.NativeFile:
    """A file of any store that Arrow opens, by the name that Spark gives it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def plan_ranges(files: DataFrame, size: int = RANGE_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """One row for each range of an inventory's files: ``start`` up to ``stop`` is its own; it is read from ``first`` on,
    up to ``overlap`` bytes past ``stop``.  An empty file has no range."""
    starts = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(size).cast("bigint")))
    rows = files.withColumn("start", F.explode(starts)).withColumn("stop", F.least(F.col("start") + size, F.col("size")))
    return rows.withColumn("first", F.greatest(F.col("start") - overlap, F.lit(0)))


def read_ranges(files: DataFrame, size: int = RANGE_BYTES, overlap: int = OVERLAP, per_task: int = 128 << 20) -> DataFrame:
    """Adds first, start, stop and the bytes of each range to the files of an inventory (with ``uri`` and ``size``).

    Filter the inventory before: only what is left is opened.  Where the inventory has ``content`` the ranges are cut
    from it, so that stores which only Spark opens are read too, up to ``binaryFile``'s limit.
    """
    end = F.least(F.col("stop") + overlap, F.col("size"))
    planned = plan_ranges(files, size, overlap)
    if "content" in files.columns:
        data = F.substring("content", (F.col("first") + 1).cast("int"), (end - F.col("first")).cast("int"))
        return planned.withColumn("data", data).drop("content")
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per_task))
    rows = planned.withColumn("end", end).repartition(tasks, "uri", "start")
    schema = rows.drop("end").withColumn("data", F.lit(None).cast("binary")).schema
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in arrow.names if n != "data"}
            for i, (uri, first, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uri", "first", "end")))):
                with open_file(uri) as source:
                    data = source.read_at(end - first, first)
                row = [pa.array([data], f.type) if f.name == "data" else columns[f.name].slice(i, 1).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(row, schema=arrow)

    return rows.mapInArrow(read, schema)
