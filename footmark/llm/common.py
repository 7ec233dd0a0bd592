"""What the operators share: tables, stages in the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of a local session without spark.checkpoint.dir: the setting cannot be set in a running session.
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine a temporary folder where that is not set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="footmark-"))
        root = _own_folder[0]
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again; what follows survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, work: Callable[[Batches], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields dicts of columns (lists, numpy or Arrow arrays)."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Batches) -> Batches:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def slices(batches: Batches, column: str = "text", most: int = 1 << 22) -> Batches:
    """The same rows in slices of about ``most`` bytes of one column (one row at least), so that memory does not
    depend on how long the texts of a batch are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held + n > most and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def parts_for(df: DataFrame, rows: int, per_part: int) -> int:
    """Partitions for that many rows, and no fewer than the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))

