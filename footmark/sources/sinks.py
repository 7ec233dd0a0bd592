"""Where results go, and how a long job is cut into stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.operators.usage import replace_by_key


def write_results(tables: dict[str, DataFrame], root: str, keys: dict[str, tuple[list[str], str]] | None = None,
                  files: int = 16) -> None:
    """Result tables as parquet by case; cases that are written replace their earlier rows.

    A hash of the row deals each case to at most ``files`` tasks, so a case with much of a table is written by several
    and small cases do not get a file from every task.

    ``keys`` names (key columns, version column) of tables that may hold several
    versions of a row: the latest one is kept.
    """
    for name, df in tables.items():
        if keys and name in keys:
            key, version = keys[name]
            df = replace_by_key(df, key, version)
        plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct")]
        df = df.repartition("case_id", F.pmod(F.xxhash64(*plain), F.lit(files)))
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id")
         .parquet(f"{root}/{name}"))


def write_json(tables: dict[str, DataFrame], root: str) -> None:
    """Every result table as JSON lines, with arrays and structs kept."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


# --- fixed values: column titles of the exported checklist -------------------------
CHECKLIST_TITLES = [
    ("Tool Name", "tool_name"), ("Category", "category"), ("Likely Artifact Paths", "paths"), ("Evidence Status", "status"),
    ("Notes", "entry_notes"), ("Detection Method", "detection_method"), ("Execution Surface", "execution_surface"),
    ("Inference Location", "inference_location"), ("Confidence", "tool_confidence"), ("Caveat Flags", "caveat_flags"),
    ("Acquisition Source", "acquisition"), ("Artifact Count", "artifact_count"), ("Corroboration Level", "corroboration"),
    ("Attribution Scope", "attribution_scope"), ("Parser Coverage Status", "coverage_status"),
]


def checklist_table(entries: DataFrame, acquisition: str = "FILE_COLLECTION") -> DataFrame:
    """Checklist with report titles; arrays become lists separated by commas."""
    notes = (
        F.when(F.col("status") == "FOUND", F.concat(F.col("artifact_count").cast("string"), F.lit(" artifact path(s) matched.")))
        .when(F.col("status") == "NOT_FOUND", "No artifact paths located in evidence.")
        .when(~F.col("os_supported"), F.concat(F.lit("Tool not supported on detected OS ("), "os", F.lit(").")))
        .otherwise("No artifact path candidates defined for this OS."))
    rows = entries.withColumn("entry_notes", notes).withColumn("acquisition", F.lit(acquisition))
    lists = {c for c, t in rows.dtypes if t.startswith("array")}
    return rows.select("case_id", *[
        (F.array_join(c, ", ") if c in lists else F.col(c)).alias(title) for title, c in CHECKLIST_TITLES])


def write_checklist(entries: DataFrame, path: str, kind: str = "csv") -> None:
    table = checklist_table(entries)
    if kind == "csv":
        table.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        table.write.mode("overwrite").json(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Exported findings, read again."""
    return spark.read.json(path)


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The folder in spark.checkpoint.dir, else ``folder``; a cluster's executors must be able to share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or folder
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass one")
    if root.startswith("file:") and root == folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{root} is a folder of one machine")
    return root


_own_folder: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one; below a temporary one where a session of this machine has none."""
    if not _own_folder and spark.sparkContext.master.startswith("local"):
        _own_folder.append(tempfile.mkdtemp(prefix="footmark-"))
    return f"{shared_folder(spark, *_own_folder)}/footmark-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes a table once and reads it back, so that what follows does not depend on lost executors.

    The table goes below the shared folder in ``spark.checkpoint.dir``.  Where
    that is not set, ``folder`` must name one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark, folder)}/footmark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
