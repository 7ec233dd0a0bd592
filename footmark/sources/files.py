"""Evidence that arrives as files: log lines, inventories, exports, transcripts.

The first folder below the root is the case; the rest is the path in the case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.matching import basename, extension, lenient_text
from footmark.operators.exports import EXPORT_SCHEMA


def _place(full: Column, root: str, encoded: bool = True) -> tuple[Column, Column]:
    """Case and path below it, from the full name of a file: encoded as a URI in ``_metadata``, plain in ``binaryFile``."""
    clean = root.rstrip("/").split("://")[-1].removeprefix("file:")
    decoded = F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))) if encoded else full
    rest = F.element_at(F.split(decoded, F.lit("\\Q" + clean + "/\\E"), 2), -1)
    return F.split(rest, "/", 2)[0], F.concat(F.lit("/"), F.get(F.split(rest, "/", 2), F.lit(1)))


def read_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of text logs: case_id, path, line_no, line.  All lines are read.

    ``line_no`` counts from one in each file, so ids made of it do not depend on how a file was split or on what lies
    beside it.  A block counts its own lines; how many came before is a running sum over the blocks of a file.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(root).select(
        "value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # The lines of a block follow each other in one task, which numbers them one by one.
    blocks = raw.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    case, path = _place(F.col("file_path"), root)
    number = F.col("before") + F.col("at") - F.col("first") + 1
    return raw.join(before, ["file_path", "block"]).select(
        case.alias("case_id"), path.alias("path"), number.alias("line_no"), F.col("value").alias("line"))


def file_inventory(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below a root: case_id, path, name, ext, size, mtime, uri, and their bytes only when asked for.

    ``content`` is for files up to ``binaryFile``'s limit; ``sources.ranges`` reads files of any size.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    case, path = _place(F.col("path"), root, encoded=False)
    columns = [case.alias("case_id"), path.alias("path"), basename(path).alias("name"),
               extension(basename(path)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
               raw["path"].alias("uri")]
    return raw.select(*columns, *([F.col("content")] if content else []))


def with_text(files: DataFrame) -> DataFrame:
    """Adds ``text`` for files that are text by extension."""
    return files.withColumn("text", F.when(F.col("ext").isin(V.TEXT_EXT), lenient_text(F.col("content"))))


def read_exports(spark: SparkSession, root: str) -> DataFrame:
    """Conversation exports (JSON arrays) with case_id and path."""
    raw = spark.read.schema(EXPORT_SCHEMA).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "conversations.json").json(root, multiLine=True).select("*", "_metadata.file_path")
    case, path = _place(F.col("file_path"), root)
    return raw.withColumn("case_id", case).withColumn("path", path).drop("file_path").where(F.col("mapping").isNotNull())


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Transcript files with their text, and audio files without any: case_id, path, name, mtime, text."""
    files = file_inventory(spark, root, content=True)
    said = files.where(F.col("ext").isin(V.TRANSCRIPT_EXT)).withColumn("text", lenient_text(F.col("content")))
    heard = file_inventory(spark, root).where(F.col("ext").isin(V.AUDIO_EXT)).withColumn("text", F.lit(None).cast("string"))
    columns = ["case_id", "path", "name", "mtime", "text"]
    return said.select(*columns).unionByName(heard.select(*columns))
