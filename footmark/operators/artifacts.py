"""The artifact table: its columns, and how extractors fill them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING_DEFAULTS = {
    "user_profile": "",
    "artifact_family": "Unknown",
    "artifact_type": "",
    "artifact_subtype": "",
    "artifact_path": "",
    "parser_used": "",
    "timestamp_type": "Unknown",
    "extracted_indicator": "",
    "suspected_platform": "Unknown",
    "suspected_model": "Unknown",
    "access_mode": "Unknown",
    "classification": "Inferred",
    "attribution_layer": "Platform",
    "initial_confidence": "Unsupported",
    "notes": "",
    "source_class": "Unknown",
    "acquisition_source": "Unknown",
    "platform_surface": "Unknown",
    "persistence_state": "Not Observed Within Scope",
    "related_link_id": "",
    "related_asset_id": "",
    "related_voice_id": "",
}

ARTIFACT_SCHEMA = T.StructType(
    [T.StructField("case_id", T.StringType()), T.StructField("record_id", T.StringType()),
     T.StructField("seq", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in STRING_DEFAULTS]
    + [T.StructField("ts", T.TimestampType()), T.StructField("tz_norm", T.BooleanType())]
)


def record_id(source: str, *key: str) -> Column:
    """Stable identifier: the same input row gives the same id in every run."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.sha2(F.concat_ws("|", F.col("case_id"), F.lit(source), *parts), 256)


def as_artifacts(df: DataFrame, source: str, key: list[str], **values: Column | str) -> DataFrame:
    """Rows of the artifact table made from ``df``.

    ``key`` names the columns that identify a row within its case; ``values``
    gives artifact columns as literals or expressions.  ``case_id``,
    ``user_profile`` and ``seq`` are taken over when ``df`` has them.
    """
    out: list[Column] = [F.col("case_id"), record_id(source, *key).alias("record_id")]
    out.append((F.col("seq") if "seq" in df.columns else F.lit(None)).cast("bigint").alias("seq"))
    for name, default in STRING_DEFAULTS.items():
        value = values.get(name)
        if value is None and name == "user_profile" and name in df.columns:
            value = F.col(name)
        if value is None:
            col = F.lit(default)
        elif isinstance(value, Column):
            col = F.coalesce(value, F.lit(default))
        else:
            col = F.lit(value)
        out.append(col.cast("string").alias(name))
    ts = values.get("ts", F.lit(None).cast("timestamp"))
    out.append(ts.alias("ts"))
    norm = values.get("tz_norm", F.lit(False))
    out.append((norm if isinstance(norm, Column) else F.lit(norm)).alias("tz_norm"))
    return df.select(*out)


def union_artifacts(*parts: DataFrame) -> DataFrame:
    """All extractor outputs as one artifact table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_records(artifacts: DataFrame) -> DataFrame:
    """Each ``record_id`` once, for inputs that were extracted twice."""
    return artifacts.dropDuplicates(["case_id", "record_id"])
