"""Rule and inventory tables, built in or given by the user."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.rules import RULE_SCHEMA, default_rules

TOOL_SCHEMA = """
    tool_id string, tool_name string, vendor string, category string, platform_supported array<string>,
    execution_surface array<string>, artifact_path_candidates map<string, array<string>>,
    detection_method string, notes string, rule_version string
"""


def rules(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """The rule catalogue as a table, with own rules of the same schema behind it."""
    base = default_rules().to_df(spark)
    return base if extra is None else base.unionByName(extra.select(*base.columns))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).json(path)


def tools(spark: SparkSession, path: str) -> DataFrame:
    """Tool inventory from a JSON or YAML file with a ``tools`` list.

    The file is read whole: an inventory is a hand-written configuration.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading a YAML inventory needs PyYAML; give a JSON file instead") from e
        entries = yaml.safe_load(text)["tools"]
    else:
        entries = json.loads(text)["tools"]
    rows = [json.dumps(e) for e in entries]
    return spark.createDataFrame([(r,) for r in rows], "entry string").select(
        F.from_json("entry", TOOL_SCHEMA).alias("t")).select("t.*").withColumn(
        "notes", F.coalesce("notes", F.lit(""))).withColumn("rule_version", F.coalesce("rule_version", F.lit("1.0.0")))


def blob_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Blob formats: the built-in ones, or those of a JSON file with hex headers and footers and own sizes."""
    if path is None:
        raw = spark.createDataFrame(
            V.BLOB_RULES, "name string, extension string, header_hex string, footer_hex string, validate_internal boolean"
        ).withColumns({"min_size": F.lit(0).cast("bigint"), "max_size": F.lit(None).cast("bigint")})
    else:
        raw = spark.read.schema(
            "name string, extension string, header_hex string, footer_hex string, max_size bigint, min_size bigint, "
            "validate_internal boolean, description string").json(path, multiLine=True)
    return raw.select(
        "name", "extension", F.unhex("header_hex").alias("header"),
        F.unhex(F.coalesce("footer_hex", F.lit(""))).alias("footer"),
        F.coalesce("validate_internal", F.lit(False)).alias("validate_internal"),
        F.coalesce("min_size", F.lit(0).cast("bigint")).alias("min_size"), "max_size")
