"""Which artifacts support each other: same platform and hour, and same platform across families.

A row links to at most five others of its hour and three others of its
platform, so only the first six (four) rows of a group matter.  Those are found
with a limit that Spark applies on the map side as well, and are joined back
with salted keys.  No pairs within a group are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.operators.spread import join_back, with_salt

HOUR_LINKS = 5
FAMILY_LINKS = 3
LINK_TYPE = "array<struct<id:string,family:string>>"


def _link() -> Column:
    return F.struct(F.col("record_id").alias("id"), F.col("artifact_family").alias("family"))


def _no_links() -> Column:
    return F.array().cast(LINK_TYPE)


def _others(links: Column, most: int) -> Column:
    mine = F.col("record_id")
    others = F.slice(F.filter(links, lambda x: x["id"] != mine), 1, most)
    return F.coalesce(others, _no_links())


def _ordered(column: str) -> Column:
    """Collected structs in order of their first field, without that field."""
    in_order = F.array_sort(F.collect_list(F.struct(F.col(column), _link().alias("link"))))
    return F.transform(in_order, lambda x: x["link"])


def hourly_heads(rows: DataFrame) -> DataFrame:
    """First six artifacts per (case, platform, hour), for groups of two or more."""
    keys = ["case_id", "suspected_platform", "hour"]
    timed = rows.where(F.col("hour").isNotNull())
    per_salt = timed.groupBy(*keys, "salt").agg(F.count("*").alias("n"))
    sizes = per_salt.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    order = Window.partitionBy(*keys).orderBy("seq")
    slim = timed.select(*keys, "seq", "record_id", "artifact_family")
    first = slim.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= HOUR_LINKS + 1)
    heads = first.groupBy(*keys).agg(_ordered("seq").alias("heads"))
    return sizes.where(F.col("n") >= 2).join(heads, keys).drop("n")


def hourly_links(artifacts: DataFrame) -> DataFrame:
    """Adds ``links``: the first five other artifacts of the same platform and clock hour, in ``seq`` order."""
    rows = with_salt(artifacts.withColumn("hour", F.date_trunc("hour", "ts")))
    keys = ["case_id", "suspected_platform", "hour"]
    linked = join_back(rows, hourly_heads(rows), keys)
    return linked.withColumn("links", _others(F.col("heads"), HOUR_LINKS)).drop("heads", "hour", "salt")


def platform_heads(rows: DataFrame) -> DataFrame:
    """First four artifacts per (case, platform), families in order of their first ``seq``."""
    keys = ["case_id", "suspected_platform"]
    families = rows.groupBy(*keys, "artifact_family").agg(
        F.min("seq").alias("family_seq"), F.collect_set("salt").alias("salts"))
    order = Window.partitionBy(*keys, "artifact_family").orderBy("seq")
    slim = rows.select(*keys, "artifact_family", "seq", "record_id")
    first = slim.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= FAMILY_LINKS + 1)
    # From here on there are at most four rows per family, and a platform has a handful of families.
    ranked = first.join(families.drop("salts"), [*keys, "artifact_family"]).withColumn(
        "place", F.struct("family_seq", "seq"))
    heads = ranked.groupBy(*keys).agg(F.slice(_ordered("place"), 1, FAMILY_LINKS + 1).alias("platform_heads"))
    several = families.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"))
    return several.where(F.col("n") >= 2).join(heads, keys).drop("n")


def family_links(artifacts: DataFrame) -> DataFrame:
    """Adds ``links``: the first three others of a platform that shows two or more families."""
    rows = with_salt(artifacts)
    linked = join_back(rows, platform_heads(rows), ["case_id", "suspected_platform"])
    return linked.withColumn("links", _others(F.col("platform_heads"), FAMILY_LINKS)).drop("platform_heads", "salt")


def link(artifacts: DataFrame) -> DataFrame:
    """Both sorts of links: those of the hour first, then those across families that are not among them."""
    # Slim rows go through both joins; whole rows are joined once, with their links.
    slim = artifacts.select("case_id", "suspected_platform", "record_id", "seq", "artifact_family",
                            F.date_trunc("hour", "ts").alias("hour"))
    rows = with_salt(slim)
    by_hour = join_back(rows, hourly_heads(rows), ["case_id", "suspected_platform", "hour"])
    both = join_back(by_hour, platform_heads(rows), ["case_id", "suspected_platform"])
    found = both.select("record_id", F.col("seq").alias("linked_seq"), F.array_union(
        _others(F.col("heads"), HOUR_LINKS), _others(F.col("platform_heads"), FAMILY_LINKS)).alias("links"))
    # A record has one row per sequence number; without numbers the id alone names it.
    same = (artifacts["record_id"] == found["record_id"]) & artifacts["seq"].eqNullSafe(found["linked_seq"])
    return artifacts.join(found, same, "left").select(artifacts["*"], "links")


def link_families(links: Column) -> Column:
    """Number of distinct families among the links."""
    return F.size(F.array_distinct(F.transform(links, lambda x: x["family"])))
