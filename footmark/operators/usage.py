"""App usage, traffic and history tables whose facts sit in two places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: An application numbers its rows within one database; each case and profile has its own.
PLACE = ["case_id", "user_profile"]


def history_visits(items: DataFrame, visits: DataFrame) -> DataFrame:
    """History items with their visits: items (item_id, url), visits (item_id, visit_time, …), both with their place.

    An id counts only within one database: that of a case and profile.
    """
    return items.join(visits, [*PLACE, "item_id"])


def annotated_downloads(annotations: DataFrame, places: DataFrame, attributes: DataFrame, name: str, *keep: str) -> DataFrame:
    """Annotations of one attribute with their place.

    ``annotations``: place_id, attribute_id, content.  ``places``: place_id,
    url.  ``attributes``: attribute_id, name.  All have case_id and
    user_profile.  ``keep`` names further columns.
    """
    wanted = attributes.where(F.col("name") == name).select(*PLACE, "attribute_id")
    return annotations.join(wanted, [*PLACE, "attribute_id"], "left_semi").join(places, [*PLACE, "place_id"]).select(
        *PLACE, "place_id", "url", F.col("content").alias("target_path"), *keep)


def app_usage(objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Usage objects with their metadata: those of an app stream, or with a known bundle.

    ``objects``: metadata_id, stream, start_raw, end_raw, value.  ``metadata``:
    metadata_id, bundle_id.  Both have case_id and user_profile.  Adds ``seconds``.
    """
    joined = objects.join(metadata, [*PLACE, "metadata_id"], "left")
    kept = joined.where(F.contains(F.lower("stream"), F.lit("app")) | F.col("bundle_id").isNotNull())
    return kept.withColumn("seconds", F.floor(F.col("end_raw") - F.col("start_raw")).cast("bigint"))


def app_traffic(usage: DataFrame, processes: DataFrame) -> DataFrame:
    """Traffic rows with the package of their process; rows without one are left out."""
    return usage.join(processes, [*PLACE, "process_id"]).where(F.col("package").isNotNull())


def latest(rows: DataFrame, most: int, order: Column, *group: str) -> DataFrame:
    """Latest rows overall, or per group when one is named."""
    if not group:
        return rows.orderBy(order).limit(most)
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def replace_by_key(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Latest row per key.

    An aggregate with a struct maximum, so a hot key sends one row per task.
    """
    rest = [c for c in rows.columns if c not in key and c != version]
    return rows.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("last")).select(*key, "last.*")


def acquisition_quality(lines: DataFrame) -> DataFrame:
    """Read-error map of an acquisition: sizes by state and the quality that follows.

    ``lines``: evidence_id, line (``position size state``; comments start with #).
    """
    parts = F.split(F.trim("line"), r"\s+")
    raw = F.get(parts, F.lit(1))
    size = F.when(F.lower(raw).startswith("0x"), F.conv(F.substring(raw, 3, 32), 16, 10)).otherwise(raw).try_cast("bigint")
    rows = lines.where(~F.startswith(F.trim("line"), F.lit("#")) & (F.size(parts) >= 3)).select(
        "evidence_id", size.alias("size"), F.get(parts, F.lit(2)).alias("state")).where(F.col("size").isNotNull())

    def of(state: str) -> Column:
        return F.sum(F.when(F.col("state") == state, F.col("size")).otherwise(F.lit(0).cast("bigint")))

    sums = rows.groupBy("evidence_id").agg(F.sum("size").alias("total"), of("+").alias("good"), of("-").alias("bad"))
    return lines.select("evidence_id").distinct().join(sums, "evidence_id", "left").select(
        "evidence_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "good", "bad")],
        F.when(F.col("bad") > 0, "Degraded").when(F.col("total") > 0, "Normal").otherwise("Unknown").alias("quality"))
