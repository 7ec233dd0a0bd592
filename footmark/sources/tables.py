"""Evidence that arrives as extracted tables: visits, downloads, cookies, usage, traffic, key/values.

Each table is a parquet folder with the columns of the application that wrote
it, plus case_id and user_profile.  Readers bring them to one shape and leave
filters and unused columns to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footmark.operators import usage

RAW_TIME = "decimal(26,6)"  # exact for whole microseconds since 1601 and for fractions of a second

# --- fixed values: columns and clocks of the histories ---------------------------
# browser -> (url, title, visits, time, kind of time)
HISTORIES = {
    "Chrome": ("url", "title", "visit_count", "last_visit_time", "webkit"),
    "Edge": ("url", "title", "visit_count", "last_visit_time", "webkit"),
    "Brave": ("url", "title", "visit_count", "last_visit_time", "webkit"),
    "Android Chrome": ("url", "title", "visit_count", "last_visit_time", "webkit"),
    "Firefox": ("url", "title", "visit_count", "last_visit_date", "unix_us"),
    "Samsung Internet": ("url", "title", "visits", "date", "unix_ms"),
}
ITEM_HISTORIES = {"Safari": "cocoa", "iPhone Safari": "cocoa"}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _profile(df: DataFrame, default: str = "") -> Column:
    own = F.col("user_profile") if "user_profile" in df.columns else F.lit(None)
    return F.coalesce(own.cast("string"), F.lit(default)).alias("user_profile")


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("user_profile", _profile(df))


def read_visits(spark: SparkSession, paths: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Histories of all browsers as (case_id, user_profile, browser, url, title, visit_count, raw_time, time_kind).

    ``paths`` maps a browser to its table, or to its items and visits tables
    where the browser keeps two.
    """
    parts = []
    for browser, path in paths.items():
        if browser in ITEM_HISTORIES:
            items, seen = (spark.read.parquet(p) for p in path)
            items = items.select("case_id", _profile(items), F.col("id").alias("item_id"), "url")
            seen = seen.select("case_id", _profile(seen), F.col("history_item").alias("item_id"), "visit_time", "title")
            both = usage.history_visits(items, seen)
            names = ("url", "title", None, "visit_time", ITEM_HISTORIES[browser])
        else:
            both, names = spark.read.parquet(path), HISTORIES[browser]
        url, title, count, time, kind = names
        parts.append(both.select(
            "case_id", _profile(both), F.lit(browser).alias("browser"), F.col(url).alias("url"),
            F.col(title).alias("title"), (F.lit(None) if count is None else F.col(count)).cast("bigint").alias("visit_count"),
            F.col(time).cast(RAW_TIME).alias("raw_time"), F.lit(kind).alias("time_kind")))
    return _union(parts)


def read_downloads(spark: SparkSession, paths: dict[str, str | tuple[str, str, str]]) -> DataFrame:
    """Downloads: one table per Chromium browser; annotations, places and attributes for Firefox."""
    parts = []
    for browser, path in paths.items():
        if browser == "Firefox":
            notes, places, names = (spark.read.parquet(p) for p in path)
            found = usage.annotated_downloads(
                notes.select("case_id", _profile(notes), "place_id", F.col("anno_attribute_id").alias("attribute_id"), "content"),
                places.select("case_id", _profile(places), F.col("id").alias("place_id"), "url"),
                names.select("case_id", _profile(names), F.col("id").alias("attribute_id"), "name"), "downloads/destinationFileURI")
            parts.append(found.select(
                "case_id", "user_profile", F.lit(browser).alias("browser"), "target_path",
                F.col("url").alias("tab_url"), F.lit(None).cast("bigint").alias("total_bytes"),
                F.lit(None).cast(RAW_TIME).alias("raw_time"), F.lit("unix_us").alias("time_kind"), F.lit("").alias("mime_type")))
        else:
            df = spark.read.parquet(path)
            parts.append(df.select(
                "case_id", _profile(df), F.lit(browser).alias("browser"), "target_path", "tab_url",
                F.col("total_bytes").cast("bigint").alias("total_bytes"), F.col("start_time").cast(RAW_TIME).alias("raw_time"),
                F.lit("webkit").alias("time_kind"), "mime_type"))
    return _union(parts)


def read_cookies(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Cookie tables; the last access counts, else the creation."""
    parts = []
    for browser, path in paths.items():
        df = spark.read.parquet(path)
        if browser == "Firefox":
            host, used, made, kind = "host", "lastAccessed", "creationTime", "unix_us"
            time = F.col(used)
        else:
            host, used, made, kind = "host_key", "last_access_utc", "creation_utc", "webkit"
            time = F.when(F.coalesce(used, F.lit(0)) != 0, F.col(used)).otherwise(F.col(made))
        parts.append(df.select(
            "case_id", _profile(df), F.lit(browser).alias("browser"), F.col(host).alias("host_key"), "name",
            time.cast(RAW_TIME).alias("raw_time"), F.lit(kind).alias("time_kind")))
    return _union(parts)


def read_app_usage(spark: SparkSession, objects: str, metadata: str) -> DataFrame:
    """Usage objects with their metadata; see ``usage.app_usage`` for the columns."""
    return usage.app_usage(_placed(spark.read.parquet(objects)), _placed(spark.read.parquet(metadata)))


def read_app_traffic(spark: SparkSession, traffic: str, processes: str) -> DataFrame:
    return usage.app_traffic(_placed(spark.read.parquet(traffic)), _placed(spark.read.parquet(processes)))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Flat key/value tables: registry values, preference values, quarantine events."""
    return spark.read.parquet(path)
