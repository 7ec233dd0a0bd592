"""The hourly cube: one pre-aggregate that feeds sessions, footprints, episodes and case reports.

Artifacts are counted per clock hour and per combination of their closed-list
columns.  Spark combines on the map side, so a platform or case with a third of
all rows sends a few rows per task and hour.  Two rows of one clock hour are
less than an hour apart, so a two-hour gap never falls inside an hour and
sessions can be found on the cube exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.matching import contains_any
from footmark.operators.scoring import rank_of

GAP_MICROS = 2 * 3600 * 1_000_000
NO_TIME = 2**62  # sorts untimed rows behind timed ones

DIMENSIONS = [
    "case_id", "suspected_platform", "user_profile", "hour", "artifact_family", "artifact_type",
    "classification", "suspected_model", "access_mode", "source_class", "acquisition_source",
    "platform_surface", "persistence_state", "parser_used", "evidence_class",
]


def evidence_letter(notes: Column) -> Column:
    """Letter of an ``Evidence class: X-…`` remark, else null."""
    token = F.split(F.trim(F.regexp_extract(notes, r"Evidence class: ([^.]*)", 1)), "-")[0]
    return F.nullif(token, F.lit(""))


def place(at: Column, seq: Column) -> Column:
    """Time, then ``seq``, as one number that sorts like the pair; untimed rows come last.

    A number of fixed width keeps the aggregate that takes its minimum a hash aggregate.
    """
    time = F.coalesce(at, F.lit(NO_TIME)).cast("decimal(19,0)")
    return time * F.lit(str(10**19)).cast("decimal(20,0)") + seq.cast("decimal(19,0)")


def hourly_cube(artifacts: DataFrame) -> DataFrame:
    """Counts, times and flags per hour and combination of the closed-list columns."""
    indicator = F.lower(F.coalesce("extracted_indicator", F.lit("")))
    subtype = F.lower(F.coalesce("artifact_subtype", F.lit("")))
    kind = F.lower(F.coalesce("artifact_type", F.lit("")))
    micros = F.unix_micros("ts")
    rows = artifacts.select(
        "case_id", "suspected_platform", "user_profile", F.date_trunc("hour", "ts").alias("hour"),
        *[c for c in DIMENSIONS[4:-1]], evidence_letter(F.col("notes")).alias("evidence_class"),
        "seq", micros.alias("at"), "confidence", "related_voice_id", "related_link_id", "related_asset_id",
        contains_any(indicator, V.IMAGE_ACTIVITY_WORDS).alias("image_word"),
        contains_any(indicator, V.IMAGE_REVIEW_WORDS).alias("review_word"),
        contains_any(indicator, V.SEARCH_ACTIVITY_WORDS).alias("search_word"),
        (contains_any(indicator, ["image", "upload"]) | F.contains(kind, F.lit("screenshot"))).alias("upload_word"),
        F.contains(subtype, F.lit("prompt")).alias("prompt_word"),
        F.contains(subtype, F.lit("response")).alias("response_word"),
    )

    def has(column: str) -> Column:
        return F.max(F.coalesce(F.col(column), F.lit("")) != "")

    return rows.groupBy(*DIMENSIONS).agg(
        F.count("*").alias("n"), F.count("at").alias("n_timed"),
        F.min("at").alias("min_at"), F.max("at").alias("max_at"), F.min("seq").alias("min_seq"),
        F.min(place(F.col("at"), F.col("seq"))).alias("first"),
        F.max(rank_of(F.col("confidence"))).alias("max_rank"),
        *[F.count_if(w).alias("n_" + w) for w in
          ("image_word", "review_word", "search_word", "upload_word", "prompt_word", "response_word")],
        has("related_voice_id").alias("voice"), has("related_link_id").alias("link"),
        has("related_asset_id").alias("asset"),
    )


def number_hours(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``session_no`` to one row per (``keys``, hour) with min_at and max_at: a new session starts after a gap of
    more than two hours.

    Rows without time belong to the first session.  The window runs over hours of a key, so its size is bounded by the
    time span, not by the artifacts.
    """
    by_hour = Window.partitionBy(*keys).orderBy("hour")
    before = F.max("max_at").over(by_hour.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce((F.col("min_at") - before > GAP_MICROS).cast("int"), F.lit(0))
    running = by_hour.rowsBetween(Window.unboundedPreceding, 0)
    return hours.withColumn("breaks", breaks).withColumn("session_no", F.sum("breaks").over(running) + 1).drop("breaks")


def session_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``starts_at``, the hour if a session other than the first begins in it, else null.

    Each hour may have several rows.  They are read in one pass over the hours of a key: what was before, and the
    earliest of the hour itself, are frames of one window, so nothing is aggregated and joined back.
    """
    hour = Window.partitionBy(*keys).orderBy("hour_no")
    before = F.max("max_at").over(hour.rangeBetween(Window.unboundedPreceding, -1))
    first = F.min("min_at").over(hour.rangeBetween(0, 0))
    numbered = rows.withColumn("hour_no", F.floor(F.unix_seconds("hour") / 3600))
    return numbered.withColumn("starts_at", F.when(first - before > GAP_MICROS, F.col("hour_no"))).drop("hour_no")


def session_numbers(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``session_no`` per ``keys`` to cube rows, which hold each hour once per combination of the closed lists."""
    hours = cube.groupBy(*keys, "hour").agg(F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"))
    numbered = number_hours(hours, keys).select(
        *[F.col(k).alias(f"of_{k}") for k in [*keys, "hour"]], "session_no")
    same = [cube[k].eqNullSafe(numbered[f"of_{k}"]) for k in [*keys, "hour"]]
    return cube.join(numbered, same).drop(*[f"of_{k}" for k in [*keys, "hour"]])


def most_frequent(counts: Column, value: str, first: str) -> Column:
    """Most frequent known value of an array of structs (value, n, first); ties go to the first seen.

    The array holds one entry per combination of closed-list values, so it is short.
    """
    known = F.array_distinct(F.filter(F.transform(counts, lambda c: c[value]), lambda v: v != V.UNKNOWN))

    def rank(v: Column) -> Column:
        mine = F.filter(counts, lambda c: c[value] == v)
        total = F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
        seen = F.array_min(F.transform(mine, lambda c: c[first]))
        return F.struct((-total).alias("n"), seen.alias("seen"), v.alias("value"))

    return F.coalesce(F.array_min(F.transform(known, rank))["value"], F.lit(V.UNKNOWN))
