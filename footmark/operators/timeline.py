"""Timeline of a case: events in order, with session marks over all platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.operators.cube import GAP_MICROS, place
from footmark.operators.spread import join_back, with_salt


def describe_event() -> Column:
    """``[platform] [mode] (family) indicator``; the mode only when it is known."""
    mode = F.when(F.col("access_mode") != V.UNKNOWN, F.concat(F.lit("["), "access_mode", F.lit("]")))
    indicator = F.coalesce(F.nullif(F.col("extracted_indicator"), F.lit("")), F.lit(""))
    return F.concat_ws(
        " ", F.concat(F.lit("["), "suspected_platform", F.lit("]")), mode,
        F.concat(F.lit("("), "artifact_family", F.lit(")")),
        F.when(indicator != "", indicator).otherwise(F.col("artifact_type")))


def event_place() -> Column:
    """Time and ``seq`` of a timed row as one number (no ``seq`` comes first), so that its minimum is a hash aggregate."""
    return place(F.unix_micros("ts"), F.coalesce("seq", F.lit(-1)))


def case_sessions(timed: DataFrame) -> DataFrame:
    """Per (case, hour) of salted timed rows: session number, first and last (time, seq) and size of the session."""
    at, here = F.unix_micros("ts"), event_place()
    ends = [F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    per_salt = timed.groupBy("case_id", "hour", "salt").agg(
        F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min(here).alias("lo"), F.max(here).alias("hi"))
    hours = per_salt.groupBy("case_id", "hour").agg(F.sum("n").alias("n"), *ends, F.collect_set("salt").alias("salts"))
    by_hour = Window.partitionBy("case_id").orderBy("hour")
    gap = F.col("first_at") - F.lag("last_at").over(by_hour) > GAP_MICROS
    numbered = hours.withColumn("breaks", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "session_no", F.sum("breaks").over(by_hour.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    session = Window.partitionBy("case_id", "session_no")
    return numbered.select(
        "case_id", "hour", "session_no", "salts", F.min("lo").over(session).alias("first_place"),
        F.max("hi").over(session).alias("last_place"), F.sum("n").over(session).alias("session_size"))


def timeline(artifacts: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """Timed artifacts as events; sort by ``ts``, ``seq`` where they are written.

    ``[Session n Start]`` marks the first event of a session and ``[Session n
    End]`` its last one.  Both confidences are given: the extractor's, which the
    event list shows, and the scored one.  Sessions need only case, time and
    ``seq``: ``plain`` gives the artifacts before they were scored, so that the
    chain behind ``artifacts`` is not run for them a second time.
    """
    def salted(df: DataFrame) -> DataFrame:
        return with_salt(df.where(F.col("ts").isNotNull()).withColumn("hour", F.date_trunc("hour", "ts")))

    timed = salted(artifacts)
    sessions = case_sessions(timed if plain is None else salted(plain.select("case_id", "record_id", "ts", "seq")))
    joined = join_back(timed, sessions, ["case_id", "hour"])
    here = event_place()
    number = F.col("session_no").cast("string")
    mark = (
        F.when(here == F.col("first_place"), F.concat(F.lit("[Session "), number, F.lit(" Start] ")))
        .when((here == F.col("last_place")) & (F.col("session_size") > 1),
              F.concat(F.lit("[Session "), number, F.lit(" End] "))).otherwise(""))
    scored = [c for c in ("confidence",) if c in artifacts.columns]
    return joined.select(
        "case_id", "ts", "seq", "record_id", F.concat(mark, "artifact_type").alias("event_type"),
        describe_event().alias("description"), "suspected_platform", "access_mode", "classification",
        "initial_confidence", *scored, "session_no")


def sorted_timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("case_id", "ts", "seq")


def first_events(events: DataFrame, most: int = 50) -> DataFrame:
    """First events of each case, for a report page."""
    w = Window.partitionBy("case_id").orderBy("ts", "seq")
    return events.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= most)


def history_gaps(visits: DataFrame, source: list[str], least: int = 10, most: int = 5) -> DataFrame:
    """First gaps of more than a day in a history with at least ``least`` timed rows.

    Input: the ``source`` columns and ``ts``.  Two visits of one day are less
    than a day apart, so gaps are found on a table of days, which stays small
    whatever the number of visits.
    """
    day_us = 24 * 3600 * 1_000_000
    days = visits.where(F.col("ts").isNotNull()).groupBy(*source, F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    by_day = Window.partitionBy(*source).orderBy("day")
    gaps = (
        days.withColumn("before", F.lag("hi").over(by_day))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*source)))
        .where((F.col("total") >= least) & (F.col("lo") - F.col("before") > day_us))
        .withColumn("gap_no", F.row_number().over(Window.partitionBy(*source).orderBy("before")))
        .where(F.col("gap_no") <= most)
    )
    gap = F.col("lo") - F.col("before")
    whole_days = F.floor(gap / day_us)
    hours = F.floor((gap - whole_days * day_us) / 3_600_000_000)
    return gaps.select(
        *source, "gap_no", F.timestamp_micros("before").alias("gap_start"), F.timestamp_micros("lo").alias("gap_end"),
        F.concat(F.lit("Gap of "), whole_days.cast("string"), F.lit("d "), hours.cast("string"), F.lit("h")).alias("gap"))


def future_stamps(visits: DataFrame, source: list[str], as_of: Column) -> DataFrame:
    """Number of times more than a day ahead of ``as_of`` per source; sources without any are left out."""
    late = F.col("ts") > as_of + F.expr("INTERVAL 24 HOURS")
    return visits.groupBy(*source).agg(F.count_if(late).alias("future_count")).where(F.col("future_count") > 0)
