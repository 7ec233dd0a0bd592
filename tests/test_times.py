from datetime import datetime, timezone

from pyspark.sql import functions as F

from footmark.functions import timeconv as C

NOON = datetime(2025, 1, 11, 16, 0, tzinfo=timezone.utc)


def one(spark, col):
    value = spark.range(1).select(F.unix_micros(col)).first()[0]
    return None if value is None else datetime.fromtimestamp(value / 1e6, timezone.utc)


def test_every_clock(spark):
    seconds = int(NOON.timestamp())
    raw = {"webkit": 13381084800000000, "unix_us": seconds * 10**6, "filetime": 133810848000000009,
           "cocoa": seconds - 978307200, "unix_ms": seconds * 1000, "unix_s": seconds}
    for kind, value in raw.items():
        assert one(spark, C.to_ts(F.lit(value), kind)) == NOON, kind
        assert one(spark, C.to_ts_by_kind(F.lit(value), F.lit(kind))) == NOON, kind
        assert one(spark, C.to_ts(F.lit(0), kind)) is None
        assert one(spark, C.to_ts(F.lit(None).cast("bigint"), kind)) is None
        assert one(spark, C.to_ts(F.lit(-5), kind)) is None


def test_fraction_of_a_second(spark):
    got = one(spark, C.to_ts(F.lit(758304000.25), "cocoa"))
    assert got.microsecond == 250000


def test_install_time(spark):
    ms = int(NOON.timestamp() * 1000)
    assert one(spark, C.install_time(F.lit(hex(ms)))) == NOON
    assert one(spark, C.install_time(F.lit(str(ms)))) == NOON
    assert one(spark, C.install_time(F.lit("abc"))) is None


def test_log_times(spark):
    assert one(spark, C.log_time(F.lit("x 2025-01-11  16:00:00.5 y"))) == NOON
    assert one(spark, C.short_log_time(F.lit("01-11 16:00:00.123 I/x"), 2025)) == NOON
    assert one(spark, C.log_time(F.lit("no time"))) is None
    assert one(spark, C.short_log_time(F.lit("02-29 16:00:00"), 2025)) is None


def test_utf16_with_odd_length(spark):
    text = "AB\0C".encode("utf-16-le") + b"x"
    assert spark.range(1).select(C.utf16_text(F.lit(text))).first()[0] == "AB"
