"""Raw times of evidence tables to timestamps, and times inside log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: distance of the epochs from 1970 ---------------------------
MICROS_1601_TO_1970 = 11_644_473_600_000_000
SECONDS_1970_TO_2001 = 978_307_200


def to_ts(raw: Column, kind: str) -> Column:
    """Timestamp of a raw number; zero, negative and missing numbers give null.

    Kinds: ``webkit`` (microseconds since 1601), ``unix_us``, ``filetime``
    (100 ns since 1601), ``cocoa`` (seconds since 2001), ``unix_ms``, ``unix_s``.
    """
    whole = raw.cast("bigint")
    conversions = {
        "webkit": F.timestamp_micros(whole - F.lit(MICROS_1601_TO_1970)),
        "unix_us": F.timestamp_micros(whole),
        "filetime": F.timestamp_micros(
            F.floor(raw.cast("decimal(20,0)") / 10).cast("bigint") - F.lit(MICROS_1601_TO_1970)),
        "cocoa": F.timestamp_micros(
            F.round((raw.cast("double") + F.lit(SECONDS_1970_TO_2001)) * 1e6).cast("bigint")),
        "unix_ms": F.timestamp_millis(whole),
        "unix_s": F.timestamp_micros(F.round(raw.cast("double") * 1e6).cast("bigint")),
    }
    return F.when(raw.cast("double") > 0, conversions[kind])


def to_ts_by_kind(raw: Column, kind: Column) -> Column:
    """Like ``to_ts`` for tables that mix kinds: the kind is a column."""
    col = None
    for name in ("webkit", "unix_us", "filetime", "cocoa", "unix_ms", "unix_s"):
        col = (F.when if col is None else col.when)(kind == name, to_ts(raw, name))
    return col


def install_time(raw: Column) -> Column:
    """Milliseconds written as ``0x…`` or as a decimal number."""
    ms = F.when(raw.startswith("0x"), F.conv(F.substring(raw, 3, 32), 16, 10)).otherwise(raw)
    return to_ts(ms.try_cast("bigint"), "unix_ms")


def log_time(line: Column) -> Column:
    """First ``YYYY-MM-DD HH:MM:SS`` of a log line."""
    text = F.regexp_extract(line, r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    text = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))


def short_log_time(line: Column, year: int) -> Column:
    """First ``MM-DD HH:MM:SS`` of a log line, in a given year."""
    text = F.regexp_extract(line, r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    full = F.concat(F.lit(f"{year}-"), F.regexp_replace(F.nullif(text, F.lit("")), r"\s+", " "))
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss"))


def utf16_text(raw: Column) -> Column:
    """Text of UTF-16LE bytes up to the first zero character; an odd last byte is dropped."""
    even = F.substring(raw, F.lit(1), (F.length(raw) - F.length(raw) % 2).cast("int"))
    return F.substring_index(F.decode(even, "UTF-16LE"), "\0", 1)
