"""Small artifact tables for tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from footmark.operators.artifacts import ARTIFACT_SCHEMA, STRING_DEFAULTS

T0 = datetime(2025, 1, 11, 16, 0, tzinfo=timezone.utc)


def artifact(n: int, **values) -> dict:
    """One artifact; ``at`` is minutes after a fixed start, None for no time."""
    at = values.pop("at", None)
    row = {"case_id": "A", "record_id": f"r{n:04d}", "seq": n, **STRING_DEFAULTS, "ts": None, "tz_norm": False}
    row.update(suspected_platform="ChatGPT", artifact_family="Browser History", classification="Direct", user_profile="u")
    row.update(values)
    if at is not None:
        row["ts"] = T0 + timedelta(minutes=at)
    return row


def table(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r[c] for c in ARTIFACT_SCHEMA.names) for r in rows], ARTIFACT_SCHEMA)


def coverage(spark, image: str = "Full Disk Image", case: str = "A"):
    return spark.createDataFrame(
        [(case, image, image == "Full Disk Image", True, 1)],
        "case_id string, image_type string, full_disk_available boolean, carving_enabled boolean, profiles int")
