"""Confidence of an artifact: base score, boost by links, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.operators.enrich import is_carved, is_raw
from footmark.operators.links import link_families


def _weight(col: Column, weights: dict[str, float], other: float) -> Column:
    out = F
    for value in dict.fromkeys(weights.values()):
        out = out.when(col.isin([k for k, w in weights.items() if w == value]), F.lit(value))
    return out.otherwise(F.lit(other))


def rank_of(level: Column) -> Column:
    """Place of a level, weakest first; ``Medium`` counts as Moderate, unknown levels as weakest."""
    return (F.when(level == "High", 3).when(level.isin("Moderate", "Medium"), 2).when(level == "Low", 1)
            .otherwise(0))


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in V.LEVELS]), rank + 1)


def base_score() -> Column:
    """Reliability times class times layer, time bonus, then the deductions, in this order of operations."""
    notes = F.lower(F.coalesce("notes", F.lit("")))
    score = (
        _weight(F.col("artifact_family"), V.FAMILY_RELIABILITY, V.OTHER_RELIABILITY)
        * _weight(F.col("classification"), V.CLASS_WEIGHT, V.OTHER_CLASS_WEIGHT)
        * _weight(F.col("attribution_layer"), V.LAYER_WEIGHT, V.OTHER_LAYER_WEIGHT)
    )
    timed = F.col("ts").isNotNull()
    score = score + F.when(timed & F.col("tz_norm"), F.lit(0.1)).when(timed, F.lit(0.05)).otherwise(F.lit(0.0))
    for test, factor in [
        (F.contains(notes, F.lit("weak indicator")), 0.7),
        (F.contains(notes, F.lit("alone is not sufficient")), 0.7),
        (is_carved(), 0.6),
        (is_raw() & ~is_carved(), 0.5),
        (F.col("persistence_state") == V.FRAGMENT, 0.7),
    ]:
        score = score * F.when(test, F.lit(factor)).otherwise(F.lit(1.0))
    return score


def score_level(score: Column) -> Column:
    out = F
    for cut, level in V.LEVEL_CUTS:
        out = out.when(score >= cut, level)
    return out.otherwise(V.LEVELS[0])


def base_confidence(artifacts: DataFrame) -> DataFrame:
    """Adds ``score`` and ``confidence``; the extractor's own value stays in ``initial_confidence``."""
    scored = artifacts.withColumn("score", base_score())
    return scored.withColumn("confidence", score_level(F.col("score")))


def boost(artifacts: DataFrame) -> DataFrame:
    """Raises the level by the number of families among the links; Unsupported never moves."""
    n, level = link_families(F.col("links")), F.col("confidence")
    return artifacts.withColumn("confidence", F.when(
        (n >= 3) & (level == "Moderate"), "High").when((n >= 1) & (level == "Low"), "Moderate").otherwise(level))


def cap_recovery(artifacts: DataFrame) -> DataFrame:
    """Recovered artifacts never stay High; the note says so."""
    capped = (is_carved() | is_raw()) & (F.col("confidence") == "High")
    return artifacts.withColumns({
        "notes": F.when(capped, F.concat("notes", F.lit(V.RECOVERY_CAP_NOTE))).otherwise(F.col("notes")),
        "confidence": F.when(capped, "Moderate").otherwise(F.col("confidence")),
    })


def cap_coverage(artifacts: DataFrame, coverage: DataFrame) -> DataFrame:
    """No High in cases whose image is a triage or partial collection."""
    partial = coverage.where(F.col("image_type").isin(V.PARTIAL_IMAGES)).select(
        "case_id", F.lit(True).alias("partial_image"))
    # One row per case: Spark broadcasts it while it is below its size threshold.
    joined = artifacts.join(partial, "case_id", "left")
    capped = F.coalesce("partial_image", F.lit(False)) & (F.col("confidence") == "High")
    return joined.withColumns({
        "notes": F.when(capped, F.concat(F.coalesce("notes", F.lit("")), F.lit(V.COVERAGE_CAP_NOTE)))
        .otherwise(F.col("notes")),
        "confidence": F.when(capped, "Moderate").otherwise(F.col("confidence")),
    }).drop("partial_image")


def cap_acquisition(df: DataFrame, quality: DataFrame, level_col: str = "confidence_hint") -> DataFrame:
    """Hints above what the acquisition quality allows are lowered; no quality row means no ceiling.

    ``quality``: case_id, quality (Normal, Degraded, Unknown).
    """
    joined = df.join(quality.select("case_id", "quality"), "case_id", "left")
    ceiling = F.when(F.col("quality").isNull() | (F.col("quality") == "Normal"), 3).otherwise(2)
    return joined.withColumn(level_col, level_of(F.least(rank_of(F.col(level_col)), ceiling))).drop("quality")


def score(linked: DataFrame, coverage: DataFrame) -> DataFrame:
    """Base score, boost and caps of enriched and linked artifacts."""
    return cap_coverage(cap_recovery(boost(base_confidence(linked))), coverage)
