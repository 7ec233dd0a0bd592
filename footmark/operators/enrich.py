"""Source class, acquisition source, surface and persistence of an artifact: row-local, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V


def _notes() -> Column:
    return F.lower(F.coalesce("notes", F.lit("")))


def is_carved() -> Column:
    return F.contains(_notes(), F.lit("[carved]"))


def is_raw() -> Column:
    return F.contains(_notes(), F.lit("[raw]"))


def source_class(family: Column) -> Column:
    """Evidence source class of a family; families without one are Unknown."""
    col = F
    for name, families in V.SOURCE_CLASS.items():
        col = col.when(family.isin(families), name)
    return col.otherwise(V.UNKNOWN)


def acquisition_source() -> Column:
    family = F.col("artifact_family")
    inferred = (
        F.when(is_carved() | is_raw(), "E01 Image").when(family.isin(V.BROWSER_FAMILIES), "Browser Artifact")
        .when(family == V.SCREENSHOT, "Screenshot Capture").when(family.isin(V.MOUNTED_FAMILIES), "Mounted Directory")
        .otherwise(V.UNKNOWN))
    return F.when(F.col("acquisition_source") == V.UNKNOWN, inferred).otherwise(F.col("acquisition_source"))


def platform_surface() -> Column:
    family = F.col("artifact_family")
    inferred = (F.when(family.isin(V.BROWSER_FAMILIES), "Browser Web")
                .when(family == V.NATIVE, "Native Desktop App").otherwise(V.UNKNOWN))
    return F.when(F.col("platform_surface") == V.UNKNOWN, inferred).otherwise(F.col("platform_surface"))


def persistence_state() -> Column:
    """Recovered pieces first, then binary scans, then the family with its classification."""
    subtype = F.lower(F.coalesce("artifact_subtype", F.lit("")))
    family, direct = F.col("artifact_family"), F.col("classification") == "Direct"
    return (
        F.when(subtype.startswith("carved_") | is_carved(), V.FRAGMENT)
        .when(subtype.startswith("raw_") | is_raw(), V.WEAKLY)
        .when(F.contains(subtype, F.lit("binary scan")), V.WEAKLY)
        .when(family.isin(V.STRONG_FAMILIES), F.when(direct, V.INTACT).otherwise(V.PARTLY))
        .when(family.isin(V.WEAK_FAMILIES), F.when(direct, V.PARTLY).otherwise(V.WEAKLY))
        .when(family.isin(V.TRACE_FAMILIES), V.PARTLY)
        .when(family.isin(V.SCREENSHOT, V.FILE_SYSTEM), V.INTACT)
        .otherwise(V.NOT_OBSERVED)
    )


def assign_source_class(artifacts: DataFrame) -> DataFrame:
    """Always set from the family, whatever the extractor said."""
    return artifacts.withColumn("source_class", source_class(F.col("artifact_family")))


def assign_acquisition_source(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("acquisition_source", acquisition_source())


def assign_surface(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("platform_surface", platform_surface())


def assign_persistence(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumn("persistence_state", persistence_state())


def enrich(artifacts: DataFrame) -> DataFrame:
    """All four at once, as one projection."""
    return artifacts.withColumns({
        "source_class": source_class(F.col("artifact_family")),
        "acquisition_source": acquisition_source(),
        "platform_surface": platform_surface(),
        "persistence_state": persistence_state(),
    })
