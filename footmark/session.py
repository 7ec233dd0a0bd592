"""Spark sessions with the settings the jobs expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


# Above 8,000 bytes of bytecode the JVM does not compile a method.  Long rule chains reach that, so stages
# that would get such a method are run operator by operator instead, which is several times faster.
RUNTIME = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results and speed depend on, for sessions made elsewhere."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that hold on a laptop and on a cluster: UTC times, adaptive plans, skew handling."""
    return (
        builder.config(map=RUNTIME)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def local_session(cpus: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """Session of this machine, for tests and benchmarks.  ``settings`` hold what must be set before a session starts."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("footmark"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(map=settings or {})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
