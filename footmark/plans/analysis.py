"""The whole way from evidence tables to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footmark.functions.rules import RuleBook, default_rules
from footmark.operators import cube, enrich, episodes, links, reports, scoring, timeline, tools
from footmark.plans.extractors import DEFAULT, TOOL_INPUTS, Inputs, Registry
from footmark.sources.sinks import stage


def with_seq(artifacts: DataFrame) -> DataFrame:
    """Fills ``seq`` by hour and record id where extractors gave none.

    Numbers are counted inside small buckets (hour, first three letters of the
    id) and shifted by a running sum over bucket counts, so no task sees a case
    as a whole: hours of a case are summed in one window, parts of an hour in another.
    """
    rows = artifacts.withColumn("hour", F.date_trunc("hour", "ts")).withColumn("part", F.substring("record_id", 1, 3))
    keys = ["case_id", "hour", "part"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))

    def earlier(window):
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    hours = counts.groupBy("case_id", "hour").agg(F.sum("n").alias("n")).select(
        F.col("case_id").alias("of_case"), F.col("hour").alias("of_hour"),
        earlier(Window.partitionBy("case_id").orderBy(F.col("hour").asc_nulls_last())).alias("hours_before"))
    within = counts.withColumn("parts_before", earlier(Window.partitionBy("case_id", "hour").orderBy("part")))
    before = within.join(hours, within["case_id"].eqNullSafe(hours["of_case"]) & within["hour"].eqNullSafe(hours["of_hour"])).select(
        *keys, (F.col("hours_before") + F.col("parts_before")).alias("before"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy(*keys).orderBy("record_id")))
    same = [inside[k].eqNullSafe(before[k]) for k in keys]
    joined = inside.join(before, same).select(
        *[inside[c] for c in artifacts.columns], (F.col("before") + F.col("inside")).alias("n"))
    return joined.withColumn("seq", F.coalesce("seq", "n")).drop("n")


def score_artifacts(raw: DataFrame, coverage: DataFrame) -> DataFrame:
    """Extracted artifacts to enriched, linked and scored ones."""
    return scoring.score(links.link(enrich.enrich(raw)), coverage)


def runs_of_cases(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """The extractor runs of every case.  They are as many as extractors are registered, so they become constants."""
    rows = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("extractor", "version", "status")]) for r in runs.collect()])
    return coverage.select("case_id", F.explode(rows).alias("run")).select("case_id", "run.*")


def governance_of(hours: DataFrame, coverage: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """What a governance record says of each case: coverage, blind spots of its platforms, facts, versions in use."""
    own = coverage if "profiles" in coverage.columns else coverage.withColumn("profiles", F.lit(0))
    by_case = runs_of_cases(runs, coverage)
    rolled = reports.coverage_rollup(by_case, hours, own)
    return {
        "coverage_rollup": rolled,
        "governance": reports.governance_facts(hours, coverage.join(rolled.select("case_id", "families_missing"), "case_id")),
        "blind_spots": reports.platform_blind_spots(hours, reports.blind_spots(hours.sparkSession)),
        "drift": reports.drift_register(by_case, F.current_timestamp()),
    }


def reports_of(artifacts: DataFrame, coverage: DataFrame, folder: str | None = None, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Result tables of scored artifacts; with ``runs`` (what the registry says of its extractors) those of governance too.

    The hourly cube is written once; footprints, episodes and case tables are
    read from it, the tables with one row per artifact from the artifacts.
    """
    hours = stage(cube.hourly_cube(artifacts), "hours", folder)
    found = stage(episodes.episode_remarks(episodes.episode_confidence(episodes.episode_facts(hours), coverage)),
                  "episodes", folder)
    return {
        "footprints": reports.footprints(hours, coverage),
        "platform_summary": reports.platform_summary(hours),
        "episodes": found,
        "episode_members": episodes.episode_members(artifacts),
        "artifacts": episodes.promote_claims(artifacts, found),
        "timeline": timeline.timeline(artifacts),
        "matrix": reports.matrix(artifacts, coverage),
        "exhibits": reports.exhibits(artifacts),
        "case_totals": reports.case_totals(hours),
        "requirements": reports.requirement_status(hours, found),
        "confidence_classes": reports.confidence_classes(found),
        "tamper": reports.tamper_counts(hours),
        **(governance_of(hours, coverage, runs) if runs is not None else {}),
    }


def analyze(spark: SparkSession, inputs: Inputs, coverage: DataFrame, folder: str | None = None,
            rules: RuleBook | None = None, case_os: DataFrame | None = None,
            registry: Registry = DEFAULT) -> dict[str, DataFrame]:
    """Runs the extractors over the input tables and builds every result table.

    ``coverage``: one row per case with image_type, full_disk_available and
    carving_enabled.  ``folder`` is used where ``spark.checkpoint.dir`` is not set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or folder
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or pass one")
    raw, runs = registry.run_all(spark, inputs, rules or default_rules(), root, case_os)
    numbered = stage(with_seq(raw), "artifacts_raw", root)
    scored = stage(score_artifacts(numbered, coverage), "artifacts", root)
    out = {**reports_of(scored, coverage, root, runs), "runs": runs}
    if all(name in inputs for name in TOOL_INPUTS):
        entries = stage(tools.checklist(*(inputs[name] for name in TOOL_INPUTS)), "checklist", root)
        out.update(checklist=entries, tool_coverage=tools.coverage_ledger(entries), tool_gaps=tools.gap_ledger(entries))
    return out
