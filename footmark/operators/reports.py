"""Tables per case: summaries, footprints, matrix, exhibits, totals, coverage, requirements, governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.matching import contains_any, distinct
from footmark.operators.cube import most_frequent, session_starts
from footmark.operators.scoring import level_of, rank_of

PLATFORM = ["case_id", "suspected_platform"]


def _total(test: Column, n: str = "n") -> Column:
    return F.sum(F.when(test, F.col(n)).otherwise(F.lit(0).cast("bigint")))


def _sorted_set(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def platform_summary(cube: DataFrame) -> DataFrame:
    """Totals, window, families and access modes per platform; Unknown is left out."""
    kind = F.col("classification")
    return cube.where(F.col("suspected_platform") != V.UNKNOWN).groupBy(*PLATFORM).agg(
        F.sum("n").alias("total"), _total(kind == "Direct").alias("direct"),
        _total(kind == "Inferred").alias("inferred"), F.min("min_at").alias("earliest_us"),
        F.max("max_at").alias("latest_us"), _sorted_set("artifact_family").alias("families"),
        _sorted_set("access_mode").alias("access_modes"))


# --- fixed values: caveats of a footprint ----------------------------------------
FOOTPRINT_CAVEATS = {
    "inferred": "No directly observed evidence; all findings are inferred.",
    "no_model": "Model-level attribution not possible; platform-level only.",
    "not_full": "Evidence source may not contain all relevant artifacts.",
}


def footprints(cube: DataFrame, coverage: DataFrame) -> DataFrame:
    """What is known about each platform of a case, on one row."""
    sorts = ["classification", "artifact_family", "suspected_model", "access_mode"]
    sums = ["n", "n_timed", "n_upload_word", "n_prompt_word", "n_response_word"]
    ends = [F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"), F.min("min_seq").alias("min_seq"),
            F.max("max_rank").alias("max_rank")]
    # One pass over the cube gives both tables: one row per combination of closed-list values, so that the array for the
    # modes stays short, and one per hour, so that the window for the sessions holds no more than a platform's hours.
    both = cube.where(F.col("suspected_platform") != V.UNKNOWN).groupingSets(
        [[*PLATFORM, *sorts], [*PLATFORM, "hour"]], *PLATFORM, "hour", *sorts).agg(
        F.grouping("hour").alias("of_sorts"), *[F.sum(c).alias(c) for c in sums], *ends)
    # Rows of an hour give their session starts only; their sums are those of the combinations once more.
    counted = F.col("of_sorts") == 1
    parts = session_starts(both, [*PLATFORM, "of_sorts"]).withColumns({c: F.when(counted, F.col(c)) for c in sums})
    kind, family = F.col("classification"), F.col("artifact_family")
    wide = parts.groupBy(*PLATFORM).agg(
        F.sum("n").alias("total"), _total(kind == "Direct").alias("direct"),
        _total(kind == "Inferred").alias("inferred"), F.min("min_at").alias("earliest_us"),
        F.max("max_at").alias("latest_us"),
        F.when(F.sum("n_timed") > 0, F.count("starts_at") + 1).otherwise(0).alias("sessions"),
        F.sum("n_upload_word").alias("image_indicators"),
        _total(family.isin(V.DOWNLOADS, V.CONTENT)).alias("export_indicators"),
        F.sum("n_prompt_word").alias("prompt_remnants"), F.sum("n_response_word").alias("response_remnants"),
        F.max("max_rank").alias("best_rank"),
        F.collect_list(F.when(counted, F.struct(F.col("suspected_model").alias("model"), F.col("access_mode").alias("mode"), "n",
                                                F.col("min_seq").alias("first")))).alias("mix"))
    full = coverage.select("case_id", "full_disk_available")
    text = FOOTPRINT_CAVEATS
    return (
        wide.withColumn("model", most_frequent(F.col("mix"), "model", "first"))
        .withColumn("access_mode", most_frequent(F.col("mix"), "mode", "first"))
        .withColumn("overall_confidence", level_of(F.col("best_rank")))
        .join(full, "case_id", "left")
        .withColumn("caveats", F.array_compact(F.array(
            F.when(F.col("direct") == 0, text["inferred"]), F.when(F.col("model") == V.UNKNOWN, text["no_model"]),
            F.when(~F.coalesce("full_disk_available", F.lit(True)), text["not_full"]))))
        .drop("mix", "best_rank", "full_disk_available")
    )


def top_confidence(cube: DataFrame) -> DataFrame:
    """Platform table of the report: totals, direct, all others, highest confidence."""
    return cube.where(F.col("suspected_platform") != V.UNKNOWN).groupBy(*PLATFORM).agg(
        F.sum("n").alias("total"), _total(F.col("classification") == "Direct").alias("direct"),
        _total(F.col("classification") != "Direct").alias("other"),
        level_of(F.max("max_rank")).alias("highest_confidence"))


def evidence_value() -> Column:
    direct = F.col("classification") == "Direct"
    return (F.when(direct & (F.col("confidence") == "High"), "Strong").when(direct, "Moderate")
            .when(F.col("confidence").isin("Moderate", "High"), "Supportive").otherwise("Weak"))


def relevance() -> Column:
    subtype = F.lower(F.coalesce("artifact_subtype", F.lit("")))
    indicator = F.lower(F.coalesce("extracted_indicator", F.lit("")))
    col = F.when(contains_any(indicator, V.RELEVANCE_IMAGE_WORDS), V.RELEVANCE_IMAGE).when(
        contains_any(subtype, ["prompt", "response"]), V.RELEVANCE_INTERACTIVE)
    for family, text in V.RELEVANCE_BY_FAMILY.items():
        col = col.when(F.col("artifact_family") == family, text)
    return col.otherwise(V.RELEVANCE_OTHER)


def matrix(artifacts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Comparison matrix: one row per artifact, no shuffle besides the one-row-per-case coverage."""
    persistence = F
    for family, text in V.PERSISTENCE_RATING.items():
        persistence = persistence.when(F.col("artifact_family") == family, text)
    caveat = F.concat_ws(
        " ", F.when(~F.col("full_disk_available"), V.NOT_FULL_DISK), F.when(~F.col("carving_enabled"), V.NO_CARVING))
    facts = coverage.select("case_id", caveat.alias("coverage_caveat"))
    model = F.when(F.col("suspected_model") != V.UNKNOWN, F.concat(F.lit(" / "), "suspected_model"))
    timed = F.col("ts").isNotNull()
    return artifacts.join(facts, "case_id", "left").select(
        "case_id", "record_id", "seq", "suspected_platform", "user_profile",
        F.concat("suspected_platform", F.coalesce(model, F.lit(""))).alias("tool_or_model"), "access_mode",
        "artifact_family", "artifact_type", "artifact_path", evidence_value().alias("evidence_value"),
        F.when(timed & F.col("tz_norm"), "Good - UTC normalized")
        .when(timed, "Fair - timestamp present, normalization uncertain").otherwise("Absent").alias("time_quality"),
        persistence.otherwise(V.UNKNOWN).alias("persistence_text"), relevance().alias("relevance"),
        "classification", "confidence", F.coalesce("coverage_caveat", F.lit("")).alias("coverage_caveat"),
        F.coalesce("notes", F.lit("")).alias("comments"))


BUCKET_BITS = 16


def numbered(artifacts: DataFrame, order: str = "seq") -> DataFrame:
    """Adds a running number per case in ``seq`` order, without one task per case.

    Rows are numbered inside buckets of neighbouring ``seq`` values; what comes
    before a bucket is a running sum over bucket counts.
    """
    rows = artifacts.withColumn("bucket", F.shiftright(F.col(order), BUCKET_BITS))
    counts = rows.groupBy("case_id", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("case_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("case_id", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy("case_id", "bucket").orderBy(order)
    return (
        rows.withColumn("inside", F.row_number().over(inside)).join(before, ["case_id", "bucket"])
        .withColumn("exhibit_no", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")
    )


def exhibits(artifacts: DataFrame) -> DataFrame:
    """Numbered exhibits of a case."""
    family, platform = F.col("artifact_family"), F.col("suspected_platform")
    kind = F.coalesce(F.nullif(F.col("artifact_type"), F.lit("")), family)
    return numbered(artifacts).select(
        "case_id", "exhibit_no", "record_id", F.concat(family, F.lit(" — "), platform).alias("title"),
        F.concat(kind, F.lit(" artifact indicating "), platform, F.lit(" access")).alias("description"),
        F.coalesce(F.nullif(F.col("artifact_path"), F.lit("")), F.lit("(embedded/parsed)")).alias("evidence_path"),
        family, platform, "confidence", F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("exhibit_time"),
        "extracted_indicator", "notes")


def first_exhibits(exhibit_rows: DataFrame, most: int = 10) -> DataFrame:
    """First exhibits of each platform, as the report prints them."""
    w = Window.partitionBy(*PLATFORM).orderBy("exhibit_no")
    return exhibit_rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def image_findings(artifacts: DataFrame, exhibit_rows: DataFrame) -> DataFrame:
    """Artifacts with an image-review word, with the first exhibit of the same path and platform."""
    rows = artifacts.where(contains_any(F.lower(F.coalesce("extracted_indicator", F.lit(""))), V.IMAGE_REVIEW_WORDS))
    first = exhibit_rows.groupBy(*PLATFORM, "evidence_path").agg(F.min("exhibit_no").alias("exhibit_no"))
    path = F.col("artifact_path")
    return rows.withColumn("evidence_path", path).join(first, [*PLATFORM, "evidence_path"], "left").select(
        "case_id", "record_id", "suspected_platform", F.col("extracted_indicator").alias("finding"),
        "confidence", "exhibit_no")


def event_exhibits(events: DataFrame, exhibit_rows: DataFrame) -> DataFrame:
    """Timeline events with the number of their exhibit."""
    return events.join(exhibit_rows.select("case_id", "record_id", "exhibit_no"), ["case_id", "record_id"], "left")


def case_totals(cube: DataFrame) -> DataFrame:
    """Artifact counts per case, per platform and per family, with the time span, in one pass."""
    return cube.groupingSets(
        [["case_id"], ["case_id", "suspected_platform"], ["case_id", "artifact_family"]],
        "case_id", "suspected_platform", "artifact_family",
    ).agg(
        F.sum("n").alias("artifacts"), F.sum("n_timed").alias("timed"), F.min("min_at").alias("earliest_us"),
        F.max("max_at").alias("latest_us"),
        F.grouping_id("case_id", "suspected_platform", "artifact_family").alias("grouping"),
    ).select(
        "case_id",
        F.when(F.col("grouping") == 3, "case").when(F.col("grouping") == 1, "platform").otherwise("family").alias("level"),
        F.coalesce("suspected_platform", "artifact_family", F.lit("all")).alias("value"),
        "artifacts", "timed", "earliest_us", "latest_us")


def counts_by(findings: DataFrame, column: str) -> DataFrame:
    """Counts of one column, most frequent first."""
    return findings.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def confidence_classes(episode_rows: DataFrame) -> DataFrame:
    """Episodes per case and confidence class."""
    return episode_rows.groupBy("case_id", "confidence_class").agg(F.count("*").alias("episodes"))


# --- fixed values: limitations of a collection -----------------------------------
LIMITATION_PARTIAL = ("Evidence source is a triage or partial collection. Negative findings may be due to "
                      "limited collection scope.")
LIMITATION_NO_PROFILE = "No user profiles detected. Analysis scope is limited."


def coverage_rollup(runs: DataFrame, cube: DataFrame, coverage: DataFrame) -> DataFrame:
    """Extractors by status, families found and missing, limitations, per case.

    ``runs``: case_id, extractor, status, a few hundred rows per case.
    ``coverage``: case_id, image_type, profiles.
    """
    def by_status(status: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("extractor"))))

    ran = runs.groupBy("case_id").agg(
        by_status("Success").alias("succeeded"), by_status("Failed").alias("failed"),
        by_status("Not Applicable").alias("not_applicable"), by_status("Stub (Not Implemented)").alias("stubs"))
    families = cube.groupBy("case_id").agg(_sorted_set("artifact_family").alias("families_found"))
    expected = F.array(*[F.lit(f) for f in sorted(V.EXPECTED_FAMILIES)])
    none = F.array().cast("array<string>")
    joined = coverage.join(ran, "case_id", "left").join(families, "case_id", "left")
    found = F.coalesce("families_found", none)
    return joined.select(
        "case_id", "image_type", *[F.coalesce(c, none).alias(c) for c in ("succeeded", "failed", "not_applicable", "stubs")],
        found.alias("families_found"), F.array_except(expected, found).alias("families_missing"),
        F.array_compact(F.array(
            F.when(F.col("image_type").isin(V.PARTIAL_IMAGES), LIMITATION_PARTIAL),
            F.when(F.col("profiles") == 0, LIMITATION_NO_PROFILE))).alias("limitations"))


def union_ledgers(*ledgers: DataFrame) -> DataFrame:
    """Coverage, gap and failure ledgers of all runs as one table."""
    out = ledgers[0]
    for ledger in ledgers[1:]:
        out = out.unionByName(ledger, allowMissingColumns=True)
    return out


TAMPER_TYPES = {"cleanup_tools": "Cleanup Tool Execution", "history_gaps": "History Gap Detected",
                "time_anomalies": "Timestamp Anomaly", "stripped_images": "Metadata-Stripped AI Image"}


def tamper_counts(cube: DataFrame, parser: str = "TamperDetector") -> DataFrame:
    """Tamper indicators per case and type."""
    rows = cube if parser is None else cube.where(F.col("parser_used") == parser)
    return rows.groupBy("case_id").agg(
        *[_total(F.col("artifact_type") == t).alias(name) for name, t in TAMPER_TYPES.items()])


def requirement_status(cube: DataFrame, episode_rows: DataFrame) -> DataFrame:
    """Status of the nine requirements per case, from one conditional aggregate over the cube."""
    first_word = F.upper(F.split("artifact_family", " ")[0])
    group = F.when(first_word == "USER", "CONTENT").otherwise(first_word)
    parser, kind = F.col("parser_used"), F.col("artifact_type")

    def seen(test: Column) -> Column:
        return F.coalesce(F.max(test), F.lit(False))

    counters = cube.groupBy("case_id").agg(
        distinct(F.when(group.isin("BROWSER", "OS", "CONTENT", "NATIVE"), group)).alias("groups"),
        seen(parser == "MemoryExtractor").alias("memory"), seen(parser == "NetworkExtractor").alias("network"),
        F.sum("n").alias("artifacts"), F.sum("n_timed").alias("timed"), seen(parser == "ExportReplay").alias("exported"),
        seen(F.col("suspected_platform") != V.UNKNOWN).alias("footprint"),
        seen(F.col("suspected_model") != V.UNKNOWN).alias("model"), seen(parser == "ManifestExtractor").alias("manifest"),
        seen(parser == "TamperDetector").alias("tamper"), distinct("artifact_family").alias("families"),
        seen(parser.isin("ExtensionExtractor", "ToolChainExtractor")
             | kind.isin("ChatGPT Plugin Usage", "ChatGPT Plugin/Custom GPT")).alias("chained"))
    per_case = episode_rows.groupBy("case_id").agg(F.count("*").alias("episodes"))
    joined = counters.join(per_case, "case_id", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    sources = F.col("groups") + F.col("memory").cast("int") + F.col("network").cast("int")
    has_episode = F.col("episodes") > 0
    full, partial, gap = V.FULL, V.PARTIAL, V.GAP
    status = {
        "FR-1": F.when(sources >= 3, full).when((sources >= 2) | (F.col("artifacts") > 0), partial).otherwise(gap),
        "FR-2": F.when(F.col("exported") & has_episode, full).when(F.col("timed") > 0, partial).otherwise(gap),
        "FR-3": F.when(F.col("model") | F.col("footprint"), partial).otherwise(gap),
        "FR-4": F.when(F.col("manifest"), full).otherwise(partial),
        "FR-5": F.lit(partial),
        "FR-6": F.when(F.col("tamper") | (F.col("families") > 2), full).otherwise(partial),
        "FR-7": F.when(F.col("chained"), full).otherwise(partial),
        "FR-8": F.lit(full),
        "FR-9": F.lit(full),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("requirement"), F.lit(t).alias("title"), status[i].alias("status"))
                     for i, t in V.REQUIREMENTS])
    return joined.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")


def blind_spots(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """Known blind spots per platform; own rows (platform, blind_spot) replace those of their platform."""
    base = spark.createDataFrame(V.BLIND_SPOTS, "platform string, blind_spot string")
    if own is None:
        return base
    return base.join(own.select("platform").distinct(), "platform", "left_anti").unionByName(own)


def capabilities(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """Capability matrix: one boolean per feature and the confidence of the profile; own rows win."""
    rows = [(p, *[f in has for f in V.CAPABILITY_FEATURES], c) for p, has, c in V.CAPABILITIES]
    fields = ", ".join(f"{f} boolean" for f in V.CAPABILITY_FEATURES)
    base = spark.createDataFrame(rows, f"platform string, {fields}, confidence string")
    if own is None:
        return base
    return base.join(own.select("platform").distinct(), "platform", "left_anti").unionByName(own)


def with_capability(df: DataFrame, profiles: DataFrame, platform_col: str = "suspected_platform") -> DataFrame:
    """Capabilities joined to rows; a platform without a profile has none, with low confidence."""
    joined = df.join(profiles, df[platform_col] == profiles["platform"], "left").drop("platform")
    fill = {f: F.coalesce(f, F.lit(False)) for f in V.CAPABILITY_FEATURES}
    fill["capability_confidence"] = F.coalesce(F.col("capability_confidence"), F.lit("low"))
    return joined.withColumnRenamed("confidence", "capability_confidence").withColumns(fill)


def platform_blind_spots(cube: DataFrame, spots: DataFrame) -> DataFrame:
    """Blind spots of the platforms of a case; platforms without a profile get a remark instead."""
    seen = cube.where(F.col("suspected_platform") != V.UNKNOWN).select(*PLATFORM).distinct()
    text = F.coalesce("blind_spot", F.concat(
        F.lit(V.NO_PROFILE_HEAD), "suspected_platform", F.lit(V.NO_PROFILE_TAIL)))
    return seen.join(spots, seen["suspected_platform"] == spots["platform"], "left").select(
        *PLATFORM, F.concat(F.lit("["), "suspected_platform", F.lit("] "), text).alias("blind_spot"))


def governance_facts(cube: DataFrame, coverage_rows: DataFrame) -> DataFrame:
    """Facts of the governance record per case.

    ``coverage_rows``: case_id, families_missing, full_disk_available, carving_enabled.
    """
    direct = F.col("classification") == "Direct"
    facts = cube.groupBy("case_id").agg(
        _sorted_set("source_class").alias("source_classes"), _sorted_set("acquisition_source").alias("acquisitions"),
        _sorted_set("platform_surface").alias("surfaces"), _total(direct).alias("direct"), _total(~direct).alias("other"),
        F.array_sort(F.collect_set(F.when(F.col("suspected_platform") != V.UNKNOWN, F.col("suspected_platform"))))
        .alias("platforms"))
    found = F.col("acquisitions")
    gaps = F.array_compact(F.array(
        F.when(~F.array_contains(found, "Provider Export"), "provider_export"),
        F.when(~F.arrays_overlap(found, F.array(F.lit("Transcript Capture"), F.lit("Voice Capture"))), "voice")))
    spots = F.concat(
        F.array_compact(F.array(F.when(~F.col("full_disk_available"), "not_full_disk"),
                                F.when(~F.col("carving_enabled"), "no_carving"))),
        F.transform("families_missing", lambda f: F.concat(F.lit("missing: "), f)))
    return facts.join(coverage_rows, "case_id", "left").select(
        "case_id", "source_classes", "surfaces", "platforms", "direct", "other", gaps.alias("acquisition_gaps"),
        spots.alias("blind_spots"), "families_missing")


def drift_register(runs: DataFrame, as_of: Column) -> DataFrame:
    """One entry per extractor version of a case."""
    return runs.groupBy("case_id", "extractor").agg(F.max("version").alias("version")).select(
        "case_id", F.col("extractor").alias("component"), "version", F.lit("built-in").alias("rule_version"),
        as_of.cast("date").alias("last_validated"), F.lit("Partially Validated").alias("status"))


def validation_results(cases: DataFrame, cube: DataFrame) -> DataFrame:
    """Expected against actual platforms and counts.

    ``cases``: case_id, phase, expected array<string>, min_count, negative, allowed.
    """
    actual = cube.groupBy("case_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("suspected_platform") != V.UNKNOWN, F.col("suspected_platform"))))
        .alias("actual"), F.sum("n").alias("artifacts"))
    joined = cases.join(actual, "case_id", "left").withColumns({
        "artifacts": F.coalesce("artifacts", F.lit(0)),
        "actual": F.coalesce("actual", F.array().cast("array<string>"))})
    met = (F.size(F.array_except("expected", "actual")) == 0) & (F.col("artifacts") >= F.col("min_count"))
    return joined.withColumn("passed", F.when(F.col("negative"), F.col("artifacts") <= F.col("allowed")).otherwise(met))


def validation_summary(results: DataFrame) -> DataFrame:
    """All cases on one row: passed, failed, phases and overall state."""
    passed, failed = F.count_if("passed"), F.count_if(~F.col("passed"))
    return results.agg(
        F.count("*").alias("total"), passed.alias("passed"), failed.alias("failed"),
        F.array_sort(F.collect_set("phase")).alias("phases"),
        F.when(F.count("*") == 0, "Not Validated").when(failed == 0, "Validated")
        .when(passed > 0, "Partially Validated").otherwise("Not Validated").alias("state"))


def store_health(partitions: DataFrame) -> DataFrame:
    """Health of the store and access tier per evidence, from its partitions (evidence_id, scheme, health)."""
    def any_is(state: str) -> Column:
        return F.bool_or(F.col("health") == state)

    flags = partitions.groupBy("evidence_id").agg(
        F.bool_and(F.col("health") == "Intact").alias("all_intact"), any_is("Intact").alias("intact"),
        any_is("Degraded").alias("degraded"), any_is("Corrupt").alias("corrupt"),
        F.bool_or(~F.col("scheme").isin("None Detected", V.UNKNOWN)).alias("has_scheme"))
    tier = (F.when(F.col("all_intact"), "Full Forensic Access")
            .when(F.col("intact") | F.col("degraded"), "Partial Filesystem Access").otherwise("Raw Stream Only"))
    raw = ~F.col("intact") & ~F.col("degraded")
    health = (
        F.when(F.col("all_intact"), "Intact").when(raw & ~F.col("has_scheme"), "Carving Only")
        .when(F.col("intact"), "Degraded").when(F.col("degraded"), "Partially Readable")
        .when(F.col("corrupt"), "Corrupt").otherwise(V.UNKNOWN))
    return flags.select("evidence_id", health.alias("health"), tier.alias("tier"))


def recovery_audit(blobs: DataFrame, hits: DataFrame, partitions: DataFrame) -> DataFrame:
    """Number of blobs, hits and partitions per evidence; each source is counted before it is joined."""
    parts = [df.groupBy("evidence_id").agg(F.count("*").alias(name))
             for df, name in ((blobs, "carved"), (hits, "raw_hits"), (partitions, "partitions"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "evidence_id", "full")
    names = ["carved", "raw_hits", "partitions"]
    filled = out.select("evidence_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    mode = {"carved": "signature_carving", "raw_hits": "raw_scan", "partitions": "partition_scan"}
    return filled.withColumn("modes", F.array_compact(F.array(
        *[F.when(F.col(n) > 0, mode[n]) for n in ("partitions", "carved", "raw_hits")])))


def filter_artifacts(artifacts: DataFrame, platform: str | None = None, case_id: str | None = None) -> DataFrame:
    """Drill-down by platform and case; both reach the scan of a stored table."""
    if case_id is not None:
        artifacts = artifacts.where(F.col("case_id") == case_id)
    return artifacts if platform is None else artifacts.where(F.col("suspected_platform") == platform)


def level_rank(level: Column) -> Column:
    return rank_of(level)
