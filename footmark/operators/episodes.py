"""Episodes: time-bounded use of one platform by one profile, with confidence and claim level.

Everything about an episode is computed from the hourly cube: one shuffle to
build the cube, one to bring the hours of a (case, platform, profile) together.
The long lists of record ids are not gathered into arrays, because one episode
may hold much of a case; ``episode_members`` gives them as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.functions.matching import distinct
from footmark.operators.cube import (
    DIMENSIONS, NO_TIME, evidence_letter, most_frequent, number_hours, session_numbers)
from footmark.operators.spread import join_back, with_salt

KEYS = ["case_id", "suspected_platform", "user_profile"]
EPISODE = [*KEYS, "session_no"]


def _texts(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose test holds."""
    items = [F.when(test, text if isinstance(text, Column) else F.lit(text)) for test, text in pairs]
    return F.array_compact(F.array(*items))


def _total(test: Column, n: str = "n") -> Column:
    return F.sum(F.when(test, F.col(n)).otherwise(F.lit(0).cast("bigint")))


def _known(column: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col(column) != V.UNKNOWN, F.col(column))))


def episode_facts(cube: DataFrame) -> DataFrame:
    """One row per (case, platform, profile, session) with counts, window, sets and flags."""
    sessions = session_numbers(cube.where(F.col("suspected_platform") != V.UNKNOWN), KEYS)
    direct = F.col("classification") == "Direct"
    family = F.col("artifact_family")
    # Grouping by the closed lists first keeps the array for the two modes short.
    parts = sessions.groupBy(*EPISODE, *[d for d in DIMENSIONS if d not in [*KEYS, "hour"]]).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_timed", "n_image_word", "n_review_word", "n_search_word")],
        F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"), F.min("first").alias("first"),
        F.max("max_rank").alias("max_rank"),
        *[F.max(c).alias(c) for c in ("voice", "link", "asset")])
    facts = parts.groupBy(*EPISODE).agg(
        F.sum("n").alias("artifacts"), _total(direct).alias("direct"), F.sum("n_timed").alias("timed"),
        distinct("artifact_family").alias("families"),
        distinct(F.when(F.col("source_class") != V.UNKNOWN, F.col("source_class"))).alias("known_classes"),
        distinct("source_class").alias("all_classes"),
        F.min("min_at").alias("start_us"), F.max("max_at").alias("end_us"),
        F.collect_list(F.struct(F.col("suspected_model").alias("model"), F.col("access_mode").alias("mode"),
                                "n", "first")).alias("mix"),
        _known("acquisition_source").alias("acquisition_sources"), _known("platform_surface").alias("surfaces"),
        F.max("voice").alias("voice_related"), F.max("link").alias("link_related"), F.max("asset").alias("asset_related"),
        _total(family.isin(V.HISTORY, V.COOKIES)).alias("c0"), _total(family == V.DOWNLOADS).alias("c1"),
        F.sum("n_image_word").alias("c2"), _total(family == V.CONTENT).alias("c3"),
        _total(family == V.NATIVE).alias("c4"), F.sum("n_search_word").alias("c5"),
        F.sum("n_review_word").alias("review"), _total(direct, "n_review_word").alias("review_direct"),
        F.max(F.when(F.col("persistence_state") == V.INTACT, 3).when(F.col("persistence_state") == V.PARTLY, 2)
              .when(F.col("persistence_state") == V.WEAKLY, 1).otherwise(0)).alias("persistence_rank"),
        F.array_sort(F.collect_set("evidence_class")).alias("evidence_classes"),
    )
    counters = [F.col(f"c{i}") for i in range(6)]
    top = F.greatest(*counters)
    activity = F.when(top == 0, V.NO_ACTIVITY)
    for name, counter in zip(V.ACTIVITIES, counters):
        activity = activity.when(counter == top, name)
    none, direct_state, several, one = V.IMAGE_REVIEW
    states = F.array(*[F.lit(s) for s in (V.NOT_OBSERVED, V.WEAKLY, V.PARTLY, V.INTACT)])
    return facts.select(
        *EPISODE, "artifacts", "direct", (F.col("artifacts") - F.col("direct")).alias("inferred"), "timed",
        "families", F.when(F.col("known_classes") > 0, F.col("known_classes")).otherwise(F.col("all_classes"))
        .alias("source_classes"),
        "start_us", "end_us", most_frequent(F.col("mix"), "model", "first").alias("model"),
        most_frequent(F.col("mix"), "mode", "first").alias("access_mode"), activity.alias("activity"),
        F.when(F.col("review") == 0, none).when(F.col("review_direct") > 0, direct_state)
        .when(F.col("review") >= 2, several).otherwise(one).alias("image_review"),
        F.element_at(states, F.col("persistence_rank") + 1).alias("persistence"),
        "acquisition_sources", "surfaces", "voice_related", "link_related", "asset_related", "evidence_classes",
    )


def episode_confidence(facts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Adds readiness, score in hundredths, level, claim level and confidence class."""
    sufficient = coverage.select("case_id", (~F.col("image_type").isin(V.PARTIAL_IMAGES)).alias("covered"))
    joined = facts.join(sufficient, "case_id", "left").withColumn(
        "coverage_sufficient", F.coalesce("covered", F.lit(True))).drop("covered")
    families, classes, direct = F.col("families"), F.col("source_classes"), F.col("direct")
    ready = (families >= 2) | ((direct >= 1) & (F.col("timed") >= 2))
    score = (
        F.when(families >= 3, 25).when(families >= 2, 15).when(families >= 1, 5).otherwise(0)
        + F.when(classes >= 3, 15).when(classes >= 2, 10).when(classes >= 1, 3).otherwise(0)
        + F.when(F.col("timed") > 0, 15).otherwise(0)
        + F.when(F.col("coverage_sufficient"), 10).otherwise(0)
        + F.when(direct >= 2, 20).when(direct >= 1, 12).otherwise(0)
        + F.when(ready & (families >= 2), 10).otherwise(0)
        + F.when(F.col("persistence") == V.INTACT, 5).when(F.col("persistence") == V.PARTLY, 3).otherwise(0)
    )
    level = F.when(F.col("score") >= 70, "High").when(F.col("score") >= 40, "Moderate").when(
        F.col("score") >= 20, "Low").otherwise("Insufficient")
    firm = F.col("event_confidence").isin("High", "Moderate")
    claim = F.when(firm & F.col("ready") & F.col("coverage_sufficient"), 4).when(F.col("ready"), 3).otherwise(2)
    observed, corroborated, suspected, insufficient = V.CONFIDENCE_CLASSES
    return (
        joined.withColumn("ready", ready).withColumn("score", score.cast("int"))
        .withColumn("event_confidence", level).withColumn("claim_rank", claim)
        .withColumn("claim_level", claim_name(F.col("claim_rank")))
        .withColumn("present", presence())
        .withColumn("confidence_class", F.when(
            (F.col("event_confidence") == "High") & (direct >= 2), observed).when(firm & F.col("ready"), corroborated)
            .when((direct >= 1) | (F.col("artifacts") >= 2), suspected).otherwise(insufficient))
    )


def presence() -> Column:
    """Platform presence: two artifacts that differ in family, are both direct, or differ in evidence class."""
    return (F.col("artifacts") >= 2) & (
        (F.col("families") >= 2) | (F.col("direct") >= 2) | (F.size("evidence_classes") >= 2))


def claim_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(V.CLAIM_LEVELS[i]) for i in (1, 2, 3, 4)]), rank)


# --- fixed values: texts that accompany an episode -----------------------------
BOUNDARY_TEXTS = {
    "always": "This reconstruction describes observable AI-system interaction; it does not infer belief, "
              "trust, acceptance, reliance, or investigative intent.",
    "untimed": "Time-window boundaries could not be established from the available timestamps.",
    "no_model": "Model-level attribution was not possible; finding is limited to platform-level attribution "
                "(Rule 3).",
}
CAVEAT_TEXTS = {
    "partial": "Evidence coverage is partial; negative findings must be interpreted as scope-limited (Rule 2).",
    "window": "Reported time window is approximate and derived from artifact timestamps, not from direct "
              "session-start/session-end records.",
    "insufficient": "Insufficient support within examined scope does not mean the platform was not used "
                    "(Rule 6).",
    "weak": "Weak or absent persistence is reported as a preservation effect, not as evidence of concealment "
            "(Rule 7).",
    "narrative": "Any narrative text in this report is explanatory only; evidentiary facts are the artifacts, "
                 "exhibits, and scoring decisions (Rule 10).",
    "one_family": "All corroborating artifacts belong to a single artifact family; claim level is limited by "
                  "corroboration diversity (Rule 9).",
    "one_class_head": "All evidence originates from a single evidence class (",
    "one_class_tail": "); higher claim levels require independent evidence classes.",
    "presence_only": "Evidence is limited to presence/installation/configuration; no usage, output, or "
                     "attribution evidence was identified.",
    "capped": "Evidence coverage is partial; claim level capped at Level 3 (Episode Reconstruction) per Rule 2.",
}
ALTERNATIVE_TEXTS = {
    "one_family": "Single artifact-family evidence could result from automated browser sync, shared device, or "
                  "background process.",
    "inferred": "All evidence is inferred; platform interaction could be explained by third-party redirects or "
                "advertising beacons.",
}


def episode_remarks(episodes: DataFrame) -> DataFrame:
    """Adds boundaries, caveats and alternatives as arrays of texts."""
    timed, partial = F.col("timed") > 0, ~F.col("coverage_sufficient")
    several, classes = F.col("artifacts") >= 2, F.col("evidence_classes")
    usage = F.array(*[F.lit(x) for x in "DEF"])
    letter = F.coalesce(F.nullif(F.array_join(classes, ""), F.lit("")), F.lit("A"))
    c = CAVEAT_TEXTS
    yes = F.lit(True)
    return episodes.withColumns({
        "boundaries": _texts((yes, BOUNDARY_TEXTS["always"]), (~timed, BOUNDARY_TEXTS["untimed"]),
                             (F.col("model") == V.UNKNOWN, BOUNDARY_TEXTS["no_model"])),
        "caveats": _texts(
            (partial, c["partial"]), (timed, c["window"]),
            (F.col("event_confidence") == "Insufficient", c["insufficient"]),
            (F.col("persistence").isin(V.WEAKLY, V.NOT_OBSERVED), c["weak"]), (yes, c["narrative"]),
            ((F.col("families") <= 1) & several, c["one_family"]),
            ((F.size(classes) <= 1) & several,
             F.concat(F.lit(c["one_class_head"]), letter, F.lit(c["one_class_tail"]))),
            (~F.arrays_overlap(classes, usage), c["presence_only"]), (partial, c["capped"])),
        "alternatives": _texts((F.col("families") == 1, ALTERNATIVE_TEXTS["one_family"]),
                               (F.col("direct") == 0, ALTERNATIVE_TEXTS["inferred"])),
    })


def episodes(cube: DataFrame, coverage: DataFrame) -> DataFrame:
    """The hourly cube to episodes with all derived columns."""
    return episode_remarks(episode_confidence(episode_facts(cube), coverage))


def episode_sessions(artifacts: DataFrame) -> DataFrame:
    """Artifacts of known platforms with their ``session_no``, joined back by hour with salted keys."""
    rows = with_salt(artifacts.where(F.col("suspected_platform") != V.UNKNOWN).withColumn(
        "hour", F.date_trunc("hour", "ts")))
    per_salt = rows.groupBy(*KEYS, "hour", "salt").agg(
        F.min(F.unix_micros("ts")).alias("min_at"), F.max(F.unix_micros("ts")).alias("max_at"))
    hours = per_salt.groupBy(*KEYS, "hour").agg(
        F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"), F.collect_set("salt").alias("salts"))
    numbered = number_hours(hours, KEYS).select(*KEYS, "hour", "session_no", "salts")
    return join_back(rows, numbered, [*KEYS, "hour"]).drop("hour", "salt")


def episode_members(artifacts: DataFrame) -> DataFrame:
    """One row per artifact of an episode, with the role it plays there."""
    return episode_sessions(artifacts).select(
        *EPISODE, "record_id", "seq", "ts",
        F.when(F.col("classification") == "Direct", "direct").otherwise("corroborating").alias("role"))


def promote_claims(artifacts: DataFrame, episode_rows: DataFrame) -> DataFrame:
    """Adds ``claim_level`` to artifacts: their episode's level, or the first for unknown platforms.

    The level travels with the hour table, so the artifacts are joined once and with salted keys.
    """
    rows = with_salt(artifacts.withColumn("hour", F.date_trunc("hour", "ts")))
    known = rows.where(F.col("suspected_platform") != V.UNKNOWN)
    per_salt = known.groupBy(*KEYS, "hour", "salt").agg(
        F.min(F.unix_micros("ts")).alias("min_at"), F.max(F.unix_micros("ts")).alias("max_at"))
    hours = per_salt.groupBy(*KEYS, "hour").agg(
        F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"), F.collect_set("salt").alias("salts"))
    levels = number_hours(hours, KEYS).join(
        episode_rows.select(*EPISODE, "claim_rank"), EPISODE).select(*KEYS, "hour", "claim_rank", "salts")
    joined = join_back(rows, levels, [*KEYS, "hour"])
    return joined.withColumn("claim_level", claim_name(F.coalesce("claim_rank", F.lit(1)))).drop(
        "claim_rank", "hour", "salt")
