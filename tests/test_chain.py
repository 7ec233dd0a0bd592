"""Enrichment, links, scores, sessions and episodes against hand-made and brute-force results."""

import random
from collections import defaultdict

import pytest
from helpers import artifact, coverage, table
from pyspark.sql import functions as F

from footmark.functions import fixed_values as V
from footmark.operators import cube, enrich, episodes, links, reports, scoring, timeline
from footmark.plans import analysis


def random_rows(seed: int, n: int) -> list[dict]:
    """One platform holds most rows, and most of them lie in one hour."""
    rnd = random.Random(seed)
    families = [V.HISTORY, V.COOKIES, V.DOWNLOADS, V.CONTENT, V.NATIVE]
    rows = []
    for i in range(n):
        at = None if rnd.random() < 0.1 else rnd.choice([rnd.randint(0, 50), rnd.randint(0, 50), rnd.randint(0, 6000)])
        rows.append(artifact(
            i, at=at, suspected_platform=rnd.choice(["ChatGPT"] * 6 + ["Claude", "Gemini", "Unknown"]),
            artifact_family=rnd.choice(families[:rnd.randint(1, 5)]), user_profile=rnd.choice(["u", "u", "v"]),
            classification=rnd.choice(["Direct", "Inferred", "Circumstantial"]),
            suspected_model=rnd.choice(["Unknown", "GPT-4", "GPT-4o"]), access_mode=rnd.choice(["Browser", "Native App", "Unknown"]),
            attribution_layer=rnd.choice(["Platform", "Model"]), tz_norm=rnd.random() < 0.5))
    return rows


def pairwise_links(rows: list[dict]) -> dict[str, list[str]]:
    """Links by comparing each row with its whole group."""
    out = {r["record_id"]: [] for r in rows}
    groups = defaultdict(list)
    for r in rows:
        if r["ts"]:
            groups[r["suspected_platform"], r["ts"].strftime("%Y%m%d%H")].append(r["record_id"])
    for ids in groups.values():
        for i in ids:
            out[i] += [j for j in ids if j != i][:5]
    by_platform = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_platform[r["suspected_platform"]][r["artifact_family"]].append(r["record_id"])
    for families in by_platform.values():
        if len(families) < 2:
            continue
        every = [i for ids in families.values() for i in ids]
        for i in every:
            out[i] += [j for j in [j for j in every if j != i][:3] if j not in out[i]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_pairwise_comparison(spark, seed):
    rows = random_rows(seed, 300)
    got = {r.record_id: [x.id for x in r.links] for r in links.link(table(spark, rows)).collect()}
    assert got == pairwise_links(rows)


def brute_sessions(rows: list[dict]) -> dict[str, int]:
    out, groups = {}, defaultdict(list)
    for r in rows:
        if r["suspected_platform"] != "Unknown":
            groups[r["suspected_platform"], r["user_profile"]].append(r)
    for group in groups.values():
        number, last = 1, None
        for r in sorted((r for r in group if r["ts"]), key=lambda r: (r["ts"], r["seq"])):
            if last and (r["ts"] - last).total_seconds() > 7200:
                number += 1
            last = r["ts"]
            out[r["record_id"]] = number
        out.update({r["record_id"]: 1 for r in group if not r["ts"]})
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_sessions_equal_row_by_row_rule(spark, seed):
    rows = random_rows(seed, 300)
    got = {r.record_id: r.session_no for r in episodes.episode_sessions(table(spark, rows)).collect()}
    assert got == brute_sessions(rows)


def test_gap_of_exactly_two_hours_stays_in_the_session(spark):
    rows = [artifact(1, at=0), artifact(2, at=120), artifact(3, at=240.01), artifact(4)]
    got = {r.seq: r.session_no for r in episodes.episode_sessions(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1}


def test_untimed_rows_alone_form_one_session(spark):
    rows = [artifact(1), artifact(2)]
    got = episodes.episode_facts(cube.hourly_cube(table(spark, rows).withColumn("confidence", F.lit("Low")))).collect()
    assert [(r.session_no, r.artifacts, r.timed) for r in got] == [(1, 2, 0)]


def scored(spark, rows, image="Full Disk Image"):
    return analysis.score_artifacts(table(spark, rows), coverage(spark, image))


def levels(spark, rows, image="Full Disk Image"):
    return {r.seq: (r.initial_confidence, r.confidence) for r in scored(spark, rows, image).collect()}


def test_worked_scores(spark):
    base = scoring.base_confidence(enrich.enrich(table(spark, [
        artifact(1, at=0, tz_norm=True),
        artifact(2, at=0, tz_norm=True, artifact_family=V.COOKIES,
                 notes="Cookie alone is not sufficient to conclude substantive AI use.")])))
    got = {r.seq: (round(r.score, 6), r.confidence) for r in base.collect()}
    assert got == {1: (0.52, "Moderate"), 2: (0.196, "Low")}


def test_boost_needs_three_families_for_high(spark):
    rows = [artifact(1, at=0, tz_norm=True), artifact(2, at=1, tz_norm=True, artifact_family=V.DOWNLOADS),
            artifact(3, at=2, tz_norm=True, artifact_family=V.CONTENT), artifact(4, at=3, tz_norm=True, artifact_family=V.NATIVE)]
    assert levels(spark, rows)[1][1] == "High"
    assert levels(spark, rows[:3])[1][1] == "Moderate"
    assert levels(spark, rows, "Partial Evidence Container")[1][1] == "Moderate"
    capped = {r.seq: r.notes for r in scored(spark, rows, "Triage Collection").collect()}
    assert capped[1].endswith(V.COVERAGE_CAP_NOTE)


def test_recovered_rows_are_never_high(spark):
    rows = random_rows(7, 120)
    for i, r in enumerate(rows):
        r["notes"] = ["[CARVED] x", "[RAW] y"][i % 2]
        r["tz_norm"], r["attribution_layer"], r["classification"] = True, "Model", "Direct"
    got = scored(spark, rows)
    assert got.count() == len(rows)
    assert got.where("confidence = 'High'").count() == 0


def test_persistence_order(spark):
    cases = [(dict(artifact_subtype="carved_PDF"), V.FRAGMENT), (dict(notes="[RAW] x"), V.WEAKLY),
             (dict(artifact_subtype="E01 Binary Scan"), V.WEAKLY), (dict(), V.INTACT), (dict(classification="Inferred"), V.PARTLY),
             (dict(artifact_family=V.COOKIES), V.PARTLY), (dict(artifact_family=V.COOKIES, classification="Inferred"), V.WEAKLY),
             (dict(artifact_family=V.EXECUTION), V.PARTLY), (dict(artifact_family=V.SCREENSHOT), V.INTACT),
             (dict(artifact_family=V.INSTALL), V.NOT_OBSERVED)]
    rows = [artifact(i, **v) for i, (v, _) in enumerate(cases)]
    got = {r.seq: r.persistence_state for r in enrich.enrich(table(spark, rows)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_source_class_is_always_overwritten_and_the_others_only_when_unknown(spark):
    rows = [artifact(1, source_class="Voice-Derived", acquisition_source="Provider Export", platform_surface="Voice Session"),
            artifact(2, artifact_family=V.INSTALL)]
    got = {r.seq: (r.source_class, r.acquisition_source, r.platform_surface) for r in enrich.enrich(table(spark, rows)).collect()}
    assert got == {1: ("Browser-Derived", "Provider Export", "Voice Session"), 2: ("Unknown", "Unknown", "Unknown")}


def episode_rows(spark, rows, image="Full Disk Image"):
    return episodes.episodes(cube.hourly_cube(scored(spark, rows, image)), coverage(spark, image)).collect()


def test_one_artifact_episode_ends_at_level_two(spark):
    got = episode_rows(spark, [artifact(1, at=0)])[0]
    assert (got.claim_rank, got.present, got.confidence_class) == (2, False, "Suspected AI Use")


def test_confidence_class_uses_the_episode_confidence(spark):
    rows = [artifact(1, at=0), artifact(2, at=1, artifact_family=V.DOWNLOADS), artifact(3, at=2, artifact_family=V.CONTENT)]
    got = episode_rows(spark, rows)[0]
    assert (got.event_confidence, got.confidence_class, got.claim_rank) == ("High", "Observed AI Use", 4)
    partial = episode_rows(spark, rows, "Partial Evidence Container")[0]
    assert partial.claim_rank == 3 and episodes.CAVEAT_TEXTS["capped"] in partial.caveats


def test_score_on_the_edge_counts_as_high(spark):
    # 25 + 10 + 15 + 10 + 0 + 10 = 70 hundredths, with nothing for persistence.
    rows = [artifact(i, at=i, artifact_family=f, classification="Inferred", artifact_subtype="raw_x") for i, f in
            enumerate([V.COOKIES, V.EXECUTION, V.CLIPBOARD])]
    got = episode_rows(spark, rows)[0]
    assert (got.score, got.event_confidence) == (70, "High")


def test_mode_ties_go_to_the_first_seen(spark):
    rows = [artifact(1, at=5, suspected_model="GPT-4o"), artifact(2, at=1, suspected_model="GPT-4"), artifact(3, at=2)]
    assert episode_rows(spark, rows)[0].model == "GPT-4"  # first by time within the episode
    found = scored(spark, rows)
    foot = reports.footprints(cube.hourly_cube(found), coverage(spark)).first()
    assert foot.model == "GPT-4o"  # first by seq within the footprint
    assert (foot.total, foot.sessions) == (3, 1)


def test_activity_ties_and_default(spark):
    rows = [artifact(1, at=0, artifact_family=V.DOWNLOADS, extracted_indicator="photo")]
    assert episode_rows(spark, rows)[0].activity == "file download"
    assert episode_rows(spark, [artifact(1, at=0, artifact_family=V.EXECUTION)])[0].activity == V.NO_ACTIVITY


def test_fragment_never_wins_persistence(spark):
    got = episode_rows(spark, [artifact(1, at=0, notes="[CARVED]")])[0]
    assert got.persistence == V.NOT_OBSERVED


def test_members_partition_the_known_artifacts(spark):
    rows = random_rows(11, 200)
    members = episodes.episode_members(table(spark, rows))
    known = sum(r["suspected_platform"] != "Unknown" for r in rows)
    assert members.count() == known == members.select("record_id").distinct().count()


def test_claims_follow_the_episode(spark):
    rows = random_rows(12, 150)
    found = scored(spark, rows)
    eps = episodes.episodes(cube.hourly_cube(found), coverage(spark))
    got = {r.record_id: r.claim_level for r in episodes.promote_claims(found, eps).collect()}
    rank = {(r.suspected_platform, r.user_profile, r.session_no): r.claim_rank for r in eps.collect()}
    session = brute_sessions(rows)
    for r in rows:
        want = 1 if r["suspected_platform"] == "Unknown" else rank[r["suspected_platform"], r["user_profile"], session[r["record_id"]]]
        assert got[r["record_id"]] == V.CLAIM_LEVELS[want]


def test_timeline_marks(spark):
    rows = [artifact(1, at=10, artifact_type="b"), artifact(2, at=0, artifact_type="a"), artifact(3, at=500, artifact_type="c"),
            artifact(4, artifact_type="d")]
    events = timeline.sorted_timeline(timeline.timeline(scored(spark, rows))).collect()
    assert [e.event_type for e in events] == ["[Session 1 Start] a", "[Session 1 End] b", "[Session 2 Start] c"]
    assert events[0].description == "[ChatGPT] (Browser History) a"


def test_history_gaps_need_ten_rows(spark):
    rows = [("s", artifact(i, at=i)["ts"]) for i in range(9)] + [("s", artifact(0, at=60 * 50)["ts"])]
    df = spark.createDataFrame(rows, "source string, ts timestamp")
    got = timeline.history_gaps(df, ["source"]).collect()
    assert [r.gap for r in got] == ["Gap of 2d 1h"]
    assert timeline.history_gaps(df.limit(9), ["source"]).count() == 0


def test_exhibit_numbers_without_gaps(spark):
    rows = [artifact(i * 40_000) for i in range(30)]
    got = reports.exhibits(table(spark, rows).withColumn("confidence", F.lit("Low"))).collect()
    assert sorted(r.exhibit_no for r in got) == list(range(1, 31))


def test_seq_is_filled_and_unique(spark):
    rows = random_rows(13, 100)
    for r in rows:
        r["seq"] = None
    got = [r.seq for r in analysis.with_seq(table(spark, rows)).collect()]
    assert sorted(got) == list(range(1, 101))


def test_same_result_in_every_run(spark):
    rows = random_rows(14, 100)
    first = sorted(map(str, scored(spark, rows).collect()))
    assert first == sorted(map(str, scored(spark, list(reversed(rows))).collect()))


def test_window_of_footprint_sessions_is_small(spark, monkeypatch):
    """The window holds a platform's hours and combinations, not one row for each pair of them."""
    rows = [artifact(h * 30 + m, at=180 * h + m, suspected_model=f"m{m}") for h in range(20) for m in range(30)]
    rows += [artifact(9000, suspected_model="m1"), artifact(9001, suspected_platform="Claude")]
    seen, starts = [], reports.session_starts

    def counted(numbered, keys):
        seen.append(numbered.count())
        return starts(numbered, keys)

    monkeypatch.setattr(reports, "session_starts", counted)
    cubed = cube.hourly_cube(table(spark, rows).withColumn("confidence", F.lit("Low")))
    got = {r.suspected_platform: r for r in reports.footprints(cubed, coverage(spark)).collect()}
    assert (got["ChatGPT"].total, got["ChatGPT"].sessions, got["ChatGPT"].model) == (601, 20, "m1")
    assert (got["Claude"].total, got["Claude"].sessions) == (1, 0)
    assert seen == [20 + 1 + 30 + 2]
