"""A small case from raw tables to reports, and the sinks."""

from datetime import datetime, timezone

import pytest
from helpers import coverage
from pyspark.sql import functions as F

from footmark.operators import reports, visits
from footmark.plans import analysis
from footmark.plans.extractors import DEFAULT
from footmark.sources import sinks, tables
from footmark.streaming.incremental import store_artifacts

T = 13350000000000000  # 2024-01-17 21:20 UTC on the 1601 clock
MIN = 60_000_000
VISITS = [
    ("https://chatgpt.com/", "ChatGPT", 5, T), ("https://chatgpt.com/c/abc123", "ChatGPT - Crime scene analysis", 3, T + 60 * MIN),
    ("https://chat.openai.com/chat", "ChatGPT", 2, T + 120 * MIN), ("https://claude.ai/", "Claude", 4, T + 30 * MIN),
    ("https://claude.ai/chat/def456", "Claude - Evidence review", 2, T + 90 * MIN),
    ("https://gemini.google.com/app", "Gemini", 3, T + 150 * MIN),
    ("https://gemini.google.com/app/xyz789", "Gemini - Forensic assistance", 1, T + 180 * MIN)]
COOKIES = [(".chatgpt.com", "__cf_bm", T, T + 60 * MIN), (".openai.com", "_cfuvid", T, T + 60 * MIN),
           (".claude.ai", "__cf_bm", T + 1_000_000, T + 90 * MIN), (".gemini.google.com", "NID", T + 2_000_000, T + 150 * MIN)]
LATER = datetime(2026, 4, 6, 2, 22, 5, tzinfo=timezone.utc)
FILES = [("ChatGPT_Crime_Scene_Analysis.pdf", None), ("claude_response_export.txt", "Claude AI response export - evidence review notes"),
         ("gemini_forensic_notes.md", "# Gemini Forensic Notes\nGenerated by Gemini Pro")]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("A", "jo", *v) for v in VISITS], "case_id string, user_profile string, url string, title string, "
                          "visit_count int, last_visit_time bigint").write.parquet(f"{root}/urls")
    spark.createDataFrame([("A", "jo", *c) for c in COOKIES], "case_id string, user_profile string, host_key string, name string, "
                          "creation_utc bigint, last_access_utc bigint").write.parquet(f"{root}/cookies")
    files = spark.createDataFrame([("A", "jo", f"/Users/jo/Downloads/{n}", n, t, LATER) for n, t in FILES],
                                  "case_id string, user_profile string, path string, name string, text string, mtime timestamp")
    return {"visits": tables.read_visits(spark, {"Chrome": f"{root}/urls"}),
            "cookies": tables.read_cookies(spark, {"Chrome": f"{root}/cookies"}), "files": files}


@pytest.fixture(scope="module")
def results(spark, inputs):
    return analysis.analyze(spark, inputs, coverage(spark))


def known(rows):
    """Rows of the platforms that the known figures cover; the catalogue has since grown (a note here says "Generated")."""
    return rows.where(F.col("suspected_platform").isin("ChatGPT", "Claude", "Gemini")).collect()


def test_episode_windows(results):
    got = {(r.suspected_platform, r.session_no): r for r in known(results["episodes"])}
    assert sorted(got) == [("ChatGPT", 1), ("ChatGPT", 2), ("Claude", 1), ("Claude", 2), ("Gemini", 1), ("Gemini", 2)]

    def window(key):
        return [datetime.fromtimestamp(x / 1e6, timezone.utc).strftime("%m/%d %H:%M") for x in (got[key].start_us, got[key].end_us)]

    assert window(("ChatGPT", 1)) == ["01/17 21:20", "01/17 23:20"]
    assert window(("Claude", 1)) == ["01/17 21:50", "01/17 22:50"]
    assert window(("Gemini", 1)) == ["01/17 23:50", "01/18 00:20"]
    assert all(got[p, 1].activity == "chat session" and got[p, 2].activity == "content export" for p in ("ChatGPT", "Claude", "Gemini"))
    assert all(got[p, 1].claim_rank == 4 and got[p, 1].event_confidence == "High" for p in ("ChatGPT", "Claude", "Gemini"))
    assert all(got[p, 2].event_confidence == "Low" and got[p, 2].claim_rank == 2 for p in ("ChatGPT", "Claude", "Gemini"))
    assert [got[p, 1].artifacts for p in ("Claude", "Gemini")] == [3, 3]


def test_footprints(results):
    got = {r.suspected_platform: r for r in known(results["footprints"])}
    assert {p: r.direct for p, r in got.items()} == {"ChatGPT": 5, "Claude": 3, "Gemini": 3}
    assert {p: r.sessions for p, r in got.items()} == {"ChatGPT": 2, "Claude": 2, "Gemini": 2}
    assert got["Gemini"].model == "Gemini Pro"


def test_every_artifact_is_kept(results):
    n = results["artifacts"].count()
    assert n == results["matrix"].count() == results["exhibits"].count() == results["timeline"].count()
    assert results["case_totals"].where("level = 'case'").first().artifacts == n


def test_runs_tell_what_was_missing(results):
    got = {r.extractor: r.status for r in results["runs"].collect()}
    assert got["VisitExtractor"] == "Success" and got["ExportReplay"] == "Skipped"


def test_one_failing_extractor_does_not_stop_the_others(spark, inputs, tmp_path, rules):
    registry = DEFAULT.copy()
    registry.register("Broken", ("visits",))(lambda i, r: i["visits"].select(F.raise_error(F.lit("boom")).alias("case_id")))
    registry.register("MacOnly", ("visits",), systems=("macOS",))(lambda i, r: visits.visit_artifacts(i["visits"], r))
    case_os = spark.createDataFrame([("A", "Windows")], "case_id string, os string")
    found, runs = registry.run_all(spark, inputs, rules, str(tmp_path), case_os)
    got = {r.extractor: (r.status, r.artifacts) for r in runs.collect()}
    assert got["Broken"][0] == "Failed" and got["VisitExtractor"] == ("Success", 7) and got["MacOnly"] == ("Not Applicable", 0)
    assert found.where("parser_used = 'VisitExtractor'").count() == 7


def test_empty_evidence(spark, inputs):
    empty = {k: v.limit(0) for k, v in inputs.items()}
    out = analysis.analyze(spark, empty, coverage(spark))
    assert out["artifacts"].count() == 0 and out["episodes"].count() == 0


def test_cases_replace_their_own_rows_only(spark, tmp_path):
    root = str(tmp_path / "store")
    first = spark.createDataFrame([("A", "x", 1, "old"), ("B", "y", 1, "keep")], "case_id string, id string, v int, t string")
    sinks.write_results({"facts": first}, root)
    again = spark.createDataFrame([("A", "x", 2, "new"), ("A", "x", 1, "old")], "case_id string, id string, v int, t string")
    sinks.write_results({"facts": again}, root, {"facts": (["case_id", "id"], "v")})
    got = sorted((r.case_id, r.v, r.t) for r in spark.read.parquet(f"{root}/facts").collect())
    assert got == [("A", 2, "new"), ("B", 1, "keep")]


def test_json_findings_are_read_again(spark, results, tmp_path):
    sinks.write_json({"artifacts": results["artifacts"]}, str(tmp_path))
    back = sinks.read_findings(spark, f"{tmp_path}/artifacts")
    counts = [(r.suspected_platform, r.n) for r in reports.counts_by(back, "suspected_platform").collect()]
    assert counts == [(r.suspected_platform, r.n) for r in reports.counts_by(results["artifacts"], "suspected_platform").collect()]
    assert dict(back.dtypes)["links"].startswith("array<struct")


def test_checklist_export(spark, tmp_path):
    from test_tools import ROWS, entries
    found = entries(spark, ROWS, ["Program Files/A"])
    sinks.write_checklist(found, f"{tmp_path}/csv")
    row = spark.read.csv(f"{tmp_path}/csv", header=True).where("`Tool Name` = 'A'").first()
    assert row["Likely Artifact Paths"] == "Program Files/A" and row["Notes"] == "1 artifact path(s) matched."
    sinks.write_checklist(found, f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == len(ROWS)


def test_stream_gives_the_same_artifacts(spark, inputs, tmp_path, rules):
    source = str(tmp_path / "in")
    inputs["visits"].write.parquet(source)
    arriving = spark.readStream.schema(inputs["visits"].schema).parquet(source)
    run = dict(extract=lambda df: visits.visit_artifacts(df, rules), path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    store_artifacts(arriving, **run).awaitTermination()
    store_artifacts(arriving, **run).awaitTermination()  # nothing new arrives, nothing is stored twice
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.record_id for r in stored.collect()) == sorted(
        r.record_id for r in visits.visit_artifacts(inputs["visits"], rules).collect())


def test_safari_history(spark, tmp_path):
    spark.createDataFrame([("A", 1, "https://claude.ai/")], "case_id string, id int, url string").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame([("A", 1, 727218000.5, "t")], "case_id string, history_item int, visit_time double, title string").write.parquet(f"{tmp_path}/visits")
    rows = tables.read_visits(spark, {"Safari": (f"{tmp_path}/items", f"{tmp_path}/visits")})
    from footmark.functions.rules import default_rules
    got = visits.visit_artifacts(rows, default_rules()).select(F.unix_micros("ts"), "suspected_platform").first()
    assert tuple(got) == (int((727218000.5 + 978307200) * 1e6), "Claude")


def test_capability_defaults_and_own_profiles(spark):
    own = spark.createDataFrame([("Poe", "mine")], "platform string, blind_spot string")
    got = {r.blind_spot for r in reports.blind_spots(spark, own).where("platform = 'Poe'").collect()}
    assert got == {"mine"}
    df = spark.createDataFrame([("Tidio",), ("ChatGPT",)], "suspected_platform string")
    rows = {r.suspected_platform: r for r in reports.with_capability(df, reports.capabilities(spark)).collect()}
    assert (rows["Tidio"].export, rows["Tidio"].capability_confidence) == (False, "low")
    assert (rows["ChatGPT"].voice, rows["ChatGPT"].capability_confidence) == (True, "high")


def test_governance_tables(results):
    rolled = results["coverage_rollup"].first()
    assert (rolled.case_id, rolled.failed) == ("A", []) and {"VisitExtractor", "CookieExtractor"} <= set(rolled.succeeded)
    assert set(rolled.families_found).isdisjoint(rolled.families_missing) and rolled.families_found and rolled.families_missing
    facts = results["governance"].first()
    assert {"ChatGPT", "Claude", "Gemini"} <= set(facts.platforms) and facts.families_missing == rolled.families_missing
    assert {r.suspected_platform for r in results["blind_spots"].collect()} == set(facts.platforms)
    versions = {r.component: r.version for r in results["drift"].collect()}
    assert set(versions) == set(DEFAULT.extractors) and versions["ToolScanner"] == "1.0.0"


def test_tools_of_an_inventory(spark, tmp_path):
    from test_tools import ROWS, SCHEMA
    case = spark.createDataFrame([("A", "Windows")], "case_id string, os string")
    people = spark.createDataFrame([("A", "jo")], "case_id string, user_profile string")
    paths = spark.createDataFrame([("A", "Users/jo/AppData/Local/A"), ("A", "Program Files/A")], "case_id string, path string")
    given = {"tools": spark.createDataFrame(ROWS, SCHEMA), "tool_systems": case, "tool_profiles": people, "tool_paths": paths}
    found = analysis.analyze(spark, given, coverage(spark), str(tmp_path))
    assert {r.status for r in found["runs"].where("extractor = 'ToolScanner'").collect()} == {"Success"}
    shown = found["artifacts"].where("parser_used = 'ToolScanner'").collect()
    assert sorted(r.artifact_path for r in shown) == ["Program Files/A", "Users/jo/AppData/Local/A"]
    assert {r.tool_id: r.status for r in found["checklist"].collect()}["a"] == "FOUND"
    assert [r.tool_id for r in found["tool_coverage"].collect()] == ["a"]
    assert {r.tool_id for r in found["tool_gaps"].collect()} == {r.tool_id for r in found["checklist"].collect() if r.status == "NOT_FOUND"}
