import fnmatch
import re

from pyspark.sql import functions as F

from footmark.operators import tools
from footmark.operators.spread import join_few

SCHEMA = ("tool_id string, tool_name string, category string, platform_supported array<string>, execution_surface array<string>, "
          "artifact_path_candidates map<string, array<string>>, detection_method string, notes string")


def entries(spark, rows, paths, os="Windows", users=("jo",)):
    t = spark.createDataFrame(rows, SCHEMA)
    case = spark.createDataFrame([("A", os)], "case_id string, os string")
    prof = spark.createDataFrame([("A", u) for u in users], "case_id string, user_profile string")
    inv = spark.createDataFrame([("A", p) for p in paths], "case_id string, path string")
    return tools.checklist(t, case, prof, inv)


ROWS = [
    ("a", "A", "Native Assistant", ["Windows"], ["DESKTOP_APP"], {"Windows": ["%LocalAppData%/A", "%ProgramFiles%\\A", "%Odd%/x"]}, "", ""),
    ("b", "B", "IDE Extension", ["Windows", "macOS"], ["IDE_EXTENSION", "TERMINAL"], {"Windows": ["%UserProfile%/.b/ext-*/config.json"]}, "", "API key"),
    ("c", "C", "Web Assistant", ["macOS"], ["BROWSER"], {"macOS": ["~/Library/C"]}, "", ""),
    ("d", "D", "Web Assistant", ["Windows"], ["BROWSER"], {"macOS": ["~/Library/D"]}, "", ""),
    ("e", "E", "Local LLM", ["Windows"], ["DESKTOP_APP", "BROWSER"], {"Windows": ["%Temp%/E"]}, "", ""),
]


def test_statuses(spark):
    got = {r.tool_id: r for r in entries(spark, ROWS, [
        "/Users/jo/AppData/Local/A", "Program Files/A", "Users/jo/.b/ext-1/config.json", "Users/jo/.b/ext-1/deep/config.json",
        "Users/x/AppData/Local/Temp/E"]).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a": "FOUND", "b": "FOUND", "c": "NOT_VERIFIED", "d": "NOT_VERIFIED", "e": "NOT_FOUND"}
    assert got["a"].paths == ["Users/jo/AppData/Local/A", "Program Files/A"]
    assert got["b"].paths == ["Users/jo/.b/ext-1/config.json"]
    assert (got["a"].tool_confidence, got["b"].tool_confidence, got["e"].tool_confidence) == ("HIGH", "MEDIUM", "N/A")
    assert got["c"].caveat_flags == ["OS_OR_HARDWARE_LIMITATION", "NEGATIVE_FINDING_SCOPED"]
    assert got["d"].caveat_flags == ["PARSER_LIMITATION", "NEGATIVE_FINDING_SCOPED"]
    assert got["b"].caveat_flags == ["IDE_CONFIG_NOT_USAGE", "CREDENTIAL_FILE_ONLY", "ATTRIBUTION_NOT_ESTABLISHED", "USE_NOT_ESTABLISHED",
                                     "MULTI_SURFACE_PRODUCT", "PRESENCE_ONLY", "CORROBORATION_LEVEL_LIMITED"]
    assert got["e"].surface_class == "LOCAL_WEBUI" and got["c"].attribution_scope == "DEVICE_LEVEL_ONLY"
    assert got["e"].inference_location == "LOCAL" and got["c"].coverage_status == "NOT_COVERED"


def test_class_diversity_raises_corroboration(spark):
    rows = [("a", "A", "AI IDE", ["Windows"], ["DESKTOP_APP"], {"Windows": ["%AppData%/A/bin", "%AppData%/A/config"]}, "", "")]
    got = entries(spark, rows, ["Users/jo/AppData/Roaming/A/bin", "Users/jo/AppData/Roaming/A/config"]).first()
    assert got.class_count == 2 and got.corroboration.startswith("LEVEL_2")


def test_posix_paths_and_users(spark):
    got = entries(spark, ROWS, ["Users/mo/Library/C"], os="macOS", users=("jo", "mo")).where("tool_id = 'c'").first()
    assert (got.status, got.paths) == ("FOUND", ["Users/mo/Library/C"])


def test_texts_ledgers_and_artifacts(spark):
    found = entries(spark, ROWS, ["Program Files/A"])
    text = found.where("tool_id = 'a'").select(tools.caveat_text(F.col("caveat_flags"))).first()[0]
    assert text[0] == "Use not established from available artifacts." and text[-1] == "CORROBORATION_LEVEL_LIMITED"
    assert [r.place for r in tools.coverage_ledger(found).collect()] == ["Program Files/A"]
    assert sorted(r.place for r in tools.gap_ledger(found).collect()) == ["NOT_FOUND: B", "NOT_FOUND: E"]
    row = tools.checklist_artifacts(found).first()
    assert "Evidence class: A-Presence" in row.notes and row.artifact_family == "Install Artifacts"


def test_glob(spark):
    df = spark.createDataFrame([("a/*.x?", "a/b.x1"), ("a/*.x?", "a/b/c.x1"), ("a.b*", "axb")], "g string, p string")
    assert [r[0] for r in df.select(F.rlike("p", tools.glob_regex(F.col("g")))).collect()] == [True, False, False]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_keys_are_spread(spark):
    rows = spark.range(20_000).select(F.col("id").alias("n"), F.lit("Windows").alias("os"))
    few = spark.createDataFrame([("A", "Windows"), ("B", "Windows"), ("C", "macOS")], "case_id string, os string")
    for keys, cases in ((["os"], few), ([], few.drop("os"))):
        found = join_few(rows, cases, keys, ["n"])
        assert found.select("n", "case_id").distinct().count() == found.count() == 20_000 * (2 if keys else 3)
        assert "Broadcast" not in plan(found)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            parts = [r["count"] for r in join_few(rows, cases, keys, ["n"]).groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert max(parts) < 0.6 * sum(parts)


def test_inventory_of_tools_is_not_sent_around(spark):
    t = spark.createDataFrame(ROWS, SCHEMA)
    case = spark.createDataFrame([("A", "Windows")], "case_id string, os string")
    prof = spark.createDataFrame([("A", "jo")], "case_id string, user_profile string")
    text = plan(tools.expand_tool_paths(tools.tool_paths(t), prof, case))
    assert "BroadcastHashJoin [os#" not in text and "SortMergeJoin [os#" in text


def test_wildcards_at_any_place(spark):
    """Pattern, then paths with whether they fit; also where the wildcard begins a part, ends it, or comes first."""
    cases = {
        "Users/jo/.b*/config": ["Users/jo/.bx/config", "Users/jo/.b/config", "Users/jo/.cx/config", "Users/jo/.bx/y/config"],
        "Users/*/x": ["Users/jo/x", "Users//x", "Users/jo/y"], "*/top": ["any/top", "any/x/top"],
        "a?": ["ab", "a", "b"], "*": ["ab", "z"], "Users/jo/longer-*": ["Users/jo/longer-1", "Users/jo/longer", "Users/jo/lo"],
    }
    paths = sorted({p for ps in cases.values() for p in ps})
    cand = spark.createDataFrame([("A", f"t{i}", g, 0) for i, g in enumerate(cases)], "case_id string, tool_id string, candidate string, ord int")
    inv = spark.createDataFrame([("A", p) for p in paths] + [("B", "Users/jo/.bb/config")], "case_id string, path string")
    got = {r.tool_id: r.path for r in tools.match_tool_paths(cand, inv).collect()}
    fits = {f"t{i}": [p for p in paths if p.count("/") == g.count("/") and fnmatch.fnmatchcase(p, g)] for i, g in enumerate(cases)}
    assert got == {t: min(ps) for t, ps in fits.items() if ps}


def test_files_are_not_dealt_by_case_and_depth(spark):
    cand = spark.createDataFrame([("A", "t", "Users/jo/.b*", 0)], "case_id string, tool_id string, candidate string, ord int")
    inv = spark.range(10).select(F.lit("A").alias("case_id"), F.concat(F.lit("Users/jo/d"), "id").alias("path"))
    text = plan(tools.match_tool_paths(cand, inv))
    assert not re.search(r"Join \[case_id#\d+, depth#\d+\]", text)


def test_tools_of_every_case_are_not_sent_around(spark):
    assert "BroadcastHashJoin [os#" not in plan(entries(spark, ROWS, ["Program Files/A"]))
    others = entries(spark, ROWS, [], os="Solaris")  # a system without tools
    assert others.count() == 0 and entries(spark, ROWS, [], os="Linux").count() == len(ROWS)
