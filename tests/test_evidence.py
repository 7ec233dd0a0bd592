"""Classified rows that become artifacts, alone and in a whole analysis."""

from datetime import datetime, timedelta, timezone

import pytest
from helpers import coverage
from pyspark.sql import functions as F

from footmark.functions.timeconv import MICROS_1601_TO_1970
from footmark.operators import evidence
from footmark.plans import analysis
from footmark.plans.extractors import DEFAULT

AT = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
KEY = "sk-" + "a1B2" * 6


@pytest.fixture(scope="module")
def tables(spark):
    def made(rows, schema):
        return spark.createDataFrame(rows, schema)

    day_us = 24 * 3600 * 1_000_000
    start = int(AT.timestamp() * 1e6) + MICROS_1601_TO_1970
    seen = [("A", "u", "Chrome", f"https://x{i}.example/", None, 1, start + i * 60_000_000, "webkit") for i in range(12)]
    seen += [("A", "u", "Chrome", "https://late.example/", None, 1, start + 5 * day_us, "webkit"),
             ("A", "u", "Chrome", "https://future.example/", None, 1, start + 40_000 * day_us, "webkit")]
    return {
        "visits": made(seen, "case_id string, user_profile string, browser string, url string, title string, visit_count long, raw_time long, time_kind string"),
        "binary_files": made([("A", "/p/dall-e 1.jpg", "dall-e 1.jpg", 9, AT, bytearray(b"\xff\xd8\xff\xdbxxxxx"))],
                             "case_id string, path string, name string, size long, mtime timestamp, content binary"),
        "registry_subkeys": made([("A", "/ntuser", "RecentDocs", "k/1", "https://claude.ai/x"), ("A", "/ntuser", "RecentDocs", "k/2", "nothing")],
                                 "case_id string, path string, key_label string, key_path string, value string"),
        "folder_keys": made([("A", "/usr", "Shell", "k/1", "chatgpt.com things")], "case_id string, path string, key_label string, key_path string, value string"),
        "installs": made([("A", "/software", "Uninstall", "{1}", "Claude", None, AT)],
                         "case_id string, path string, key_label string, key_name string, display_name string, install_location string, mtime timestamp"),
        "registered_apps": made([("A", "/software", "Claude", "SOFTWARE/Claude")], "case_id string, path string, name string, value string"),
        "registry_keys": made([("A", "/software", "SOFTWARE\\OpenAI", None)], "case_id string, path string, key_path string, mtime timestamp"),
        "plist_values": made([("A", "/x.plist", "com.openai.chat")], "case_id string, path string, value string"),
        "app_usage": made([("A", "/k.db", "com.openai.chatgpt", AT, 5), ("A", "/k.db", "com.openai.chatgpt", None, None)],
                          "case_id string, path string, bundle_id string, at timestamp, seconds long"),
        "app_traffic": made([("A", "/d.db", "com.openai.chatgpt", AT, 1, None, 2, None)],
                            "case_id string, path string, package string, at timestamp, wifi_in long, wifi_out long, wwan_in long, wwan_out long"),
        "memory_texts": made([("A", "/mem", f"xx claude.ai yy gpt-4o {KEY} claude.ai")], "case_id string, path string, text string"),
        "network_texts": made([("A", "/net", "GET chatgpt.com HTTP")], "case_id string, path string, text string"),
        "manifests": made([("A", "/i.png", "i.png", '{"claim_generator": "OpenAI"}', AT)], "case_id string, path string, name string, manifest string, mtime timestamp"),
        "extensions": made([("A", "/e", "zz", '{"name": "My Claude"}', AT)], "case_id string, path string, ext_id string, manifest string, mtime timestamp"),
        "addons": made([("A", "/addons.json", "ChatGPT helper", "x")], "case_id string, path string, name string, description string"),
        "raw_texts": made([("A", "E1", f"a claude.ai b {KEY}")], "case_id string, evidence_id string, text string"),
    }


def test_every_form(spark, tables, rules):
    names = {"SubkeyExtractor": 1, "FolderKeyExtractor": 1, "InstallExtractor": 1, "RegisteredAppExtractor": 1, "KnownKeyExtractor": 1,
             "PlistExtractor": 1, "AppUsageExtractor": 2, "AppTrafficExtractor": 1, "NetworkExtractor": 1, "ManifestExtractor": 1,
             "ExtensionExtractor": 1, "AddonExtractor": 1, "HistoryGapDetector": 2, "FutureStampDetector": 1, "StrippedImageDetector": 1}
    for name, n in names.items():
        rows = DEFAULT.extractors[name].run(tables, rules).collect()
        assert len(rows) == n, (name, rows)
        assert len({r.record_id for r in rows}) == n and all(r.extracted_indicator for r in rows), name


def test_memory_shows_no_key(spark, tables, rules):
    rows = evidence.memory_artifacts(tables["memory_texts"], rules).collect()
    kinds = {r.artifact_subtype for r in rows}
    assert kinds == {"memory_domain", "memory_model", "memory_api_key"}
    assert not any(KEY[4:20] in (r.extracted_indicator + r.notes) for r in rows)


def test_analysis_counts_tampering_and_manifests(spark, tables):
    systems = spark.createDataFrame([("A", "Windows")], "case_id string, os string")
    out = analysis.analyze(spark, tables, coverage(spark), case_os=systems)
    runs = {r.extractor: r.status for r in out["runs"].collect()}
    assert "Failed" not in runs.values()
    assert runs["PlistExtractor"] == "Not Applicable" and runs["InstallExtractor"] == "Success"
    tamper = out["tamper"].where("case_id = 'A'").first()
    assert (tamper.history_gaps, tamper.time_anomalies, tamper.stripped_images) == (2, 1, 1)
    status = {r.requirement: r.status for r in out["requirements"].where("case_id = 'A'").collect()}
    assert status["FR-4"] == status["FR-7"] == "Full" or status["FR-4"].lower().startswith("full")
    assert out["artifacts"].where(F.contains("extracted_indicator", F.lit(KEY)) | F.contains("notes", F.lit(KEY))).isEmpty()
