from footmark.operators.artifacts import ARTIFACT_SCHEMA
from footmark.plans.extractors import DEFAULT


def test_trace_extractors(spark, rules):
    inputs = {
        "registry_values": spark.createDataFrame(
            [("A", "/h", "TypedURLs", "url1", "https://chatgpt.com/", None), ("A", "/h", "RunMRU", "a", "claude.exe", None),
             ("A", "/h", "RunMRU", "b", "calc", None)],
            "case_id string, path string, key_label string, name string, value string, mtime timestamp"),
        "quarantine_events": spark.createDataFrame([("A", "/q", "https://claude.ai/f", None, "Safari", None)],
                                                   "case_id string, path string, origin_url string, data_url string, agent string, at timestamp"),
        "recent_files": spark.createDataFrame([("A", "/r", "claude-ai notes.lnk", None)], "case_id string, path string, name string, mtime timestamp"),
        "deleted_files": spark.createDataFrame([("A", "/d", "chatgpt-export.zip")], "case_id string, path string, name string"),
        "packages": spark.createDataFrame([("A", "/p", "com.quora.poe", None), ("A", "/p", "org.x", None)],
                                          "case_id string, path string, package string, at timestamp"),
        "transcripts": spark.createDataFrame([("A", "/v.mp3", "gemini.mp3", None, None), ("A", "/v.txt", "v.txt", None, "asked chatgpt")],
                                             "case_id string, path string, name string, mtime timestamp, text string"),
    }
    got = {}
    for name in ("RegistryExtractor", "QuarantineExtractor", "RecentFileExtractor", "DeletedFileExtractor", "PackageExtractor", "TranscriptExtractor"):
        df = DEFAULT.extractors[name].run(inputs, rules)
        assert set(df.columns) == set(ARTIFACT_SCHEMA.names)
        got[name] = sorted((r.suspected_platform, r.classification, r.initial_confidence, r.artifact_subtype, r.access_mode) for r in df.collect())
    assert got["RegistryExtractor"] == [("ChatGPT", "Direct", "High", "TypedURL", "Browser"), ("Claude", "Inferred", "Low", "RunMRU", "Unknown")]
    assert got["QuarantineExtractor"] == [("Claude", "Direct", "Moderate", "Download Source", "Browser")]
    assert got["RecentFileExtractor"] == [("Claude", "Inferred", "Low", "Windows Recent", "Unknown")]
    assert got["DeletedFileExtractor"] == [("ChatGPT", "Inferred", "Low", "Deleted File", "Unknown")]
    assert got["PackageExtractor"] == [("Poe", "Direct", "High", "packages.xml Entry", "Native App")]
    assert got["TranscriptExtractor"] == [("ChatGPT", "Direct", "Moderate", "Transcript Text", "Unknown"),
                                          ("Gemini", "Inferred", "Low", "Audio Metadata", "Unknown")]
