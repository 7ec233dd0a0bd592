import json

import pytest
from pyspark.sql import functions as F

from footmark.operators import content, exports
from footmark.sources import files, rules as rule_sources


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")

    def put(name, data):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("A/img/photo.jpg", b"\xff\xd8\xff" + b"\0" * 200 + b"\xff\xd9")
    put("A/img/paper.pdf", b"%PDF-1.7 body chatgpt %%EOF")
    put("A/img/open.pdf", b"%PDF-1.7 body")
    put("A/img/pack.docx", b"PK\x03\x04" + b"\0" * 60 + b"PK\x05\x06" + b"\0" * 18)
    put("A/dalle_1.png", b"\x89PNG plain")
    put("A/other.png", b"xx c2pa yy")
    put("A/side.json", json.dumps({"generator": "g", "c2pa": True}))
    put("A/plain.json", json.dumps({"a": 1}))
    put("A/list.json", "[1, 2]")
    put("B/Down loads/dall-e big.jpg", b"\xff\xd8" + b"\0" * 20_000)
    put("B/Down loads/dall-e exif.jpg", b"\xff\xd8\xff\xe1" + b"\0" * 20_000)
    put("B/log/system.log", "2025-01-11 16:00:00 claude.ai\nnothing\n")
    put("B/voice/a.txt", "talked to chatgpt")
    put("B/voice/b.json", json.dumps([{"text": "one"}, {"transcript": "gemini two"}]))
    put("B/voice/c.mp3", b"\0\1")
    conversation = {
        "id": "abc", "title": "T", "create_time": 1736611200.5, "default_model_slug": "gpt-4", "plugin_ids": ["p"],
        "mapping": {
            "n1": {"message": {"author": {"role": "user"}, "content": {"parts": ["hi ", {"content_type": "image_asset"}]},
                               "create_time": 1736611201}},
            "n2": {"message": {"author": {"role": "tool", "name": "web"}, "content": {"parts": ["x"]}, "metadata": {"model_slug": "gpt-4o"}}},
            "n3": {"message": {"author": {"role": "system"}, "content": {"parts": ["y"]}}}, "n4": {"message": None}}}
    put("C/export/conversations.json", json.dumps([conversation, {"title": "no mapping"}]))
    return str(root)


def test_inventory_reads_bytes_only_when_asked(spark, tree):
    inv = files.file_inventory(spark, tree)
    got = {(r.case_id, r.path): (r.name, r.ext, r.size) for r in inv.collect()}
    assert got["A", "/img/photo.jpg"] == ("photo.jpg", "jpg", 205)
    assert ("B", "/Down loads/dall-e big.jpg") in got
    assert "content" not in inv.columns


def test_blob_formats(spark, tree):
    blobs = files.file_inventory(spark, tree, content=True)
    got = {(r.path, r.rule): r for r in content.sniff_blobs(blobs, rule_sources.blob_rules(spark)).collect()}
    assert got["/img/photo.jpg", "JPEG"].recovery_status == "Complete"
    assert got["/img/paper.pdf", "PDF"].confidence_hint == "Moderate" and got["/img/paper.pdf", "PDF"].platform == "ChatGPT"
    assert got["/img/open.pdf", "PDF"].recovery_status == "Partial" and got["/img/open.pdf", "PDF"].confidence_hint == "Low"
    assert got["/img/pack.docx", "DOCX"].validation == "Valid" and got["/img/pack.docx", "ZIP"].validation == "Not Validated"
    assert not [k for k in got if k[0] == "/dalle_1.png"]


def test_own_blob_rules(spark, tree, tmp_path):
    pack = [{"name": "X", "extension": "x", "header_hex": "7878", "footer_hex": "7979", "max_size": 9999}]
    (tmp_path / "pack.json").write_text(json.dumps(pack))
    found = content.sniff_blobs(files.file_inventory(spark, tree, content=True), rule_sources.blob_rules(spark, str(tmp_path / "pack.json")))
    assert [(r.path, r.rule, r.recovery_status) for r in found.collect()] == [("/other.png", "X", "Complete")]


def test_blob_rules_in_full(spark, tmp_path):
    pack = [{"name": "SQLite", "extension": "db", "header_hex": "53514C697465", "validate_internal": True},
            {"name": "PDF", "extension": "pdf", "header_hex": "2550", "footer_hex": "2525454F46", "validate_internal": True, "max_size": 40},
            {"name": "ZIP", "extension": "zip", "header_hex": "504B", "validate_internal": True, "min_size": 20}]
    (tmp_path / "pack.json").write_text(json.dumps(pack))
    blobs = {"db": b"SQLite format 3\0" + b"x" * 90, "short": b"SQLite format 3\0", "pdf": b"%PDF-1.7 x %%EOF", "open": b"%PDF-1.7 x" + b"y" * 40 + b"%%EOF",
             "zip": b"PK\x03\x04" + b"x" * 40 + b"PK\x05\x06" + b"c" * 999, "cut": b"PK\x03\x04" + b"x" * 40, "tiny": b"PK\x03\x04"}
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in blobs.items()], "name string, content binary")
    got = {r.name: (r.rule, r.validation, r.recovery_status) for r in content.sniff_blobs(df, rule_sources.blob_rules(spark, str(tmp_path / "pack.json"))).collect()}
    assert got == {"db": ("SQLite", "Valid", "Partial"), "short": ("SQLite", "Header Only", "Partial"), "pdf": ("PDF", "Valid", "Complete"),
                   "open": ("PDF", "Partial Structure", "Partial"), "zip": ("ZIP", "Valid", "Partial"), "cut": ("ZIP", "Partial Structure", "Partial")}


def test_generated_assets(spark, tree):
    rows = content.detect_assets(files.file_inventory(spark, tree, content=True)).collect()
    got = {r.path: (r.method, r.asset_type, r.platform) for r in rows}
    assert got["/dalle_1.png"] == ("filename_match", "image", "ChatGPT")
    assert got["/other.png"][0] == "c2pa_manifest" and got["/side.json"] == ("metadata_sidecar", "document", "Unknown")
    assert "/plain.json" not in got and "/list.json" not in got
    assert all(len(r.file_hash) == 64 for r in rows)
    assert content.asset_artifacts(files.file_inventory(spark, tree, content=True)).count() == len(rows)


def test_stripped_images(spark, tree):
    rows = content.detect_stripped_images(files.file_inventory(spark, tree, content=True)).collect()
    assert "dall-e big.jpg" in [r.name for r in rows]
    large = content.detect_stripped_images(files.file_inventory(spark, tree, content=True), min_size=10_001)
    assert [r.name for r in large.collect()] == ["dall-e big.jpg"]


def test_log_lines(spark, tree, rules):
    from footmark.operators import traces
    lines = files.read_log_lines(spark, tree + "/").where(F.col("path").endswith(".log")).withColumn("user_profile", F.lit("u"))
    got = traces.log_artifacts(lines, rules, "unified_log").collect()
    assert [(r.case_id, r.suspected_platform, r.ts.hour) for r in got] == [("B", "Claude", 16)]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, rules):
    from footmark.operators import traces
    texts = {"A/x.log": [f"2025-01-11 16:00:{i % 60:02d} {'claude.ai' if i % 7 == 0 else 'é' * (i % 50)}" for i in range(3000)],
             "A/dir/y z.log": ["2025-01-11 16:00:00 chatgpt.com"] * 5, "B/empty.log": [], "B/one.log": ["no end of line claude.ai"]}
    for name, lines in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + ("" if name == "B/one.log" else "\n" * bool(lines)))
    want = {(n.split("/", 1)[0], "/" + n.split("/", 1)[1], i, line) for n, lines in texts.items() for i, line in enumerate(lines, 1)}

    def read():
        lines = files.read_log_lines(spark, str(tmp_path)).withColumn("user_profile", F.lit("u"))
        ids = {r.record_id for r in traces.log_artifacts(lines, rules, "unified_log").select("record_id").collect()}
        return {(r.case_id, r.path, r.line_no, r.line) for r in lines.collect()}, ids

    before, split = spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.files.maxPartitionBytes"
    rows, ids = read()
    assert rows == want and len(ids) > 400
    try:
        spark.conf.set(split, "3000")
        assert len({r[0] for r in spark.read.text(str(tmp_path / "A/x.log")).select(F.spark_partition_id()).collect()}) > 5
        assert read() == (rows, ids)
    finally:
        spark.conf.set(split, before)
    (tmp_path / "A/a first.log").write_text("nothing\n" * 100)
    more, same = read()
    assert same == ids and more - rows == {("A", "/a first.log", i, "nothing") for i in range(1, 101)} and rows <= more


def test_transcripts(spark, tree):
    got = {r.name: (r.platform, r.classification, r.transcript) for r in content.classify_transcripts(
        files.read_transcripts(spark, tree).where(F.col("path").startswith("/voice"))).collect()}
    assert got == {"a.txt": ("ChatGPT", "Direct", "talked to chatgpt"), "b.json": ("Gemini", "Direct", "one\ngemini two"),
                   "c.mp3": ("Unknown", "Inferred", "")}


def test_export_replay(spark, tree, rules):
    raw = files.read_exports(spark, tree).withColumn("user_profile", F.lit("u"))
    got = {r.artifact_subtype: r for r in exports.replay_exports(raw, rules).collect()}
    assert set(got) == {"conversation_export", "user_message", "tool_message", "plugin_reference"}
    assert got["user_message"].extracted_indicator == "[USER] hi [image_asset]"
    assert got["tool_message"].extracted_indicator == "[TOOL] (Tool: web) x"
    assert (got["tool_message"].suspected_model, got["user_message"].suspected_model) == ("GPT-4o", "GPT-4")
    assert got["conversation_export"].extracted_indicator == "Conversation: 'T' (ID: abc) Model: gpt-4 | Plugins: p"
    assert exports.replay_exports(raw, rules, max_messages=1).where("artifact_type = 'ChatGPT Message'").count() == 1


def test_context_urls(spark):
    late = "a" * 5000 + " https://x.example/?u=Claude.ai/1&" + "v" * 900 + " b https://chatgpt.com/c and claude.ai https://claude.ai/2"
    df = spark.createDataFrame([(1, late), (2, "only claude.ai here"), (3, "none"), (4, None)], "id int, text string")
    got = {(r.id, r.domain, r.found) for r in content.context_urls(df, ["claude.ai", "chatgpt.com"]).collect()}
    assert got == {(1, "claude.ai", "https://x.example/?u=Claude.ai/1&" + "v" * 900), (1, "claude.ai", "https://claude.ai/2"),
                   (1, "chatgpt.com", "https://chatgpt.com/c"), (2, "claude.ai", "claude.ai")}


def test_bytes_that_are_no_text(spark, tmp_path, rules):
    root = tmp_path / "E" / "voice"
    root.mkdir(parents=True)
    (root / "a.txt").write_bytes(b"gemini caf\xe9")
    (root / "b.json").write_bytes(b'{"text": "claude \xe9"}')
    (root / "c.json").write_bytes(b'{"prompt": "\xff", "size": 1')
    found = files.read_transcripts(spark, str(tmp_path))
    assert {r.name: r.text for r in found.collect()}["a.txt"] == "gemini caf\ufffd"
    assert content.classify_transcripts(found).where("platform = 'Gemini'").count() == 1
    inventory = files.file_inventory(spark, str(tmp_path), content=True)
    assert content.detect_assets(inventory).count() == 0
    assert files.with_text(inventory).where("name = 'a.txt'").first().text == "gemini caf\ufffd"


def test_tool_inventory_file(spark, tmp_path):
    entry = {"tool_id": "t", "tool_name": "T", "vendor": "v", "category": "Local LLM", "platform_supported": ["Windows"],
             "execution_surface": ["TERMINAL"], "artifact_path_candidates": {"Windows": ["%LocalAppData%/T"]}, "detection_method": "m"}
    (tmp_path / "tools.json").write_text(json.dumps({"tools": [entry]}))
    row = rule_sources.tools(spark, str(tmp_path / "tools.json")).first()
    assert (row.tool_id, row.notes, row.artifact_path_candidates) == ("t", "", {"Windows": ["%LocalAppData%/T"]})
