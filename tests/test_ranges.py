"""Files above binaryFile's limit, read in ranges by several tasks: equal to a scan of whole files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from footmark.operators import content, hits
from footmark.sources import files, ranges, rules as rule_sources

LIMIT = "spark.sql.sources.binaryFile.maxLength"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("images"), random.Random(6)
    parts = ["chatgpt.com", "GPT-4o-mini", '"conversation_id" :', "sk-" + "q" * 30, "token", "é", "\0\0", "\n", "claude.ai", "x" * 90]
    big = "".join(rng.choice(parts) if rng.random() < 0.3 else rng.choice("abc \n") * rng.randint(1, 40) for _ in range(3000)).encode()
    blobs = {
        "A/disk one+two%.img": big, "A/empty.bin": b"", "B/deep/er/tiny.bin": b"claude.ai", "B/exact.bin": b"y" * 989 + b"chatgpt.com",
        "A/photo.jpg": b"\xff\xd8\xff" + b"\0" * 5000 + b"\xff\xd9", "A/open.jpg": b"\xff\xd8\xff" + b"\xff" * 5000,
        "A/pack.zip": b"PK\x03\x04" + b"\0" * 2995 + b"PK\x05\x06" + b"c" * 999, "A/cut.zip": b"PK\x03\x04" + b"\0" * 3000,
        "A/paper.pdf": b"%PDF-1.7 " + b"b" * 989 + b"%%EOF" + b" claude.ai", "A/open.pdf": b"%PDF-1.7 chatgpt" + b"b" * 3000,
        "A/base.db": b"SQLite format 3\0" + b"x" * 2000, "A/base.short": b"SQLite format 3\0"}
    for name, data in blobs.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root), {"/" + n.split("/", 1)[1]: b for n, b in blobs.items()}


@pytest.fixture
def limited(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "1000")
    yield spark
    spark.conf.set(LIMIT, before)


def test_whole_files_are_refused_and_ranges_are_not(limited, tree):
    root, blobs = tree
    with pytest.raises(Exception, match="maxLength|max length|maximum|exceeds"):
        files.file_inventory(limited, root, content=True).collect()
    rows = ranges.read_ranges(files.file_inventory(limited, root), size=1000, overlap=100).withColumn("task", F.spark_partition_id()).collect()
    for path, data in blobs.items():
        own = sorted((r for r in rows if r.path == path), key=lambda r: r.start)
        assert [(r.start, r.stop) for r in own] == [(a, min(a + 1000, len(data))) for a in range(0, len(data), 1000)]
        assert all(bytes(r.data) == data[max(0, r.start - 100):r.stop + 100] for r in own)
    assert len({r.task for r in rows if r.path.startswith("/disk")}) > 1


@pytest.mark.parametrize("size", [1000, 1013, 1 << 20])
def test_hits_at_borders_are_found_once(limited, tree, size):
    root, blobs = tree
    patterns = hits.hit_patterns(["token", "é"])
    read = ranges.read_ranges(files.file_inventory(limited, root), size=size, overlap=200)
    found = hits.scan_ranges(read, patterns).collect()
    want = sorted((path, m.start(), len(m.group()), n) for path, data in blobs.items() for n, (kind, p, _, _) in enumerate(patterns)
                  for m in re.finditer(p.encode(), data, 0 if kind == "Platform Token" else re.I))
    assert sorted((r.path, r.offset, r.length, r.pattern_no) for r in found) == want
    whole = limited.createDataFrame([(p, bytearray(d)) for p, d in blobs.items()], "path string, data binary")
    texts = {(r.path, r.offset, r.pattern_no): (r.matched, r.context) for r in hits.scan_hits(whole, "data", patterns).collect()}
    assert {(r.path, r.offset, r.pattern_no): (r.matched, r.context) for r in found} == texts
    assert not any("qqq" in r.matched + r.context for r in found)


@pytest.mark.parametrize("size", [1000, 1 << 20])
def test_formats(limited, tree, tmp_path, size):
    root, blobs = tree
    (tmp_path / "own.json").write_text('[{"name": "PDF", "extension": "pdf", "header_hex": "25504446", "footer_hex": "2525454F46", '
                                       '"validate_internal": true, "max_size": 1002, "min_size": 20}]')
    inventory = files.file_inventory(limited, root)
    whole = limited.createDataFrame([(p, len(d), bytearray(d)) for p, d in blobs.items()], "path string, size bigint, content binary")
    for rules in (rule_sources.blob_rules(limited), rule_sources.blob_rules(limited, str(tmp_path / "own.json"))):
        columns = ["path", "rule", "carved_ext", "validation", "recovery_status", "confidence_hint", "platform"]
        found = content.sniff_ranges(ranges.read_ranges(inventory, size=size, overlap=64), rules).select(columns).collect()
        want = content.sniff_blobs(whole, rules).select(columns).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and found


def test_ranges_of_contents_that_spark_read(spark, tree):
    root, _ = tree
    a = ranges.read_ranges(files.file_inventory(spark, root), 700, 50).select("path", "start", "data")
    b = ranges.read_ranges(files.file_inventory(spark, root, content=True), 700, 50).select("path", "start", "data")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
