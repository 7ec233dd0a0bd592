"""Substring and byte deduplication against brute force, over one block and over many."""

import hashlib
from collections import Counter, defaultdict

import pytest
from llm_helpers import DOCS, collected, documents, hard_documents

from footmark.llm import blocks, substring, suffix


@pytest.fixture(params=[4 << 20, 2000])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", request.param)


def phrases_by_brute_force(rows, n=13):
    first: dict = {}
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - n + 1):
            key = tuple(words[i:i + n])
            first[key] = min(first.get(key, blocks.NO_ID), blocks.NO_ID if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - n + 1):
            if first[tuple(words[i:i + n])] < (blocks.NO_ID if doc is None else doc):
                gone.update(range(i, i + n))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_by_brute_force(rows, length=400):
    texts = [(doc, (text or "").encode()) for doc, text, *_ in rows]
    count = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_phrases(spark, block_bytes):
    found = substring.remove_repeated_phrases(documents(spark))
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == phrases_by_brute_force(hard_documents())


def test_bytes(spark, block_bytes):
    found = suffix.remove_repeated_bytes(documents(spark))
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_by_brute_force(hard_documents())


def test_short_windows(spark, block_bytes):
    rows = hard_documents()[:30]
    found = suffix.remove_repeated_bytes(documents(spark, rows), length=40, gram=16)
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_by_brute_force(rows, 40)


def test_chunks_of_long_texts(monkeypatch):
    text = bytes(hard_documents()[-7][1], "utf8") * 2
    whole = {x for t, s, n in suffix.phrases(text, 400, 128) for x in range(s, s + n)}
    monkeypatch.setattr(suffix, "CHUNK", 5000)
    parts = [x for t, s, n in suffix.phrases(text, 400, 128) for x in range(s, s + n)]
    assert sorted(parts) == sorted(whole) == list(range(len(text) - 399))


def test_texts_without_repeats(spark):
    kept = substring.without_repeated_phrases(documents(spark))
    assert kept.columns == documents(spark).columns
    want = defaultdict(list)
    for doc, _, removed, digest in phrases_by_brute_force(hard_documents()):
        want[doc].append((removed, digest))
    given = {(r[0], r[1]) for r in hard_documents()}
    for r in kept.collect():
        digest = hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()
        assert any(d == digest and (n or (r.doc_id, r.text) in given) for n, d in want[r.doc_id])


@pytest.mark.parametrize("work", [substring.remove_repeated_phrases, suffix.remove_repeated_bytes, substring.without_repeated_phrases])
def test_empty(spark, work):
    assert work(spark.createDataFrame([], DOCS)).count() == 0
