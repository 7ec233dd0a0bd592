"""The registered queries: SQL twins, the pipeline's stages, the entry without them."""

import os
import sys

import zlib
from collections import Counter

import numpy as np
import pytest
from test_jaccard import by_brute_force
from test_text import lowered_words

import __spark_entry__ as entry
import corpus_pipeline
from footmark.llm import language
from footmark.llm.oracle import ORACLE
from footmark.llm.queries import QUERIES, tokenizer_path

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    assert difference(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, work in corpus_pipeline.STAGES[:-1]:
        after = work(spark, before, SF)
        assert after.columns == columns and after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= before.count()
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def kept_phrases(texts: dict[int, str], n: int = 13) -> dict[int, str]:
    first: dict = {}
    words = {d: t.encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i:i + n]), d)
    out = {}
    for d, own in words.items():
        gone = {j for i in range(len(own) - n + 1) if first[tuple(own[i:i + n])] < d for j in range(i, i + n)}
        out[d] = b" ".join(w for j, w in enumerate(own) if j not in gone).decode() if gone else texts[d]
    return out


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    rows = [(r.doc_id, r.text) for r in docs.collect() if not model.predict(r.text)[2]]
    firsts = {c for _, c, _ in by_brute_force(rows)}
    texts = kept_phrases({d: t for d, t in rows if d in firsts})
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = lowered_words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = lowered_words(text)
        return not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for d, t in texts.items():
        if clean(t):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
            for k, at in enumerate(range(0, len(ids), 2048)):
                want[d, k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())] += 1
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert 0 < len(texts) < docs.count()
