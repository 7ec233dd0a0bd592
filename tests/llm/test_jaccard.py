"""The chosen-path join against all pairs, with nodes and tiles small enough to be split."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_helpers import DOCS, documents, hard_documents

from footmark.llm import jaccard


def by_brute_force(rows):
    named = [(d, frozenset(jaccard.shingles(t, 5).tolist())) for d, t, *_ in rows if d is not None and t and t.split()]
    near = [(i, j) for i, j in combinations(range(len(named)), 2)
            if len(named[i][1] & named[j][1]) >= 0.8 * len(named[i][1] | named[j][1]) - 1e-9]
    label, links = list(range(len(named))), [0] * len(named)
    for i, j in near:
        links[i] += 1
        links[j] += 1
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    first = defaultdict(lambda: 1 << 62)
    for (d, _), x in zip(named, label):
        first[x] = min(first[x], d)
    out = [(d, first[x], n) for (d, _), x, n in zip(named, label, links)]
    out += [(d, d, 0) for d, t, *_ in rows if d is None or not t or not t.split()]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


def test_join(spark):
    assert result(jaccard.join_similar(documents(spark))) == by_brute_force(hard_documents())


def test_small_nodes_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "TILE", 2)
    assert result(jaccard.join_similar(documents(spark))) == by_brute_force(hard_documents())


def test_large_near_group(spark, monkeypatch):
    """One group of near copies, all different, that is too large for a node."""
    monkeypatch.setattr(jaccard, "SMALL", 50)
    monkeypatch.setattr(jaccard, "TILE", 40)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        words[(7 * i) % 200] = f"x{i}"
        rows.append((i, " ".join(words), None, None, 0, None, None, None))
    assert result(jaccard.join_similar(documents(spark, rows))) == by_brute_force(rows)


def test_pairs_that_share_frequent_passages(spark, monkeypatch):
    """Nearly all that the two texts of a pair share is frequent, so that their nodes are large and split to the end."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{i}w{j}" for j in range(100)) for i in range(16)]
    chosen = set()
    while len(chosen) < 300:
        chosen.add(tuple(sorted(rng.choice(16, 3, replace=False).tolist())))
    rows = []
    for i, own in enumerate(sorted(chosen)):
        for side in (0, 1):
            tail = " ".join(f"u{i}s{side}w{j}" for j in range(33))
            rows.append((2 * i + side, " ".join([passages[p] for p in own] + [tail]), None, None, 0, None, None, None))
    sets = [set(jaccard.shingles(r[1], 5).tolist()) for r in rows]
    assert all(0.8 <= len(a & b) / len(a | b) <= 0.82 for a, b in zip(sets[::2], sets[1::2]))
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_similar(documents(spark, rows)).collect()}
    assert found == {d: (d - d % 2, 1) for d in range(600)}


def test_runs_part_few_pairs():
    """Pairs at the threshold, by which coordinates agree: how many part in all runs that paths of each length have."""
    agree = np.random.default_rng(8).random((400_000, jaccard.COORDINATES)) < 0.8
    for steps in (1, 2, 3):
        parted = np.ones(len(agree), bool)
        for run in range(jaccard.runs_for(0.8, 1 - 1e-5 / 3, steps)):
            parted &= ~agree[:, [jaccard.coordinate_of(run, s, 3) for s in range(steps)]].all(axis=1)
        assert parted.sum() <= 8  # at 1e-5: 4 expected
    assert [jaccard.runs_for(0.8, 1 - 1e-5 / 3, d) for d in (1, 2, 3)] == [8, 13, 18]
    assert all(len({jaccard.coordinate_of(r, s, 3) for s in range(3)}) == 3 for r in range(18))


def test_one_row_per_class(spark):
    rows = hard_documents()
    words = [w.split() for w in (rows[0][1], rows[4][1])]
    rows += [(1, "a text of its own " * 3, None, None, 0, None, None, None), (0, rows[4][1], None, None, 0, None, None, None)]
    rows += [(None, "null copies that meet here today", None, None, 0, None, None, None)] * 2 + [(5, " ".join(words[0][:60]), None, None, 0, None, None, None)] * 2
    kept = jaccard.one_per_class(documents(spark, rows))
    numbered = [(i, t) for i, (_, t, *_) in enumerate(rows)]
    classes = defaultdict(list)
    for i, c, _ in by_brute_force(numbered):
        classes[c].append((rows[i][0] is None, rows[i][0] or 0, i))
    want = sorted((rows[min(c)[2]][:2] for c in classes.values()), key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == want and kept.columns == documents(spark).columns


def test_signatures_meet_the_threshold():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        b = np.r_[a[:270], rng.integers(0, 1 << 62, 30).astype(np.uint64)]
        assert (jaccard.signature(a) == jaccard.signature(b)).mean() >= jaccard.AGREE


@pytest.mark.parametrize("work", [jaccard.join_similar, jaccard.one_per_class])
def test_empty(spark, work):
    assert work(spark.createDataFrame([], DOCS)).count() == 0
