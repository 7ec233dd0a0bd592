"""Spelling variants against all pairs, partitions of every size, hard texts."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, documents, hard_documents

from footmark.llm import spelling


def near(x: str, y: str) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def counted(rows, alter=199):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % alter == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def by_brute_force(counts):
    partners = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(partners[w]), counts[form[w]] if form[w] else None))
    return rows


def words_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", min_size=2, max_size=6), min_size=1, max_size=25), st.integers(2, 5), st.data())
def test_pairs_of_windows(words, m, data):
    c = data.draw(st.integers(1, m))
    a = data.draw(st.integers(0, c - 1))
    group = [w for w in words if len(w) in (m, m + 1)]
    if group:
        group = [w for w in group if w[:a] == group[0][:a] and w[len(w) - (m - c):] == group[0][len(group[0]) - (m - c):]]

        def first(x, y):
            return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

        want = sorted(tuple(sorted((x, y))) for x in group for y in group if (len(x), x) < (len(y), y) and near(x, y) and len(x) == m
                      and (a <= first(x, y) < c or first(x, y) == c == m))
        assert sorted(tuple(sorted(p)) for p in spelling.pairs_of_window(group, m, a, c)) == want


@pytest.mark.parametrize("partition", [3, 40, spelling.PARTITION])
def test_all_pairs(spark, partition):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(700)}
    words |= {"aaaa" + "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 4))) for _ in range(300)} | {"x" * 4000, "x" * 4001, "x" * 2000 + "y" + "x" * 1999}
    counts = {w: rng.choice([1, 1, 5, 25, 300]) for w in words}
    found = spelling.near_words(words_table(spark, counts), 3, partition).collect()
    want = {w: (len(p), *min((-counts[v], v) for v in p)) for w in words if (p := [v for v in words if near(w, v)])}
    assert {r.word: (r.n_near, -r.form_n, r.form) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("alter", [199, 3])
def test_documents(spark, alter):
    rng = random.Random(3)
    base = ["spelling", "speling", "spellings", "Spellinx", "naïveté", "naiveté", "naïvetés", "×÷×÷×÷", "letters", "lettres", "better"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ",", "1", "s", "ÿ"]) for _ in range(300)), None, None, 0, None, None, None) for i in range(30)]
    rows += hard_documents()
    words = {w: n for w, n in counted(rows, alter).items() if n >= 5}
    found = spelling.spelling_variants(documents(spark, rows), alter_every=alter).collect()
    assert len(found) == len(words) and {tuple(r) for r in found} == by_brute_force(words)


def test_chains_end_in_roots(spark):
    names = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    rows = [(i, " ".join(w for w, n in zip(names, (5, 25, 125, 625, 3125, 15625)) for _ in range(n)), None, None, 0, None, None, None) for i in range(1)]
    found = {r.word: (r.form, r.root) for r in spelling.spelling_variants(documents(spark, rows), alter_every=0).collect()}
    assert found == {w: (f, names[-1]) for w, f in zip(names, [*names[1:], None])}


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, None, None, 0, None, 0, 0)], DOCS)).count() == 0
