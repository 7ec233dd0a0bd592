"""Phrase collocations against a count of everything, at thresholds that leave much uncounted."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_helpers import DOCS, documents, hard_documents

from footmark.llm import collocation


def by_brute_force(rows, top, at_least, keep=(80, 100)):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= at_least}
        longer = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i:i + n]] = max(longer[p[i:i + n]], a)
        scored = []
        for p, a in found.items():
            if keep[1] * longer[p] >= keep[0] * a:
                continue
            s, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "a", "to", "is", "wéb", "ﬁ", "日本"]
    fixed = [["new", "york", "city", "hall"], ["as", "well", "as"], ["of", "the"], ["red", "Red", "RED", "red"], ["x\x1cy", "z"], ["ad", "hoc"]]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(common)]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), None, 0, None, None, None))
    return rows + hard_documents()


@pytest.mark.parametrize("seed, top, at_least", [(1, 2000, 3), (1, 5, 3), (1, 20, 2), (2, 1, 4), (2, 9, 2)])
def test_all_counts(spark, seed, top, at_least):
    rows = corpus(seed)
    found = collocation.best_phrases(documents(spark, rows), top, at_least).collect()
    want = by_brute_force(rows, top, at_least)
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_lower_thresholds_until_enough_survive(spark, monkeypatch):
    """Every pair is taken in by a longer phrase: the best pairs leave no survivor."""
    rows = [(i, ". ".join(f"p{k} q{k} r{k} s{k}" for k in range(40)), "en", None, 0, None, None, None) for i in range(4)]
    rows += [(9, ". ".join(f"u{k} v. u{k}" for k in range(30)) + " v. v", "en", None, 0, None, None, None)] * 3
    rounds = []
    plain = collocation.grow
    monkeypatch.setattr(collocation, "grow", lambda *a: rounds.append(a[2].first()["threshold"]) or plain(*a))
    found = collocation.best_phrases(documents(spark, rows), 50, 3).collect()
    assert {tuple(r) for r in found} == by_brute_force(rows, 50, 3)
    assert len(rounds) > 1 and sorted(rounds, reverse=True) == rounds


def test_large_counts_are_exact(spark):
    n = 9_000_000_000_000_000_000
    row = spark.range(1).selectExpr(f"{n} a", f"{n} l", f"{n} - 1 r").select(collocation.score("a", "l", "0").alias("s"), collocation.score("a", "l - 10", "10").alias("t"))
    assert tuple(row.first()) == (2_000_000, 2_000_000)


def test_empty(spark):
    assert collocation.best_phrases(spark.createDataFrame([], DOCS)).count() == 0
    assert collocation.best_phrases(spark.createDataFrame([(1, None, None, None, 0, None, 0, 0)], DOCS)).count() == 0
