"""Small tables with the cases every operator must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, block int, label long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def hard_documents() -> list[tuple]:
    """Exact and near copies, shared passages, self-repeats, long runs, empty and null texts, null and repeated ids."""
    rng = random.Random(5)
    texts: list = []
    base = [sentence(rng, 120) for _ in range(6)]
    passage = sentence(rng, 70)
    for b in base:
        texts += [b, b]
        words = b.split()
        for k in (10, 60):
            near = list(words)
            near[k] = "changed"
            texts.append(" ".join(near))
    for _ in range(8):
        texts.append(f"{sentence(rng, 30)}\n{passage}\t{sentence(rng, 25)}")
    texts += [passage, passage + " " + passage, "ab cd " * 400, "ab cd " * 300, "x" * 3000, "é" * 1000, " \n ", "", None, "one", "one two",
              "one two three four five", "Straße déjà\x0bvu\x1cnoch\x85mehr " * 30, "Straße déjà\x0bvu\x1cnoch\x85mehr " * 31,
              sentence(rng, 20000)]
    rows = [(i, t, "en" if i % 2 else None, None, None if t is None else len(t), "p", i, 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[0], None, None, 0, None, None, None), (None, sentence(rng, 50), "de", "s", 1, "q", 1, 1),
             (None, None, None, None, None, None, None, None), (3, sentence(rng, 40), "en", "s", 1, "q", 1, 1)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(hard_documents() if rows is None else rows, DOCS).repartition(5)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
