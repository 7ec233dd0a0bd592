"""Language identification by nearest centroids.

A text becomes the counts of its letter trigrams (lower case, words padded by one space, every other character a
word border), hashed into ``DIMS`` buckets, weighted log(1 + count) * idf and scaled to length one.  Each language
has several centroids, found by spherical k-means, and a text takes the language of the centroid with the largest
cosine.  A text is rejected if its distance to that centroid is far beyond what the training texts show; texts of few
distinct trigrams, short ones or a word over and over, are allowed a proportionally larger distance.

Fitting uses a bounded sample: at most about ``per_language`` labelled texts of each language, chosen by a hash of
the id, and at most ``max_languages`` languages.  Prediction reads whole texts of all rows, and nothing but the text.

Nulls and edge cases: a null text or one without letters is "und" with score 0 and rejected; rows with a null label
are not learned from; a null ``doc_id`` is never held out; with no labelled rows every text is "und"; repeated rows
and other columns are kept apart; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices

DIMS = 4096
TYPICAL = 200  # distinct trigrams at which a text counts as half as telling as a long one


@cache
def letter_table() -> np.ndarray:
    """For every code point: 2 if it is a letter, 1 if it is a mark (which belongs to the word it stands in), else 0."""
    import unicodedata
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Hashed trigram counts; null without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = letter_table()[points]
    letter = kinds > 0
    if not (kinds == 2).any():
        return None
    p = np.zeros(len(points) + 2, np.uint32)
    np.multiply(points, letter, out=p[1:-1])
    a, b, c = p[:-2], p[1:-1], p[2:]
    gram = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    gram = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    return np.bincount(gram[b != 0], minlength=DIMS).astype(np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reach: float  # least cosine of a long text that is not rejected

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, whether it is rejected."""
        counts = trigram_counts(text)
        if counts is None or not self.languages:
            return "und", 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.languages[best], score, score < self.reach * expected(np.count_nonzero(counts))


def expected(n: float) -> float:
    """Part of a long text's cosine that a text of n distinct trigrams can reach."""
    return float(np.sqrt(n / (n + TYPICAL)))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of length one; starts are spread: each is the row farthest from those before."""
    centers = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        centers.append(rows[int(np.max(rows @ np.array(centers).T, axis=1).argmin())])
    found = np.array(centers)
    for _ in range(rounds):
        own = (rows @ found.T).argmax(axis=1)
        found = np.array([rows[own == i].sum(axis=0) if (own == i).any() else found[i] for i in range(len(found))])
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


def fit(labelled: DataFrame, per_language: int = 300, max_languages: int = 100, clusters: int = 4,
        slack: float = 0.5) -> Model:
    """Learns from (doc_id, text, lang).  A text farther than 1 - slack * (the 0.1 % quantile of the training
    cosines, scaled to the number of distinct trigrams) is rejected."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than max_languages = {max_languages} languages")
    if not sizes:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(DIMS, np.float32), 0.0)
    parts = 1 << 30
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(parts, parts * per_language // r["n"] + 1))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < share[F.col("lang")]).select("lang", "text")

    def work(batches):
        for batch in slices(batches):
            out = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts = trigram_counts(text)
                if counts is not None:
                    used = np.flatnonzero(counts)
                    out["lang"].append(lang)
                    out["used"].append(used)
                    out["counts"].append(counts[used])
            if out:
                yield out

    rows = arrow_map(chosen, work, "lang string, used array<int>, counts array<float>").collect()
    by_lang = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["lang"], r["used"], r["counts"])):
        counts = np.zeros(DIMS, np.float32)
        counts[r["used"]] = r["counts"]
        by_lang[r["lang"]].append(counts)
    every = np.concatenate([np.array(x) for x in by_lang.values()]) if by_lang else np.zeros((0, DIMS), np.float32)
    idf = (np.log((1 + len(every)) / (1 + (every > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model([], np.zeros((0, DIMS), np.float32), idf, 0.0)
    centroids, cosines = [], []
    for lang, counts in sorted(by_lang.items()):
        vectors = np.array([model.vector(c) for c in counts])
        own = spherical_kmeans(vectors, clusters)
        centroids.append(own)
        model.languages += [lang] * len(own)
        cosines += [float(c / expected(n)) for c, n in zip((vectors @ own.T).max(axis=1), (np.array(counts) > 0).sum(axis=1))]
    if centroids:
        model.centroids = np.concatenate(centroids).astype(np.float32)
        model.reach = slack * float(np.quantile(cosines, 0.001))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*found)
            yield {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "rejected": rejected}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), work,
                     "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> "F.Column":
    """True for a third of the documents, chosen by the checksum of the id; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **settings) -> DataFrame:
    """Learns from the documents that are not held out, predicts all."""
    model = fit(docs.where(~held_out()), **settings)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted_documents(docs: DataFrame, **settings) -> DataFrame:
    """Documents whose language is found, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out()), **settings))

    def work(batches):
        for batch in batches:
            keep = [not shared.value.predict(t.as_py())[2] for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
