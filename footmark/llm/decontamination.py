"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, texts scanned once.

Normalisation works on UTF-8 bytes: A-Z become lower case, every other ASCII byte that is no letter or digit becomes
a space, words are joined by one space.  The patterns are the n-word windows of all items between spaces, so a match
always covers whole words.  Matches are mapped to word numbers and, for the spans, to places in the original text.

The items are a benchmark, not a corpus: their size is checked against ``max_item_bytes`` before they go to the
driver and, as patterns, to every executor.

Nulls and edge cases: a null or empty text has no words and is clean; an item without words matches nothing; a null
``item_id`` counts as the id "null"; items with one id count once; a null ``doc_id`` and repeated rows are kept.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import arrow_map, slices

#: Lower case for A-Z; a space for the other ASCII characters but digits and letters.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split(b" ") if text else []


def item_windows(items: list[tuple[str, str | None]], n: int) -> dict[bytes, list[str]]:
    """Item ids by window; a shorter item is one window."""
    found: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        words = [w for w in words_of(text) if w]
        for i in range(max(1, len(words) - n + 1) if words else 0):
            found[b" ".join(words[i:i + n])].add(item)
    return {w: sorted(x) for w, x in found.items()}


def build_automaton(windows: dict[bytes, list[str]]):
    """Each byte is one character of the patterns."""
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for window, items in windows.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, items))
    automaton.make_automaton()
    return automaton


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the original text."""
    at = np.frombuffer(text.encode(), np.uint8)
    part = np.frombuffer(TABLE, np.uint8)[at] != 32
    edge = np.flatnonzero(np.diff(np.r_[False, part, False]))
    starts, ends = edge[::2], edge[1::2]
    point = np.r_[0, np.cumsum((at & 0xC0) != 0x80)]
    run = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    return [{"start": int(point[starts[a]]), "end": int(point[ends[b - 1]])} for a, b in zip(run[::2], run[1::2])]


def scan(text: str | None, automaton) -> tuple[int, np.ndarray, list[str]]:
    """Number of words, which of them are hit, and the items found."""
    words = [w for w in words_of(text) if w]
    hit, items = np.zeros(len(words), bool), set()
    if words and automaton:
        flat = f" {b' '.join(words).decode('latin-1')} "
        found = list(automaton.iter(flat))
        if found:
            # A match ends at the space after its last word.
            after = np.cumsum(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
            for end, (size, names) in found:
                last = int(after[end]) - 1
                hit[last - size:last] = True
                items.update(names)
    return len(words), hit, sorted(items)


def shared_windows(benchmark: DataFrame, n: int, max_item_bytes: int):
    """The windows of all items as a broadcast variable, after a check of their size."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > max_item_bytes:
        raise ValueError(f"the benchmark has {size} bytes; more than max_item_bytes = {max_item_bytes}")
    items = [(str(r["item_id"]) if r["item_id"] is not None else "null", r["text"])
             for r in benchmark.select("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast(item_windows(items, n))


SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_item_bytes: int = 64 << 20) -> DataFrame:
    """Per document: n_words, n_hit, the items that occur, and the hit spans of the original text."""
    shared = shared_windows(benchmark, n, max_item_bytes)

    def work(batches):
        automaton = build_automaton(shared.value) if shared.value else None
        for batch in slices(batches):
            out = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                size, hit, items = scan(text, automaton)
                for name, value in (("doc_id", doc), ("n_words", size), ("n_hit", int(hit.sum())), ("item_ids", items),
                                    ("spans", original_spans(text, hit) if items else [])):
                    out[name].append(value)
            yield out

    return arrow_map(docs.select("doc_id", "text"), work, SCHEMA)


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    found = find_contamination(docs, benchmark, n)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "item_ids", "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_item_bytes: int = 64 << 20) -> DataFrame:
    """Documents without a hit, with all their columns; no shuffle."""
    shared = shared_windows(benchmark, n, max_item_bytes)

    def work(batches):
        automaton = build_automaton(shared.value) if shared.value else None
        for batch in batches:
            clean = [not scan(t.as_py(), automaton)[2] for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
