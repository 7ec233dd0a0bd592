"""Packing: the tokenizer's own ids, full sequences, the plan's counters."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_helpers import DOCS, documents, hard_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from footmark.llm import packing
from footmark.llm.queries import tokenizer_path

WORDS = packing.WordIds(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "É", "İ", "Σ", "ß", "'", "'s", ".", "<|endoftext|>", "12", "́", "漢", " ", "  ", "\n", "\x1c",
                                 "\x85", "\xa0", "don't", "(x)", "_", "THE", "🙂"]) | st.text(max_size=3), max_size=12))
def test_words_have_the_ids_of_the_text(parts):
    text = "".join(parts)
    words = packing.split_words(text)
    WORDS.learn(set(words))
    assert b"".join(map(WORDS.words.__getitem__, words)) == WORDS.encode(text).tobytes()


def test_few_words_are_kept():
    few = packing.WordIds(tokenizer_path(), most=5)
    for text in ("one two three four", "five six seven, eight", "one (two) three"):
        few.learn(set(text.split()))
        assert b"".join(map(few.words.__getitem__, text.split())) == few.encode(text).tobytes()


def test_words_in_use_are_encoded_once(monkeypatch):
    few, seen, encode = packing.WordIds(tokenizer_path(), most=3), [], packing.WordIds.encode
    monkeypatch.setattr(packing.WordIds, "encode", lambda self, text: (seen.extend(text.split()), encode(self, text))[1])
    for text in ("one two", "one Three, four", "One five three.", "one six"):
        few.learn(set(text.split()))
        assert b"".join(map(few.words.__getitem__, text.split())) == encode(few, text).tobytes()
        assert len(few.words) <= 6 and len(few.older) <= 6
    assert Counter(seen)["one"] == 1 and Counter(seen)["three"] == 1


def test_pieces_and_places(spark):
    rows = packing.packed_documents(documents(spark), tokenizer_path(), keep_ids=True).collect()
    want = Counter()
    for doc, text, *_ in hard_documents():
        ids = np.r_[WORDS.encode(text or ""), np.zeros(1, "<u4")].astype("<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at:at + 2048]
            want[doc, k, at, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    gapless(rows, 2048)


def gapless(rows, limit):
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        assert at[r.sequence_id] <= limit


def test_ranks_over_buckets(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i % 7, i) for i in range(500)], packing.PIECES)
    rows = packing.pack(pieces, limit=12, per_bucket=10).collect()
    assert len(rows) == 500
    gapless(rows, 12)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 12)


def test_plan_uses_each_piece_once():
    rng = random.Random(2)
    for limit in (1, 7, 64, 300):
        for _ in range(20):
            counts = {rng.randint(1, limit): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
            used = Counter()
            for pattern, times in packing.plan_sequences(counts, limit):
                assert sum(pattern) <= limit and times > 0
                for length in pattern:
                    used[length] += times
            assert used == Counter(counts)


def test_exact_complements_come_first():
    plan = packing.plan_sequences({60: 1, 40: 1, 50: 1, 30: 1, 20: 1, 70: 1, 15: 2, 10: 1, 90: 1}, 100)
    assert sum(n for p, n in plan if sum(p) == 100) == 4 and sum(n for _, n in plan) == 4


def test_empty(spark):
    assert packing.packed_documents(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
