"""Packing by powers of two: the tokenizer's own ids, pieces of binary lengths, one piece a sequence."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, documents, hard_documents

from footmark.llm import binary_packing as packing
from footmark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
IDS = packing.ByteIds(PATH)
ODD = ["a", "B", "é", "İ", "ß", "'", "'s", "'re", ".", "<|endoftext|>", "12", "½", "²", "´", "漢", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0",
       "　", " ", "don't", "(x)", "_", "THE", "🙂", "́", "ʼ", "ª", "\x00", "ƀ"]


def own(text):
    """Ids by the tokenizer itself."""
    return np.array(IDS.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.text(max_size=3), max_size=12).map("".join))
def test_ids_of_the_tokenizer(text):
    assert np.array_equal(IDS.encode(text), own(text))


def test_every_character_is_cut_alike():
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(characters), 5000):
        text = ".".join(f"a{c}1{c} {c}  {c}b" for c in characters[at:at + 5000])
        assert np.array_equal(IDS.encode(text), own(text))


@pytest.mark.parametrize("part", [" ", "x", "\n", " x", "é"])
def test_long_texts(part):
    text = part * 200_000 + "a"
    assert np.array_equal(IDS.encode(text), own(text))


def test_white_space_that_only_the_tokenizer_cuts():
    text = " " * 1_000_000 + "a"
    with pytest.raises(ValueError):
        IDS.fast.encode_to_numpy(text)
    assert np.array_equal(IDS.encode(text), own(text))


@given(st.integers(0, 1 << 40), st.integers(0, 12))
def test_lengths(n, k):
    if n >> k < 10_000:
        lengths = packing.binary_lengths(n, 1 << k)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and all(x.bit_count() == 1 for x in lengths)
        assert all(c == 1 for x, c in Counter(lengths).items() if x < 1 << k)


@pytest.mark.parametrize("limit", [1, 8, 1024])
def test_pieces_and_sequences(spark, limit):
    rows = packing.packed_documents(documents(spark), PATH, limit, keep_ids=True, batch_tokens=64).collect()
    want = Counter()
    for doc, text, *_ in hard_documents():
        ids, at = own(text or "").tobytes() + bytes(4), 0
        for length in packing.binary_lengths(len(ids) // 4, limit):
            want[doc, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), len(ids) // 4] += 1
            at += length
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.offset == 0 for r in rows)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    batches = defaultdict(list)
    for r in rows:
        batches[r.length, r.batch].append(r.sequence_id)
    for (length, _), ids in batches.items():
        assert len(ids) <= max(1, 64 // length) and max(ids) - min(ids) == len(ids) - 1
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)


def test_limit_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.packed_documents(documents(spark), PATH, 1000)


def test_empty(spark):
    assert packing.packed_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_end_token_ids_are_in_place():
    assert IDS.encode("a<|endoftext|>b")[1] == 50256
