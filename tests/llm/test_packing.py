"""Packing against the tokenizers library and the rules of a packing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxlake.llm import packing
from tests.llm.conftest import ODD

PATH = packing.default_tokenizer()
ENCODE = packing.WordEncoder(PATH)


def library(text):
    return ENCODE.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t\x0b\x1c\x85\xa0'stdhelo.,!*1éÉß×İΣς漢<|>", max_size=60)))
def test_ids_equal_the_library(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == library(text)


def test_odd_words():
    for text in ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>, b. c", "don't. 'Sword ..., x.", "Å K ẞ", "a" * 5000, "word," * 400, "don't, we'll. x', y"]:
        assert np.frombuffer(ENCODE(text), "<u4").tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 9))
def test_differencing_deals_every_item_once(sizes, windows):
    dealt, sums = packing.differencing(sizes, windows)
    assert sorted(i for items in dealt for i in items) == list(range(len(sizes)))
    assert [sum(sizes[i] for i in items) for items in dealt] == sums.tolist() == sorted(sums.tolist(), reverse=True)


def test_differencing_is_near_equal():
    assert packing.differencing([8, 7, 6, 5, 4], 2)[1].tolist() == [16, 14]
    sizes = np.random.default_rng(5).integers(1, 1000, 400).tolist()
    assert np.ptp(packing.differencing(sizes, 20)[1]) <= 3


def test_window_count_rises_when_capacity_is_exceeded():
    dealt, sums = packing.balanced([60, 60, 60], 100)
    assert sums.tolist() == [60, 60, 60] and len(dealt) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=80))
def test_packer_covers_every_id_once(sizes):
    packer = packing.Packer(64, 4)
    pieces = [p for i, n in enumerate(sizes) for p in packer.add(i, b"\0\0\0\0" * n)] + packer.finish()
    of, sequences = defaultdict(list), defaultdict(list)
    for document, start, length, sequence, offset in pieces:
        of[document.name].append((start, length))
        sequences[sequence].append((offset, length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(of[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= packing.LEAST_PIECE * len(sequences)


def check(rows, texts):
    """Rows of ``pack_documents`` against ``texts``, a list of ``(id, text)`` without repeated ids."""
    whole = {name: library(text) + [packing.END_ID] for name, text in texts}
    at, sequences = defaultdict(int), defaultdict(list)
    for row in sorted(rows, key=lambda r: r.start):
        ids = whole[row.doc_id]
        assert row.start == at[row.doc_id] and row.doc_tokens == len(ids)
        at[row.doc_id] += row.length
        assert row.ids_crc32 == zlib.crc32(np.array(ids[row.start:row.start + row.length], "<u4").tobytes())
        sequences[row.sequence_id].append((row.offset, row.length))
    assert at == {name: len(ids) for name, ids in whole.items()}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    return [sum(n for _, n in pieces) for pieces in sequences.values()]


def test_packs_whole_table(real):
    sizes = check(packing.pack_documents(real, PATH).collect(), [(r.doc_id, r.text) for r in real.collect()])
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes) <= 0.002 * sum(sizes)


def test_odd_rows(spark, table):
    rows = packing.pack_documents(table(ODD), PATH, with_ids=True).collect()
    assert sorted((r.doc_tokens for r in rows if r.doc_id == 4)) == [4, 4]
    assert sum(r.doc_id is None for r in rows) == 2
    assert {r.doc_id: r.ids for r in rows if r.doc_id in (1, 2, 3)} == {1: [2], 2: [2], 3: [2]}
    assert packing.pack_documents(table([]).limit(0), PATH).collect() == []
    long = "some words, " * 60_000
    check(packing.pack_documents(table([(1, long), (2, "x")]), PATH).collect(), [(1, long), (2, "x")])
    named = spark.createDataFrame([("b", "one", 1, 2), ("a", None, 3, 4)], "name string, body string, start int, sequence_id int")
    check(packing.pack_documents(named, PATH, id_col="name", text_col="body").collect(), [("b", "one"), ("a", None)])
    with pytest.raises(ValueError):
        packing.pack_documents(named, PATH, capacity=100)
