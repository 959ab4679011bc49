"""Tokenization and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fluxlake.llm import bpe, token_binary
from fluxlake.session import fresh_path
from tests.llm.conftest import ODD

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t\x0b\x1c\x85 'stdhelo.,!1é漢<|>", max_size=60)))
def test_ids_equal_the_library(text):
    codec = bpe.codec(PATH)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library(text)
    assert codec.decode(ids) == LIBRARY.decode(library(text), skip_special_tokens=False) == text
    assert token_binary.library_encoder(PATH)[0](text) == ids


def test_repeats_and_special_tokens():
    codec = bpe.codec(PATH)
    for text in ["a" * n for n in range(1, 60)] + ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "abab" * 30, "́" * 20]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library(text)


def test_automaton_of_random_merges_equals_merging():
    rng = random.Random(3)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(12):
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        automaton = bpe.Automaton(vocab, merges, {})
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            while True:
                ranked = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert automaton.path(word.encode()) == [vocab[p] for p in parts], (merges, word)


def test_memory_is_bounded(monkeypatch):
    made = []
    kept = bpe._Kept(lambda k: made.append(k) or k, 4)
    for k in [1, 2, 3, 4, 1, 5, 1, 6, 7, 8, 1]:
        assert kept[k] == k
    assert len(kept) + len(kept.old) <= 8 and made.count(1) == 1


def test_encoding_odd_rows(table):
    rows = ODD + [(40, "word\n" * 30_000, None, None)]
    got = bpe.encode_documents(table(rows), PATH, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted(hashlib.sha256(np.array(library(t), "<u4").tobytes()).hexdigest() for _, t, *_ in rows)
    assert sorted(r.ids_sha256 for r in got) == want
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t, *_ in rows)
    assert bpe.encode_documents(table(rows).where("false"), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 31).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, (1 << bits) - 1), max_size=60))), st.data())
def test_packing_round_trip(case, data):
    bits, ids = case
    packed = token_binary.pack(np.array(ids, "<u4"), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert token_binary.unpack(packed, bits, start, stop).tolist() == ids[start:stop]


def test_widths():
    assert [token_binary.width(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        token_binary.pack(np.array([8]), 3)


def test_files_hold_everything_in_order(spark, real, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 500)
    folder = fresh_path(spark, "ids")
    token_binary.write_ids(real, folder, PATH)
    got = {r.doc_id: r for r in token_binary.read_documents(spark, folder, with_ids=True).collect()}
    start, every = 0, []
    for r in real.select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*library(r.text), 0], "<u4")
        row = got.pop(r.doc_id)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())) and row.ids == ids.tolist()
        start += len(ids)
        every.append(ids)
    assert not got
    whole = np.concatenate(every)
    for a, b in ((0, 1), (123, 4567), (start - 5, start), (7, 7), (0, start)):
        assert token_binary.read_range(spark, folder, a, b).tolist() == whole[a:b].tolist()


def test_files_of_odd_rows(spark, table):
    folder = fresh_path(spark, "ids")
    token_binary.write_ids(table(ODD), folder, PATH)
    got = token_binary.read_documents(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 4, 5, 6]
    assert sum(r.n_tokens for r in got) == sum(len(library(t)) + 1 for _, t, *_ in ODD)
    empty = fresh_path(spark, "ids")
    token_binary.write_ids(table(ODD).where("false"), empty, PATH)
    assert token_binary.read_documents(spark, empty).count() == 0
