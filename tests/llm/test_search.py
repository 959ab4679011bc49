"""Ranked search against a plain ranking, and the prefix trie against a plain trie."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluxlake.llm import lexical, prefix_trie
from tests.llm.conftest import ODD

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, top=20):
    """``{item: [(doc, score), ..]}`` by definition; ``docs`` and ``items`` are lists of ``(id, text)``."""
    counts = [(name, Counter(words(text))) for name, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for name, text in items:
        asked[name].update(words(text))
    out = {}
    for item, terms in asked.items():
        found = []
        for name, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in terms.items() if c[t])
            if score > 0:
                found.append((-score, name is None, name, score))
        out[item] = [(name, score) for _, _, name, score in sorted(found, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:top]]
    return {k: v for k, v in out.items() if v}


def found(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: r.rank):
        assert row.rank == len(out[row.item_id]) + 1
        out[row.item_id].append((row.doc_id, row.score))
    return dict(out)


def test_terms():
    for text in ["A-b_C1é×Σ x\x00y", "", None, "ÀB\x7fc\x80d", "a b\xa0c"]:
        assert [t.decode() for t in lexical.terms_of(text)] == words(text)


@pytest.mark.parametrize("rows, bundle, owners, limit", [(4096, 64, 4, 1 << 26), (37, 3, 4, 1 << 26), (37, 3, 2, 0)])
def test_search_equals_plain_ranking(spark, real, monkeypatch, rows, bundle, owners, limit):
    for name, value in (("SLICE_ROWS", rows), ("BUNDLE_ITEMS", bundle), ("OWNERS", owners), ("TERM_BYTES", limit)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(9)
    got = found(lexical.search(real, items).collect())
    assert got == plain_search([(r.doc_id, r.text) for r in real.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_of_odd_rows(spark, table):
    items = [(1, "one TWO two"), (1, "three"), (2, None), (None, "é 12"), (3, ""), (4, "nowhere")]
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], "item_id bigint, text string, score int, term string, rank int")
    got = found(lexical.search(table(ODD), frame).collect())
    assert got == plain_search([(r[0], r[1]) for r in ODD], items)
    assert [name for name, _ in got[1]] == [4, 4, 5, None]
    empty = table([]).limit(0)
    assert lexical.search(empty, frame).collect() == lexical.search(table(ODD), frame.limit(0)).collect() == []


def test_search_of_ties_and_long_texts(spark, table):
    docs = [(i, "same words here" if i % 2 else "other") for i in range(300)] + [(1000, "same " * 100_000)]
    items = spark.createDataFrame([("a", "same words"), ("b", "words words")], "item_id string, text string")
    got = found(lexical.search(table(docs), items).collect())
    assert got == plain_search(docs, [("a", "same words"), ("b", "words words")])
    assert [name for name, _ in got["b"]] == list(range(1, 41, 2))


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in children[p])
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[min(m), len(p)] = (parent, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, hi string, conv int"


def trie(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 7, "x", 3) for r in rows], TURNS)).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(out) == len(got)
    return out


def test_trie_of_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in rows]
    assert trie(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("bits", [(16, 27), (6, 6)])
def test_trie_of_random_turns(spark, monkeypatch, bits):
    """Few different turns make many shared prefixes. A sketch of 64 counters a row proves next to nothing; parts of 50 rows split conversations."""
    monkeypatch.setattr(prefix_trie, "SKETCH_BITS", bits)
    monkeypatch.setattr(prefix_trie, "PART_ROWS", 50)
    monkeypatch.setattr(prefix_trie, "BLOB_IDS", 3)
    rng = random.Random(bits[0])
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "é", ""])) for c in range(120) if c % 7 for t in range(rng.randint(1, 12))]
    rows += [(500, t, "u", f"long {t}") for t in range(300)] + [(c, t, "u", "copy") for c in range(600, 640) for t in range(20)]
    rng.shuffle(rows)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 1, "u", "nobody"), (1, None, None, None), (1, None, "u", "first"), (1, 2, "u", "x"), (1, 2, "u", "x"), (1, 2, "a", "x"), (2, 0, None, "x"),
        (10, 0, "u", "y" * 100_000), (11, 0, "u", "z"), (12, 5, "u", ""), (13, 1, "u", "q"), (14, 1, "ua", "q"), (5, 1, "u", "aq"),
    ]
    assert trie(spark, rows) == plain_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    # One conversation that borrows turns that nobody lends is turnless.
    assert trie(spark, [(1, 0, "u", "x")]) == plain_trie([(1, 0, "u", "x")])


def test_sketch_never_misses_a_shared_digest(spark):
    rng = np.random.default_rng(1)
    once, twice = rng.integers(-(1 << 63), (1 << 63) - 1, 3000), rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    rows = spark.createDataFrame([(int(x),) for x in [*once, *twice, *twice]], "lo bigint")
    sketch = prefix_trie.Sketch.of(rows, "lo", 4000)
    assert sketch.above_one(twice).all() and sketch.above_one(once).mean() < 0.05
