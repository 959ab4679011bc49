"""The learned operators: gradients, exact parts against brute force, and held-out quality."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from fluxlake.llm import language, lm, quality
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- language model --------------------------------------------------------------------------------


def small_network():
    rng = np.random.default_rng(2)
    net = lm.Network(rng.integers(1, 50, 12).astype(float), hidden=5, classes=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    return net, rng


def test_gradients_equal_differences(monkeypatch):
    net, rng = small_network()
    tokens = rng.integers(0, 12, (7, 4))
    live = rng.random((6, 4)) < 0.8
    h = rng.normal(size=(4, 5))
    monkeypatch.setattr(lm.np, "float32", np.float64)

    def loss():
        states, _ = net.states(tokens, h)
        where = np.nonzero(live)
        return -net.losses(states[where], tokens[1:][where], False)[0].sum()

    grads, _ = net.gradients(tokens, live, h)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept, step = w[at], 1e-5
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-5, name


def test_every_state_has_a_whole_distribution():
    net, rng = small_network()
    h = rng.normal(size=(1, 5))
    total = sum(math.exp(net.losses(h, np.array([t]), False)[0][0]) for t in range(12))
    assert abs(total - 1) < 1e-6


def test_state_is_carried_over_windows(monkeypatch):
    net = lm.Network(np.ones(9))
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 9, n) for n in (1, 40, 16, 17, 100)]
    whole = []
    for t in texts:
        states, _ = net.states(np.concatenate(([9], t))[:, None], np.zeros((1, net.hidden), np.float32))
        whole.append(net.losses(states[:, 0], t, False)[0].sum())
    np.testing.assert_allclose(lm.score_texts(net, texts), whole, rtol=1e-5)
    monkeypatch.setattr(lm, "SCORE_ROWS", 2)
    np.testing.assert_allclose(lm.score_texts(net, texts), whole, rtol=1e-5)


def test_base_scores_equal_counts_and_the_network_beats_them(real):
    rows = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    counts: Counter = Counter()
    tokens = {i: [w.decode() for w in t.encode().lower().split()] + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, some in tokens.items():
        if not held[i]:
            counts.update(some)
    n, v = sum(counts.values()), len(counts)
    got = lm.score_documents(real).collect()
    for r in got:
        some = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(some), sum(w in counts for w in some), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in some))
    apart = [r for r in got if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_rare_words_that_are_not_broadcast(real, monkeypatch):
    whole = {r.doc_id: r for r in lm.score_documents(real).collect()}
    monkeypatch.setattr(lm, "FREQUENT_PARTS", 2000)
    monkeypatch.setattr(lm, "HOLD_WORDS", 300)
    for r in lm.score_documents(real).collect():
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.n_known == whole[r.doc_id].n_known


def test_scores_of_odd_rows(table):
    got = lm.score_documents(table(ODD)).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) and r.score < 0 for r in got)
    same = [r for r in got if r.doc_id == 4]
    assert same[0] == same[1]
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2, 3, 6)} == {1: 1, 2: 1, 3: 1, 6: 5}
    assert lm.score_documents(table(ODD).where("false")).count() == 0


# ---- quality ---------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def test_rule_statistics(real):
    texts = [r.text for r in real.collect()] + [None, "", "a b a b a b", "x y z\nx y z\n\nx y z", "é\x0b# $", "a a a a", "same\nsame\n same\n\n\n"]
    for text in texts:
        assert quality.statistics(text)[:5] == brute_statistics(text)


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(0)
    good = rng.normal(size=(2000, 4))
    bad = rng.normal(size=(50, 4)) + 12
    both = np.vstack([good, bad])
    forest = quality.Forest(good, both.min(0), both.max(0))
    assert forest.scores(bad).min() > np.quantile(forest.scores(good), 0.999)


def test_threshold_keeps_good_rows_and_drops_bad_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_box_holds_every_row_whatever_the_sample(spark, real, table, monkeypatch):
    junk = [(10_000, "# $ % & " * 40, None, None), (10_001, "QX!7" * 300, None, None)]
    docs = real.select("doc_id", "text").unionByName(table(junk).select("doc_id", "text"))
    labels = real.selectExpr("doc_id", "cast(doc_id % 5 > 0 AS int) AS quality")
    seen, init = [], quality.Forest.__init__

    def grown(forest, good, low, high):
        seen.append((low, high))
        init(forest, good, low, high)

    monkeypatch.setattr(quality.Forest, "__init__", grown)
    quality.judge(docs, labels, fit_rows=20)
    x = quality.features(np.array([quality.statistics(r.text) for r in docs.collect()]))
    np.testing.assert_array_equal(seen, [(x.min(0), x.max(0))])


def test_judging_odd_rows(table, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id bigint, quality int")
    got = quality.judge(table(ODD), labels).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got)
    words = " ".join(f"w{i}" for i in range(60))
    unlabelled = quality.judge(table([(1, words), (2, "a b c " * 30)]), labels.where("false")).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in unlabelled} == {1: (False, True), 2: (True, False)}
    assert quality.judge(table(ODD).where("false"), labels).count() == 0


# ---- language --------------------------------------------------------------------------------------


def test_kernels_equal_gram_sets():
    texts = ["abcab", "cab ba", "zzz"]
    cells = np.stack([language.grams(t) for t in texts])
    sets = [{t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    assert cells.sum(1).tolist() == [len(s) for s in sets]
    model = language.Model(cells, ["x", "y", "z"])
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    np.testing.assert_allclose(model.kernel(cells), want, rtol=1e-6)


def test_grams_of_a_long_text_in_blocks(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(500))
    whole = language.grams(text)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (language.grams(text) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_holds_few_texts_at_a_time():
    texts = np.array([" ".join(f"{a}{b}" for b in "abcdef") for a in "uvwxyz" * 100], object)
    model = language.Model(np.stack([language.grams(t) for t in texts[:6]]), ["x", "y"] * 3)
    tracemalloc.start()
    found = language.predicted(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 600 and peak < 24 << 20
    alone = [model.predict(language.grams(t)[None]) for t in texts[:6]]
    assert found["lang"][:6].tolist() == [model.names[k] for (k,), _ in alone]
    assert np.allclose(found["score"][:6], [x for _, (x,) in alone])


def test_sample_calls_python_once_for_each_row(table, monkeypatch):
    plans, stage = [], language.stage
    monkeypatch.setattr(language, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name))
    model = language.fit(table([(i, t, "xy"[i % 2], None) for i, t in enumerate(["ab", "cd", "12", "", "ef"])]))
    assert model.names == ["x", "y"] and [plan.count("ArrowEvalPython") for plan in plans] == [1]


def test_languages_of_odd_rows(table):
    rows = ODD + [(i, t, lang, None) for i in range(50, 90) for t, lang in [(f"der und die {i}", "de") if i % 2 else (f"the and of {i}", "en")]]
    got = {r.doc_id: r for r in language.language_id(table(rows)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[51].lang_pred == "de" and got[52].lang_pred == "en"
    none = language.language_id(table([(i, t, None, None) for i, t, *_ in ODD])).collect()
    assert len(none) == len(ODD) and {r.lang_pred for r in none} == {"und"}
    assert language.language_id(table(rows).where("false")).count() == 0
