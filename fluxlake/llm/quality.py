"""Quality rules with an isolation forest on their statistics.

Every document gets rule statistics over its whole text. A forest of random axis-parallel splits, grown on labelled good
rows inside the box that all rows span, gives each document a mean path length: statistics in empty parts of the
box are cut off after few splits. The path length from which a document is anomalous is calibrated from the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import documents
from fluxlake.session import stage

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
# Good rows that the forest is fitted on at most, trees, and rows per tree.
FIT_ROWS = 20_000
TREES = 128
TREE_ROWS = 256
# A rejected good row weighs as much as so many accepted bad ones; scores are compared in steps of 1 / STEPS.
GOOD_WEIGHT = 20.0
STEPS = 2000

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?\"'()[]{}=+_/\\@^~`;:"


def repeated(words: list) -> int:
    """Number of words that lie in a window of three words which the text has twice or more."""
    if len(words) < 4:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, place, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift:len(words) - 2 + shift] |= twice
    return int(inside.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """``STATS`` and ``MORE`` of a text; NULL counts as empty.

    Words are runs of characters other than ASCII white space. Code points in words, symbols, lines with a word that
    equal an earlier line, words in repeated windows; then lines with a word, capitals, digits, marks, distinct words.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    count = lambda some: len(raw) - len(raw.translate(None, some))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), len(text or "") - count(SPACES), count(SYMBOLS), len(lines) - len(set(lines)), repeated(words),
        len(lines), count(UPPER), count(DIGITS), count(MARKS), len(set(words)),
    )


def features(stats: np.ndarray) -> np.ndarray:
    """Rates of the statistics on a logarithmic scale, one row per document."""
    words, chars, symbols, dups, repeats, lines, upper, digits, marks, distinct = stats.T.astype(float)
    some, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    rates = [symbols / per_char, dups / np.maximum(lines, 1), repeats / some, upper / per_char, digits / per_char, marks / per_char]
    scaled = [np.log1p(100 * r) for r in rates]
    return np.column_stack([*scaled, np.log1p(words), np.log1p(chars / some), np.log1p(10 * distinct / some)])


class Forest:
    """Random splits as flat arrays: per node the feature, the cut, the two children, and at leaves the path length."""

    def __init__(self, good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self.scale = max(_average(min(rows, len(good))), 1.0)
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        self.roots = [
            self._grow(good[rng.permutation(len(good))[:rows]], low.copy(), high.copy(), 0, depth, rng) for _ in range(trees)
        ]
        feature, cut, left, right, path = zip(*self.nodes)
        self.feature, self.left, self.right = (np.array(x, np.int32) for x in (feature, left, right))
        self.cut, self.path = np.array(cut), np.array(path)
        self.depth = depth

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, depth: int, rng) -> int:
        number = len(self.nodes)
        self.nodes.append((0, 0.0, number, number, at + _average(len(rows))))
        wide = np.flatnonzero(high > low)
        if at < depth and len(rows) > 1 and len(wide):
            feature = int(rng.choice(wide))
            cut = float(rng.uniform(low[feature], high[feature]))
            below = rows[:, feature] < cut
            inner_high, inner_low = high.copy(), low.copy()
            inner_high[feature] = inner_low[feature] = cut
            left = self._grow(rows[below], low, inner_high, at + 1, depth, rng)
            right = self._grow(rows[~below], inner_low, high, at + 1, depth, rng)
            self.nodes[number] = (feature, cut, left, right, 0.0)
        return number

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: 2 to the minus mean path length over that of an average search."""
        total = np.zeros(len(x))
        at = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[at, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / self.scale)


def _average(rows: int) -> float:
    """Mean path length of an unsuccessful search among ``rows`` rows."""
    return 2 * (np.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows if rows > 2 else float(rows == 2)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([statistics(text) for text in frame["text"]], columns=STATS + MORE, dtype="int64")
            out.insert(0, "doc_id", frame["doc_id"].values)
            yield out

    schema = ", ".join([f"doc_id {kind}", *(f"{name} bigint" for name in STATS + MORE)])
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, schema)


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Statistics of at most ``most`` rows, those with the smallest hash of their id."""
    total = rows.count()
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(23))
    # A hash range that holds about twice as many rows as needed; what is then sorted is bounded by it.
    if total > 4 * most:
        rows = rows.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int((1 << 30) * 2 * most / total)))
    picked = rows.select(*STATS, *MORE, order.alias("turn")).orderBy("turn", *STATS, *MORE).limit(most).drop("turn")
    return np.array([tuple(r) for r in picked.collect()], float).reshape(-1, len(STATS + MORE))


def _box(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each feature over all rows: two per batch, then one aggregate."""
    names = [f"f{i}" for i in range(features(np.zeros((1, len(STATS + MORE)))).shape[1])]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = features(frame.to_numpy())
                yield pd.DataFrame([x.min(0), x.max(0)], columns=names)

    ends = rows.select(*STATS, *MORE).mapInPandas(run, ", ".join(f"{name} double" for name in names))
    both = ends.agg(*[F.min(name) for name in names], *[F.max(name) for name in names]).first()
    return np.array(both[:len(names)], float), np.array(both[len(names):], float)


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the five rule statistics, ``base_failed, kept, anomaly``.

    ``base_failed``: under 50 words, or more than half of the words in repeated windows. ``kept``: not failed, and not
    anomalous by the forest. The forest is fitted on at most ``fit_rows`` good rows, inside the box of all rows; the threshold is the anomaly that costs least over all labelled rows that pass the base rules, a rejected good row
    weighing ``GOOD_WEIGHT`` accepted bad ones. Without labels of both kinds nothing is anomalous. Labels that are
    NULL, or of NULL or unknown ids, are not used; of several labels for an id the smallest holds. NULL text counts as
    empty and fails. Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    stats = stage(rule_statistics(docs, id_col, text_col), "rule-statistics")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("int").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("good").alias("good"))
    labelled = stage(stats.where(~base).join(known, "doc_id"), "labelled-statistics")
    good = _sample(labelled.where("good = 1"), fit_rows)
    anomaly = F.lit(0.0)
    scored, cut = stats.withColumn("anomaly", anomaly), None
    if len(good):
        forest = docs.sparkSession.sparkContext.broadcast(Forest(features(good), *_box(stats)))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(forest.value.scores(features(np.column_stack(columns))))

        scored = stats.withColumn("anomaly", score(*STATS, *MORE))
        cut = _threshold(labelled.withColumn("anomaly", score(*STATS, *MORE)))
    strange = F.lit(False) if cut is None else F.col("anomaly") >= cut
    return scored.select("doc_id", *STATS, base.alias("base_failed"), (~base & ~strange).alias("kept"), "anomaly")


def _threshold(labelled: DataFrame) -> float | None:
    """The anomaly score from which to reject, from counts of labelled rows per score step."""
    step = F.least(F.floor(F.col("anomaly") * STEPS), F.lit(STEPS - 1)).alias("step")
    counts = np.zeros((STEPS, 2))
    for row in labelled.groupBy(step, (F.col("good") == 1).cast("int").alias("good")).count().collect():
        counts[row["step"], row["good"]] = row["count"]
    bad, good = counts[:, 0].sum(), counts[:, 1].sum()
    if not bad or not good:
        return None
    # Rejecting from a step on: good rows at or above it are lost, bad ones below it are kept.
    lost = counts[::-1, 1].cumsum()[::-1]
    kept_bad = counts[:, 0].cumsum() - counts[:, 0]
    cost = GOOD_WEIGHT * lost / good + kept_bad / bad
    # The free interval beside the best step is split in the middle, so unseen good rows have some room.
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / STEPS)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(documents(spark, sf_dir), labels)


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
FROM w
"""
