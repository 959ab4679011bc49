"""Language identification with string kernels.

The blended-spectrum kernel of two texts counts the character n-grams, n = 1 to 3, that both have, over the geometric mean
of how many each has. Nystrom landmarks are texts of every language; one-versus-rest kernel ridge regression learns a
value for each language from their kernels. Prediction is two matrix products per batch: presence of n-grams by
landmarks, and kernels by weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import crc_slot, documents, give_back, small_batches
from fluxlake.session import stage

# Cells that n-grams are hashed to, landmarks and labelled rows per language that a model is fitted on at most, ridge.
CELLS = 1 << 15
LANDMARKS = 24
FIT_ROWS = 300
RIDGE = 1e-3
MAX_N = 3
# Texts of a batch: each takes four bytes a cell.
BATCH = 64
# Code points hashed at a time, which bounds the memory of a very long text.
BLOCK = 1 << 18
UNKNOWN = "und"
# Share of labelled rows, with their language found, whose scores are too low to be told from a text of no learned language.
DOUBTFUL_SHARE = 0.004
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Which cells the n-grams of a text (lower-cased, in full) fall into, as 0 and 1."""
    cells = np.zeros(CELLS, np.uint8)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    shift = np.uint64(64 - CELLS.bit_length() + 1)
    for start in range(0, len(points), BLOCK):
        part = points[start:start + BLOCK + MAX_N - 1]
        code = np.zeros(len(part), np.uint64)
        for n in range(1, MAX_N + 1):
            if len(part) < n:
                break
            code = (code[:len(part) - n + 1] << np.uint64(21)) | part[n - 1:]
            cells[((code + np.uint64(n)) * _MIX) >> shift] = 1
    return cells


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Landmarks (cells by landmarks, each divided by its root size), weights (landmarks by languages), languages."""

    def __init__(self, cells: np.ndarray, langs: list[str], ridge: float = RIDGE, landmarks: int = LANDMARKS):
        self.names = sorted(set(langs))
        of = np.array([self.names.index(x) for x in langs])
        pick = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(self.names))])
        chosen = cells[pick].astype(np.float32)
        self.marks = np.ascontiguousarray((chosen / np.sqrt(np.maximum(chosen.sum(1), 1))[:, None]).T)
        kernel = self.kernel(cells).astype(np.float64)
        target = np.where(of[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        inner = kernel[pick]
        # Rows of a rare language weigh as much in total as those of a common one.
        weight = (1.0 / np.bincount(of))[of][:, None]
        left = kernel.T @ (weight * kernel) + ridge * (inner + 1e-6 * np.eye(len(pick)))
        self.weights = np.linalg.lstsq(left, kernel.T @ (weight * target), rcond=None)[0].astype(np.float32)

    def kernel(self, cells: np.ndarray) -> np.ndarray:
        x = cells.astype(np.float32)
        return (x @ self.marks) / np.sqrt(np.maximum(x.sum(1), 1))[:, None]

    def predict(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and its value brought from -1..1 to 0..1."""
        values = self.kernel(cells) @ self.weights
        return values.argmax(1), np.clip((values.max(1) + 1) / 2, 0, 1)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = FIT_ROWS) -> Model | None:
    """A model from the labelled ``rows``: at most ``most`` of each language, those with the smallest hash of id and text."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    # A hash range per language that holds about twice the rows needed, so that what is sorted stays small.
    turn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(5)), F.lit(1 << 30))
    limit = F.lit(1 << 30)
    for lang, size in sizes.items():
        if size > 4 * most:
            limit = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * 2 * most / size))).otherwise(limit)

    @F.pandas_udf("binary")
    def cells_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([np.packbits(grams(text)).tobytes() if has_letter(text) else None for text in series], dtype=object)
        give_back()

    # NULL cells go after staging: a filter in front of it would call Python once more for every row.
    sample = rows.where(turn < limit).select("id", "lang", turn.alias("turn"), cells_of("text").alias("cells"))
    sample = stage(sample, "language-sample").where("cells IS NOT NULL")
    picked = []
    for lang in sorted(sizes):
        picked += sample.where(F.col("lang") == lang).orderBy("turn", "id", "cells").limit(most).collect()
    if not picked:
        return None
    cells = np.unpackbits(np.frombuffer(b"".join(bytes(r["cells"]) for r in picked), np.uint8).reshape(len(picked), -1), axis=1)
    return Model(cells, [r["lang"] for r in picked])


def predicted(model: Model | None, texts: np.ndarray) -> pd.DataFrame:
    """``lang`` and ``score`` of each text, a few texts at a time."""
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    known = [i for i, text in enumerate(texts) if model is not None and has_letter(text)]
    for start in range(0, len(known), BATCH):
        rows = known[start:start + BATCH]
        best, value = model.predict(np.stack([grams(texts[i]) for i in rows]))
        lang[rows], score[rows] = np.array(model.names, object)[best], value
    return pd.DataFrame({"lang": lang, "score": score})


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``language_found``: a struct of ``lang`` and ``score``.

    Texts that are NULL or have no letter get ``und`` with score 0, as do all texts if there is no model.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        for series in texts:
            yield predicted(model, series.to_numpy())
        give_back()

    return docs.withColumn("language_found", of(F.col(text_col)))


def least_score(found: DataFrame, lang_col: str = "lang", id_col: str = "doc_id") -> float:
    """The score that all but ``DOUBTFUL_SHARE`` of the labelled training rows reach, of ``identify``'s rows; 0 if there are none.

    Texts in languages that were never learned resemble no landmark and score about a half, junk less; those of a learned one score more.
    """
    right = training_rows(found, id_col).where((F.col("language_found.lang") == F.col(lang_col).cast("string")) & (F.col("language_found.lang") != UNKNOWN))
    return right.agg(F.percentile_approx("language_found.score", DOUBTFUL_SHARE, 100_000).alias("least")).first()["least"] or 0.0


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc_slot(F.col(id_col), 4) != 2)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    Learns from rows whose crc32 of the id modulo 4 is not 2 and whose language and text are not NULL; a prediction reads
    the text alone. Repeated rows are predicted alike; an empty table gives an empty result; other columns are not read.
    """
    model = fit(training_rows(docs, id_col), text_col, lang_col, id_col)
    found = identify(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return found.select(
        "doc_id", (crc_slot(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("language_found.lang").alias("lang_pred"), F.col("language_found.score").alias("score"),
    )


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Language and score of every document; see ``language_id``."""
    return language_id(documents(spark, sf_dir))
