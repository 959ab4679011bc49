"""From a table of documents to token ids: the training-data operators as one pipeline.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept; between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.llm import bpe, language, line_dedup, simhash, source_mix
from fluxlake.llm.common import documents
from fluxlake.session import stage


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``docs`` has."""
    while name in docs.columns:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language; the identifier learns from the training rows among them.

    NULL texts and those without a letter go, as do those whose score is below what nearly all labelled rows reach; with no
    labelled rows all go. Repeated rows are judged alike; an empty table stays empty; columns may have any names.
    """
    model = language.fit(language.training_rows(docs))
    labelled = language.training_rows(docs.select("doc_id", "text", "lang")).where("lang IS NOT NULL")
    least = language.least_score(language.identify(labelled, model))
    found = language.identify(docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), "text"), model)
    return found.where((F.col("language_found.lang") != language.UNKNOWN) & (F.col("language_found.score") >= least)).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their repeated lines; those of which no line with a word is left go.

    NULL texts and those without a word stay as they are. Rows that repeat id and text keep the same lines; an empty table stays
    empty; columns may have any names.
    """
    report = free_name(docs, "line_dedup")
    done = line_dedup.dedup_lines(docs, report=report, count_links=False)
    gone = (F.col(f"{report}.n_lines") > 0) & (F.col(f"{report}.n_exact") + F.col(f"{report}.n_near") == F.col(f"{report}.n_lines"))
    return done.where(~gone).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{name}`") for name in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id. NULL and wordless texts are alike; an empty table stays empty."""
    return simhash.keep_first(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, in its order; rows without a word are not taken. A NULL source is a source."""
    return source_mix.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every row, and digest of the text decoded from them; NULL texts have none."""
    return bpe.encode_documents(docs, bpe.default_tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("source_mix", mix_stage),
    ("bpe_encode", encode_stage),
]

# Fitted weights, near links and tokenization are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
