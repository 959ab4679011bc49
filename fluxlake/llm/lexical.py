"""Ranked lexical search by pipelined term partitioning.

Documents are dealt to slices of at most ``SLICE_ROWS``, each with an inverted index of the terms that any item asks for. Terms
belong to ``OWNERS`` owners: in ascending order of document frequency, each with about the same number of postings, so that the
common terms come last. Items travel in bundles. For every slice, a bundle visits one owner after another: a cogroup brings its
accumulators, a sparse score per item and document, together with the owner's postings that the bundle asks for, adds their
integer contributions, and sends the accumulators on to the next owner. The last owner's stage keeps the best of each item in the
slice; these are ranked over all slices. A common term, or an item that most documents match, is thus spread over the slices, and no
task ever holds more than a slice's share of a bundle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlake.llm.common import documents, parts_for, small_batches
from fluxlake.session import stage

OWNERS = 4
SLICE_ROWS = 4096
BUNDLE_ITEMS = 64
TOP = 20
# Up to so many bytes of distinct terms in all items are sent to the workers, which then index no other term.
TERM_BYTES = 64 << 20
# UTF-8 bytes that part terms become spaces, and A to Z become small; all others, those above ASCII too, stay.
SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
TERM_TABLE = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))
_ACCUMULATORS = "slice bigint, bundle bigint, item bigint, docs binary, scores binary"
_BEST = "slice bigint, item bigint, place int, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in UTF-8: runs of ASCII letters and digits and of everything above ASCII, with A to Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_TABLE).split()


def _index(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """The slices: a row per document (``place, id, n``) and a row per slice and wanted term (``docs, tfs, ns``, packed).

    In a slice documents are numbered in the order of their ids, NULL last. ``wanted`` None stands for all terms.
    """
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"slice bigint, term binary, df bigint, docs binary, tfs binary, ns binary, place int, id {kind}, n bigint"
    names = ["slice", "term", "df", "docs", "tfs", "ns", "place", "id", "n"]
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, number = known.value, TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def close() -> pd.DataFrame:
            held.sort(key=lambda row: (row[0] is None, row[0] if row[0] is not None else 0))
            postings: dict[bytes, list[tuple[int, int, int]]] = {}
            for place, (_, n, tf) in enumerate(held):
                for term, count in tf.items():
                    postings.setdefault(term, []).append((place, count, n))
            rows = [(number, None, None, None, None, None, place, name, n) for place, (name, n, _) in enumerate(held)]
            for term, found in postings.items():
                columns = np.array(found, np.int64).T
                rows.append((number, term, len(found), columns[0].astype("<u2").tobytes(), columns[1].astype("<i4").tobytes(), columns[2].astype("<i4").tobytes(), None, None, None))
            return pd.DataFrame(rows, columns=names, dtype=object)

        for frame in frames:
            for name, text in zip(frame["id"].astype(object).where(frame["id"].notna(), None), frame["text"]):
                terms = terms_of(text)
                held.append((name, len(terms), Counter(terms if asked is None else filter(asked.__contains__, terms))))
                if len(held) >= SLICE_ROWS:
                    yield close()
                    held, number = [], number + 1
        if held:
            yield close()

    return docs.mapInPandas(run, schema)


def _asked(items: DataFrame) -> DataFrame:
    """``(item, bundle, term, times)``: how often each item has a term. Items are numbered; equal ids are one item."""

    @F.pandas_udf("array<binary>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(terms_of)

    rows = items.select("item", F.explode(split(F.coalesce("text", F.lit("")))).alias("term"))
    return rows.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def _contributions(postings: pd.DataFrame, n_docs: int, n_terms: int) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Per item its ``(documents, scores)`` of every posting row of an owner."""
    out: dict[int, list] = {}
    for df, docs, tfs, ns, items, times in postings[["all_df", "docs", "tfs", "ns", "items", "times"]].itertuples(index=False, name=None):
        weight = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))
        place, tf, n = np.frombuffer(docs, "<u2"), np.frombuffer(tfs, "<i4").astype(np.int64), np.frombuffer(ns, "<i4").astype(np.int64)
        length = 75 + (25 * n * n_docs) // n_terms
        score = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * length))
        for item, many in zip(items, times):
            out.setdefault(item, []).append((place, score * many))
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0, all of them if fewer.

    Equal scores are ranked by ascending id, NULL ids last, and rows with equal ids in an order that is fixed by the rows.
    Every row of ``docs`` is a document of its own. NULL and empty texts have no terms: such documents are found by nothing, such
    items find nothing. Items with equal ids, NULL too, are one item with the terms of all of them. Empty tables give an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked_for = stage(_numbered(items.selectExpr(f"`{item_col}` AS item_id", f"`{item_text}` AS text")), "items")
    asked = stage(_asked(asked_for), "asked")
    terms = asked.select("term").distinct()
    size = terms.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    wanted = frozenset(bytes(row.term) for row in terms.toLocalIterator()) if size <= TERM_BYTES else None
    index = stage(_index(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), wanted), "slices")
    places = index.where("place IS NOT NULL").select("slice", "place", "id", "n")
    postings = index.where("term IS NOT NULL")
    totals = places.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    n_docs, n_terms = totals.n_docs, totals.n_terms or 1

    frequency = postings.groupBy("term").agg(F.sum("df").alias("all_df")).join(terms, "term")
    cuts = frequency.agg(F.sum("all_df").alias("total")).first().total or 0
    frequency = stage(frequency, "frequencies")
    owner = _owners(frequency, cuts)
    bundles = asked.withColumn("bundle", F.floor(F.col("item") / BUNDLE_ITEMS)).groupBy("term", "bundle").agg(
        F.collect_list(F.struct("item", "times")).alias("by"),
    ).select("term", "bundle", F.col("by.item").alias("items"), F.col("by.times").alias("times"))
    wants = stage(bundles.join(owner, "term"), "wants")
    parts = parts_for(index.count(), SLICE_ROWS, spark)

    def visit(state: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        return _visit(state, postings, n_docs, n_terms)

    def last(state: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        return _best(_visit(state, postings, n_docs, n_terms), top)

    state = spark.createDataFrame([], _ACCUMULATORS)
    keys = ["slice", "bundle"]
    for number in range(OWNERS):
        mine = postings.select("slice", "term", "docs", "tfs", "ns").join(wants.where(F.col("owner") == number), "term").drop("term", "owner")
        both = state.groupBy(*keys).cogroup(mine.groupBy(*keys))
        state = both.applyInPandas(visit, _ACCUMULATORS) if number < OWNERS - 1 else both.applyInPandas(last, _BEST)
    best = state
    named = best.join(places.select("slice", "place", "id"), ["slice", "place"])
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "slice", "place")
    ranked = named.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = asked_for.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _numbered(items: DataFrame) -> DataFrame:
    """``(item, item_id, text)`` with a number per distinct id, counted inside and over ranges of ids."""
    ids = items.select("item_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(4096)))
    sizes = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"))
    ids = ids.join(before, "bucket").withColumn("item", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("item_id")) - 1)
    return items.join(ids.select("item", F.col("item_id").alias("same")), F.col("item_id").eqNullSafe(F.col("same"))).select("item", "item_id", "text")


def _owners(frequency: DataFrame, total: int) -> DataFrame:
    """``(term, all_df, owner)``: owners in ascending order of document frequency, with about equal shares of the postings.

    Terms of one frequency have one owner, so the running sum goes over distinct frequencies only.
    """
    steps = frequency.groupBy("all_df").agg(F.sum("all_df").alias("postings"))
    upto = F.sum("postings").over(Window.orderBy("all_df")) - F.col("postings")
    steps = steps.select("all_df", F.least(F.lit(OWNERS - 1), F.floor(upto * OWNERS / F.lit(max(total, 1)))).cast("int").alias("owner"))
    return frequency.join(steps, "all_df").select("term", "all_df", "owner")


def _visit(state: pd.DataFrame, postings: pd.DataFrame, n_docs: int, n_terms: int) -> pd.DataFrame:
    """A bundle's accumulators in one slice after an owner's contributions."""
    held: dict[int, list] = {}
    for item, docs, scores in state[["item", "docs", "scores"]].itertuples(index=False, name=None):
        held.setdefault(item, []).append((np.frombuffer(docs, "<u2"), np.frombuffer(scores, "<i8")))
    if len(postings):
        for item, found in _contributions(postings, n_docs, n_terms).items():
            held.setdefault(item, []).extend(found)
    either = state if len(state) else postings
    out = []
    for item, parts in held.items():
        sums = np.zeros(SLICE_ROWS, np.int64)
        for docs, scores in parts:
            sums[docs] += scores
        docs = np.flatnonzero(sums)
        if len(docs):
            out.append((either["slice"].iloc[0], either["bundle"].iloc[0], item, docs.astype("<u2").tobytes(), sums[docs].astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["slice", "bundle", "item", "docs", "scores"])


def _best(state: pd.DataFrame, top: int) -> pd.DataFrame:
    """The ``top`` places of each item: documents are numbered by id, so a stable order breaks ties by id."""
    out = [pd.DataFrame({"slice": [], "item": [], "place": [], "score": []}, dtype="int64")]
    for number, item, docs, scores in state[["slice", "item", "docs", "scores"]].itertuples(index=False, name=None):
        place, score = np.frombuffer(docs, "<u2").astype(np.int64), np.frombuffer(scores, "<i8")
        first = np.argsort(-score, kind="stable")[:top]
        out.append(pd.DataFrame({"slice": number, "item": item, "place": place[first], "score": score[first]}))
    return pd.concat(out)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item; see ``search``."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# Fixed values of the ranking: the pattern of a term and the integer form of the weights.
ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
s AS (SELECT sum((len(words) > 0)::INT)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM i) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, s),
r AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM i JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY rank <= 20
"""
