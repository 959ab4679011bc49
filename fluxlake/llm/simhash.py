"""SimHash near-dedup with multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints within ``distance`` bits agree, by the pigeonhole
principle, in one segment up to a small radius: a table of segment values holds every fingerprint, a probe
enumerates the Hamming ball of that radius around each of its own segment values, and matches are verified on all
64 bits. Equal fingerprints are one row before any search, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.llm.common import by_shuffle, components, documents, hot_join, small_batches
from fluxlake.session import stage

SEED = 42
SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
# Fingerprints that may share a segment value before they are linked over midpoints.
CROWD = 2048
# Shingles hashed at a time, which bounds the memory of a very long text.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as a signed integer.

    A-Z are lower-cased; words are runs of characters other than ASCII white space. Bit ``b`` is set if more than half
    of the shingles' hashes, repeats included, have it. A text with fewer words has one shingle of all of them; one
    without words, or NULL, has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, count, BLOCK):
        stop = min(count, start + BLOCK)
        hashes = np.fromiter((digest(b" ".join(words[i:i + shingle]), SEED) for i in range(start, stop)), np.uint64, stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([fingerprint(text, shingle) for text in series], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"))


def layout(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """``(first bit, width, radius)`` of each segment.

    If every segment differed by more than its radius, the total would exceed ``distance``: with
    ``distance = segments * q + r`` the first ``r + 1`` segments have radius ``q`` and the others ``q - 1``;
    a radius below 0 needs no probe.
    """
    base, extra = divmod(64, segments)
    q, r = divmod(distance, segments)
    out, first = [], 0
    for number in range(segments):
        width = base + (number < extra)
        out.append((first, width, q if number <= r else q - 1))
        first += width
    return out


def _values(fp: Column, parts: list[tuple[int, int, int]], ball: bool) -> Column:
    """Segment values of a fingerprint, tagged with the segment; with ``ball`` also all values within the radius."""
    keys = []
    for number, (first, width, radius) in enumerate(parts):
        if radius < 0:
            continue
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        tag = number << 60 if number < 8 else number - 16 << 60
        masks = [sum(1 << bit for bit in bits) for size in range(radius + 1 if ball else 1) for bits in combinations(range(width), size)]
        keys += [value.bitwiseXOR(F.lit(mask)).bitwiseOR(F.lit(tag)) for mask in masks]
    return F.array(*keys)


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """``(a, b)``: edges with the connected components of the distinct ``prints(fp)`` within ``distance`` bits.

    In general edges are the linked pairs, each met from its larger side (balls are symmetric). Segment values that
    more than ``crowd`` fingerprints share would make a square of pairs, so whoever meets at one is linked over
    midpoints instead, which is as exact and linear. For an odd distance there is no midpoint, and pairs are used.
    """
    parts = layout(segments, distance)
    table = prints.select(F.col("fp").alias("a"), F.explode(_values(F.col("fp"), parts, False)).alias("key"))
    probes = prints.select(F.col("fp").alias("b"), F.explode(_values(F.col("fp"), parts, True)).alias("key"))
    edges = None
    if distance % 2 == 0:
        crowded = stage(table.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded-segments")
        if not crowded.isEmpty():
            met = table.join(crowded, "key", "left_semi").select(F.col("a").alias("fp")).unionByName(probes.join(crowded, "key", "left_semi").select(F.col("b").alias("fp")))
            edges = _midpoints(met.distinct(), distance // 2)
            table, probes = table.join(crowded, "key", "left_anti"), probes.join(crowded, "key", "left_anti")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    pairs = table.join(by_shuffle(probes), "key").where(near).select("a", "b").distinct()
    return pairs if edges is None else pairs.unionByName(edges)


def _midpoints(prints: DataFrame, radius: int) -> DataFrame:
    """Edges from fingerprints to the 64-bit values within ``radius`` that two or more of them share.

    Two fingerprints within ``2 * radius`` bits have such a value between them, and two that share one are so near. A
    value that is itself a fingerprint is within the distance of all of them, so it may be the same node.
    """
    flips = [sum(1 << bit for bit in bits) for size in range(radius + 1) for bits in combinations(range(64), size)]
    masks = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips])
    points = prints.select(F.col("fp").alias("a"), F.explode(masks).alias("mask")).select("a", F.col("a").bitwiseXOR(F.col("mask")).alias("b"))
    shared = points.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    return points.join(by_shuffle(shared), "b").select("a", "b")


_ROW = ("nameless", "id", "version")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, fp, row, first``.

    Documents whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the smallest id
    reachable over links. NULL, empty and blank texts have fingerprint zero and are linked like any other. NULL ids
    take part in links but are a component's id only if it has no other. ``row`` and ``first`` are (is the id NULL, id, hash of
    the text) of the row and of the component's first row. Repeated rows come out as often as they came in; an empty
    table gives an empty result; other columns are not read.
    """
    row = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col), F.lit(1)).alias("version"))
    prints = fingerprints(docs.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text", shingle)
    prints = stage(prints.withColumnRenamed("doc_id", "row"), "fingerprints")
    total = prints.count()
    distinct = stage(prints.groupBy("fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance, segments))
    placed = distinct.join(by_shuffle(roots), F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    placed = stage(placed, "fingerprint-roots")
    heads = placed.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("prints"))
    placed = hot_join(placed.drop("first"), by_shuffle(heads), "root", "prints", placed.count()).select("fp", "head", "copies")
    return hot_join(prints, by_shuffle(placed), "fp", "copies", total).select(
        F.col("row.id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head.id").alias("component_id"),
        "fp", "row", F.col("head").alias("first"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component: one of each.

    Rows that repeat id and text are told apart by nothing, so one of them is taken.
    """
    first = simhash_groups(docs, id_col, text_col, **settings).where(F.col("row") == F.col("first"))
    first = first.select(F.col("row.nameless").alias("nameless"), F.coalesce(F.col("row.id").cast("string"), F.lit("")).alias("id"), F.col("row.version").alias("version")).distinct()
    rows = docs.select(
        F.col(id_col).isNull().alias("nameless"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.xxhash64(F.col(text_col), F.lit(1)).alias("version"), F.struct("*").alias("whole"),
    )
    turn = F.row_number().over(Window.partitionBy(*_ROW).orderBy(F.lit(1)))
    return rows.join(by_shuffle(first), list(_ROW), "left_semi").withColumn("turn", turn).where("turn = 1").select("whole.*")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
