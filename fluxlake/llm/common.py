"""Pieces that several operators share: hot-key joins, connected components, table sizing, text expressions."""

from __future__ import annotations

import ctypes
import gc
import math

import numpy as np
import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.session import settle, shared_dir, stage

# A key that holds at least one row in so many is hot. At most this many keys can be, so they may be broadcast.
HOT_PARTS = 1000
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


# Rows of an Arrow batch: texts may be long, and a worker holds a batch several times over.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get few rows at a time. This changes the session's setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return what a Python worker has freed to its machine: workers are used again, and else each keeps the most it ever held."""
    # Only what was made lately: going over all that a worker has imported and keeps takes longer than many a task.
    gc.collect(1)
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # Another C library, which has no such call.


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents below ``sf_dir``, with the shared folder set up for staging."""
    settle(spark)
    shared_dir(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(rows: int, per_part: int, spark: SparkSession) -> int:
    """A number of partitions that keeps each near ``per_part`` rows and every core busy."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_part))


def word_count(text: Column) -> Column:
    """Number of words of a text; NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_slot(doc_id: Column, slots: int) -> Column:
    """crc32 of the id as text, modulo ``slots``; a NULL id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % slots


def by_shuffle(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by a shuffle, however small Spark takes them to be.

    Spark counts one row out of an explode for each row into it, takes a column for a fixed number of bytes and a scan for its packed
    bytes. A table that grows with the input may therefore be sized below the threshold at which the driver collects and broadcasts it.
    """
    return rows.hint("merge")


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``left`` with one ``right`` row per key, where ``weight`` is the key's number of left rows.

    Keys with ``total / HOT_PARTS`` rows or more number at most ``HOT_PARTS``: their right rows are broadcast, so
    the left rows of a hot key stay where they are. The other keys are joined by a shuffle, in which each key has
    less than a thousandth of the rows. ``left`` is read twice and should be staged. NULL keys find nothing.
    """
    hot = right.where(F.col(weight) * HOT_PARTS >= F.lit(total))
    cold = right.where(F.col(weight) * HOT_PARTS < F.lit(total))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; the root is the smallest node reached.

    Each round lets every node point to its smallest neighbour, follows the pointers to the end by doubling, and
    relabels the edges by the ends, so trees shrink to one node. Only minima are aggregated, which are combined
    before they are shuffled, so a hub with many edges is no burden. Rounds are staged in the shared folder.
    """
    live = stage(
        edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    total = None
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        roots = stage(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")), "pointers")
        while True:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stage(roots.join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "pointers")
            if roots.where("moved").isEmpty():
                break
        roots = roots.select("node", "root")
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(of_a, "a").join(of_b, "b").where("ra != rb")
        live = stage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if total is None:
            total = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            total = total.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        total = stage(total, "roots")
    if total is None:
        total = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total


class MemberFilter:
    """A fixed-size bitmap of numbers: never misses a member, and lets some others through."""

    BITS = 27

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def slots(number: Column) -> Column:
        """Two bit positions of a 64-bit number, from parts of it that do not overlap."""
        mask = F.lit((1 << MemberFilter.BITS) - 1)
        return F.array(number.bitwiseAND(mask), F.shiftrightunsigned(number, 64 - MemberFilter.BITS))

    def hold(self, numbers: np.ndarray) -> np.ndarray:
        numbers = np.asarray(numbers, np.int64).view(np.uint64)
        out = self._set(numbers & np.uint64((1 << self.BITS) - 1))
        # Most numbers fail at their first bit.
        rest = np.flatnonzero(out)
        out[rest] = self._set(numbers[rest] >> np.uint64(64 - self.BITS))
        return out

    def _set(self, slots: np.ndarray) -> np.ndarray:
        return (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def member_filter(rows: DataFrame, number: Column | str) -> MemberFilter:
    """A filter of the 64-bit ``number`` of all rows. It is 16 MB whatever the rows, so it may be broadcast.

    Bits are gathered in 64-bit words by an aggregate. When most words are set it lets everything through, and the join behind
    it is then a plain one.
    """
    column = F.col(number) if isinstance(number, str) else number
    words = rows.select(F.explode(MemberFilter.slots(column)).alias("slot"))
    words = words.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (MemberFilter.BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return MemberFilter(out)
