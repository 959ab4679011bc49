"""Exact deduplication with an index of live digests behind cuckoo filters.

Texts are equal when they agree after all white space is deleted. A shard of the index owns a range of digests: its
cuckoo filter answers most lookups of new digests with "absent", a hit is verified against the bucketed content
(the full digests with their representative), and an overflow doubles the table from the stored keys. The same
index first combines the repeats inside each input partition, so a group that holds a third of all rows reaches
its shard as one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.llm.common import documents, hot_join, parts_for
from fluxlake.session import stage

SLOTS = 4
MAX_KICKS = 200
# Digests that a shard should own, and that a partition collects before it hands them on.
SHARD_DIGESTS = 250_000
_MIX = 0x5BD1E995


class CuckooIndex:
    """Live digests with their payloads: a cuckoo filter in front of content that is bucketed by digest."""

    def __init__(self, buckets: int = 1024):
        self._size(buckets)
        self.content: list[dict[bytes, tuple]] = [{} for _ in range(buckets)]
        self.count = 0

    def _size(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]

    def _place(self, digest: bytes) -> tuple[int, int]:
        """Home bucket and nonzero 16-bit fingerprint, from bytes of the digest that do not overlap."""
        return int.from_bytes(digest[:8], "little") & self.mask, int.from_bytes(digest[8:10], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * _MIX)) & self.mask

    def _store(self, digest: bytes) -> bool:
        home, mark = self._place(digest)
        table, spot = self.table, home
        if len(table[home]) >= SLOTS:
            spot = self._other(home, mark)
        for kick in range(MAX_KICKS):
            row = table[spot]
            if len(row) < SLOTS:
                row.append(mark)
                return True
            out = kick % SLOTS
            mark, row[out] = row[out], mark
            spot = self._other(spot, mark)
        return False

    def _grow(self) -> None:
        """Double until every stored key fits; the keys come from the content, as fingerprints cannot be split."""
        entries = [pair for bucket in self.content for pair in bucket.items()]
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._size(buckets)
            if all(self._store(digest) for digest, _ in entries):
                break
        self.content = [{} for _ in range(buckets)]
        for digest, payload in entries:
            self.content[self._place(digest)[0]][digest] = payload

    def may_contain(self, digest: bytes) -> bool:
        home, mark = self._place(digest)
        return mark in self.table[home] or mark in self.table[self._other(home, mark)]

    def get(self, digest: bytes) -> tuple | None:
        """The payload of a live digest: only a hit of the filter opens the content bucket."""
        return self.content[self._place(digest)[0]].get(digest) if self.may_contain(digest) else None

    def put(self, digest: bytes, payload: tuple) -> None:
        bucket = self.content[self._place(digest)[0]]
        fresh = digest not in bucket
        bucket[digest] = payload
        if fresh:
            self.count += 1
            if not self._store(digest):
                self._grow()

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out of the content and one copy of its fingerprint out of the filter."""
        if self.get(digest) is None:
            return False
        home, mark = self._place(digest)
        spot = home if mark in self.table[home] else self._other(home, mark)
        self.table[spot].remove(mark)
        del self.content[home][digest]
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for bucket in self.content:
            yield from bucket.items()


_ENTRY = "digest binary, keep_id bigint, keep_chars bigint, group_size bigint"


def _rank(payload: tuple) -> tuple:
    """Longest original text first, then the smallest id, NULL ids last."""
    return -payload[1], payload[0] is None, payload[0] or 0


def _merge(index: CuckooIndex, digest: bytes, payload: tuple) -> None:
    held = index.get(digest)
    if held is not None:
        best = min(held, payload, key=_rank)
        payload = (best[0], best[1], held[2] + payload[2])
    index.put(digest, payload)


def _frame(index: CuckooIndex) -> pd.DataFrame:
    rows = list(index.items())
    return pd.DataFrame({
        "digest": [digest for digest, _ in rows],
        "keep_id": pd.array([p[0] for _, p in rows], "Int64"),
        "keep_chars": [p[1] for _, p in rows],
        "group_size": [p[2] for _, p in rows],
    })


def _ids(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def _combine(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest of a partition; handed on early when many are live, which costs rows but not rightness."""
    index = CuckooIndex()
    for frame in frames:
        for digest, *payload in zip(frame["digest"], _ids(frame["keep_id"]), frame["keep_chars"].tolist(), frame["group_size"].tolist()):
            _merge(index, bytes(digest), tuple(payload))
        if index.count >= SHARD_DIGESTS:
            yield _frame(index)
            index = CuckooIndex()
    if index.count:
        yield _frame(index)


def _shard(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest of a shard, over all its input."""
    index = CuckooIndex()
    for frame in frames:
        for digest, *payload in zip(frame["digest"], _ids(frame["keep_id"]), frame["keep_chars"].tolist(), frame["group_size"].tolist()):
            _merge(index, bytes(digest), tuple(payload))
    if index.count:
        yield _frame(index)


def normalized(text: Column) -> Column:
    """The text without white space; NULL is empty. Plain replacements, as most texts hold two kinds of it."""
    out = F.coalesce(text, F.lit(""))
    for space in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, digest)`` of every row: code points of the original text, SHA-256 of the normalised one."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalized(F.col(text_col)), 256)).alias("digest"),
    )


def build_index(keyed: DataFrame, rows: int) -> DataFrame:
    """The live index ``(digest, keep_id, keep_chars, group_size)`` of ``digests`` rows, one row per digest."""
    entries = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.lit(1).cast("long").alias("group_size"))
    shards = parts_for(rows, SHARD_DIGESTS, keyed.sparkSession)
    return entries.mapInPandas(_combine, _ENTRY).repartition(shards, "digest").mapInPandas(_shard, _ENTRY)


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after its digests in ``removed(digest)`` were deleted and then the ``digests`` rows ``added`` came in.

    A removed digest loses its whole group; one that is added again starts a new group. Removing a digest that is
    not live does nothing.
    """
    spark = index.sparkSession
    entry = ["digest", "keep_id", "keep_chars", "group_size"]
    none = F.lit(None).cast("long")
    new = added.select("digest", F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.lit(1).cast("long").alias("group_size"))
    changes = index.select(*entry, F.lit(0).alias("turn")).unionByName(
        removed.select("digest", none.alias("keep_id"), F.lit(0).cast("long").alias("keep_chars"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("turn")).distinct()
    ).unionByName(new.mapInPandas(_combine, _ENTRY).withColumn("turn", F.lit(2)))

    def apply(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = CuckooIndex()
        for frame in frames:
            columns = zip(frame["turn"].tolist(), frame["digest"], _ids(frame["keep_id"]), frame["keep_chars"].tolist(), frame["group_size"].tolist())
            for turn, digest, *payload in columns:
                if turn == 1:
                    live.delete(bytes(digest))
                else:
                    _merge(live, bytes(digest), tuple(payload))
        if live.count:
            yield _frame(live)

    shards = parts_for(index.count() + added.count(), SHARD_DIGESTS, spark)
    return changes.repartition(shards, "digest").sortWithinPartitions("turn").mapInPandas(apply, _ENTRY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points stays, then the smallest id; NULL ids come last. NULL text is
    the empty text, so NULL, empty and blank texts form one group. Rows that repeat id and text are all kept in the
    output; those whose id is the kept id are all marked as kept, because nothing tells them apart. An empty table
    gives an empty result. Other columns are not read.
    """
    keyed = stage(digests(docs, id_col, text_col), "digests")
    total = keyed.count()
    index = stage(build_index(keyed, total), "digest-index")
    return hot_join(keyed, index, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The row that stays for every document; see ``exact_dedup``."""
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
