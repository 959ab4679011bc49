"""The trie of conversation prefixes, with count-min screening of prefix digests.

The digest of a prefix is a polynomial in the digests of its turns over a prime field: it is a running sum, so a long
conversation is split over range partitions and every part starts from the sum before it. A count-min sketch counts the digests of
all prefixes. An estimate of one proves that a prefix belongs to one conversation only: such nodes form tails whose every figure
is known on the spot, so they are emitted locally. Only prefixes that may be shared are shuffled and grouped exactly. Sums over
subtrees of shared nodes are taken by pointer jumping, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.llm.common import HOT_PARTS, hot_join, parts_for, small_batches
from fluxlake.session import settle, shared_dir, stage

# The field of the digests and the polynomial's point.
PRIME = (1 << 127) - 1
POINT = 0x5851F42D4C957F2D14057B7EF767814F
# Conversations of a family share the beginning of its first one; at most so many turns, less one.
FAMILY, HEADS = 5, 9
# Rows of a partition, digits of ids hashed at a time, and the sketch's counters: at least this many times the prefixes, in two rows.
PART_ROWS = 200_000
BLOB_IDS = 4096
SKETCH_LOAD, SKETCH_BITS = 8, (16, 27)
_NUMBERS = ["hi", "lo"]


def turn_digest(role: str, text: str) -> int:
    """A number below the prime for a turn."""
    role = role.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_intdigest(b"%d:" % len(role) + role + text.encode("utf-8", "surrogatepass")) % (PRIME - 1) + 1


def _split(value: int) -> tuple[int, int]:
    """A number of the field as two signed 64-bit ones."""
    low = value & ((1 << 64) - 1)
    return value >> 64, low - (1 << 64) if low >> 63 else low


def _joined(high: int, low: int) -> int:
    return int(high) << 64 | int(low) & ((1 << 64) - 1)


def _positions(turns: DataFrame) -> DataFrame:
    """``(conv, place, hi, lo, before_hi, before_lo, bytes)`` of every turn: its place and the digests of the prefixes to and before it.

    Turns are ordered by number (NULL first), role and text, and rows that are equal in all of them are interchangeable. Partitions are
    ranges of that order, so a conversation may span several; what each starts from is folded from one row per partition.
    """
    spark = turns.sparkSession
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    parts = parts_for(turns.count(), PART_ROWS, spark)
    names = ["part", "conv", "i", "hi", "lo", "before_hi", "before_lo", "bytes"]

    def scan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, i, total, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for frame in frames:
            out = []
            for conv, role, text in frame[["conv", "role", "text"]].itertuples(index=False, name=None):
                if conv != now:
                    now, i, total, power = conv, 0, 0, 1
                before = total
                total = (total + turn_digest(role, text) * power) % PRIME
                out.append((part, conv, i, *_split(total), *_split(before), len(text.encode("utf-8", "surrogatepass"))))
                i, power = i + 1, power * POINT % PRIME
            yield pd.DataFrame(out, columns=names)

    ranged = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = stage(ranged.mapInPandas(scan, "part int, conv bigint, i bigint, hi bigint, lo bigint, before_hi bigint, before_lo bigint, bytes bigint"), "turns")
    # One row per partition comes to the driver: its first conversation, and its last one with what it holds of that.
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "i", "hi", "lo")).alias("last")).orderBy("part").collect()
    carries: dict[int, tuple[int, int, int]] = {}
    now, count, total = None, 0, 0
    for row in ends:
        if row.first == now:
            carries[row.part] = now, count, total
        if row.last.conv != now:
            now, count, total = row.last.conv, 0, 0
        total = (total + _joined(row.last.hi, row.last.lo) * pow(POINT, count, PRIME)) % PRIME
        count += row.last.i + 1

    def carry(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, some in frame.groupby("part", sort=False):
                first, more, start = carries.get(part, (None, 0, 0))
                of = (some["conv"] == first).to_numpy() if first is not None else np.zeros(len(some), bool)
                some = some.drop(columns="part").rename(columns={"i": "place"})
                if of.any():
                    power = pow(POINT, more, PRIME)
                    some.loc[of, "place"] += more
                    for high, low in (_NUMBERS, ["before_hi", "before_lo"]):
                        moved = [_split((start + _joined(*x) * power) % PRIME) for x in some.loc[of, [high, low]].itertuples(index=False, name=None)]
                        some.loc[of, [high, low]] = np.array(moved, np.int64)
                yield some

    return stage(local.mapInPandas(carry, "conv bigint, place bigint, hi bigint, lo bigint, before_hi bigint, before_lo bigint, bytes bigint"), "places")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations ``(conv, length)``, and their prefixes ``(conv, depth, hi, lo, up_hi, up_lo, bytes, last)``.

    The digest of a rebuilt prefix beyond the borrowed turns follows from the conversation's own digests by a shift and a
    constant, so no turn is hashed or sorted again.
    """
    places = _positions(turns)
    head = F.when(F.col("place") < HEADS - 1, F.struct("place", "hi", "lo", "bytes"))
    convs = stage(places.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(head)).alias("heads")), "conversations")
    base = F.col("conv") - F.col("conv") % FAMILY
    borrows = convs.where(F.col("conv") != base).withColumn("base", base)
    lenders = convs.select(F.col("conv").alias("base"), F.col("heads").alias("lent"))
    borrows = borrows.join(lenders, "base", "left").select("conv", "n", "heads", F.coalesce("lent", F.slice("heads", 1, 0)).alias("lent"))
    names = ["conv", "n", "h", "k", "add_hi", "add_lo", "length", "lent"]

    def plan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, n, heads, lent, h in frame.itertuples(index=False, name=None):
                lent = list(lent[:h])
                k, add = len(lent), 0
                if n >= h:
                    mine = _joined(heads[h - 1]["hi"], heads[h - 1]["lo"]) if h else 0
                    theirs = _joined(lent[-1]["hi"], lent[-1]["lo"]) if k else 0
                    add = (theirs - mine * pow(POINT, k - h, PRIME)) % PRIME
                out.append((conv, n, h, k, *_split(add), k + max(0, n - h), lent))
            yield pd.DataFrame(out, columns=names, dtype=object)

    lent_type = borrows.schema["lent"].dataType.simpleString()
    borrows = borrows.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    planned = borrows.mapInPandas(plan, f"conv bigint, n bigint, h bigint, k bigint, add_hi bigint, add_lo bigint, length bigint, lent {lent_type}")
    zero = F.lit(0).cast("bigint")
    own = convs.where(F.col("conv") == base).select("conv", "n", *[zero.alias(x) for x in names[2:6]], F.col("n").alias("length"), F.slice("heads", 1, 0).alias("lent"))
    planned = stage(planned.unionByName(own), "plans")

    shape = "conv bigint, depth bigint, hi bigint, lo bigint, up_hi bigint, up_lo bigint, bytes bigint, last boolean"

    def shift(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = [pow(POINT, -less, PRIME) for less in range(HEADS)]
        for frame in frames:
            less, add = (frame["h"] - frame["k"]).to_numpy(), list(zip(frame["add_hi"], frame["add_lo"]))
            out = pd.DataFrame({"conv": frame["conv"], "depth": frame["place"] - less + 1})
            for names, high, low in ((["hi", "lo"], "hi", "lo"), (["up_hi", "up_lo"], "before_hi", "before_lo")):
                rows = zip(frame[high], frame[low], less, add)
                moved = [(x, y) if not a[0] and not a[1] and not m else _split((_joined(*a) + _joined(x, y) * powers[m]) % PRIME) for x, y, m, a in rows]
                out[names] = np.array(moved, np.int64).reshape(-1, 2)
            out["bytes"], out["last"] = frame["bytes"], out["depth"] == frame["length"]
            yield out

    total = planned.agg(F.sum("n")).first()[0] or 0
    kept = hot_join(places, planned.drop("lent"), "conv", "n", total).where(F.col("place") >= F.col("h"))
    kept = kept.select("conv", "place", "hi", "lo", "before_hi", "before_lo", "bytes", "h", "k", "add_hi", "add_lo", "length").mapInPandas(shift, shape)
    one, up = F.col("lent")[F.col("at")], F.col("lent")[F.col("at") - 1]
    lent = planned.where(F.size("lent") > 0).select("conv", "length", "lent", F.explode(F.sequence(F.lit(0), F.size("lent") - 1)).alias("at")).select(
        "conv", (F.col("at") + 1).cast("bigint").alias("depth"), one["hi"].alias("hi"), one["lo"].alias("lo"),
        *[F.when(F.col("at") > 0, up[x]).otherwise(F.lit(0)).cast("bigint").alias(f"up_{x}") for x in _NUMBERS],
        one["bytes"].alias("bytes"), (F.col("at") + 1 == F.col("length")).alias("last"),
    )
    return planned.select("conv", "length"), stage(kept.unionByName(lent), "prefixes")


class Sketch:
    """A count-min sketch of digests, reduced to what is asked of it: the counters of two rows that are above one."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def counters(low: Column, bits: int) -> Column:
        """The counter of a digest in each row; the second row's come after the first one's."""
        return F.array(low.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(low, 64 - bits) + F.lit(1 << bits))

    @staticmethod
    def of(rows: DataFrame, low: str, total: int) -> Sketch:
        """The sketch of all ``rows``: one bit for each of at most 2 * 2**27 counters, so at most 32 MB whatever the rows.

        Beyond that size it proves less and less, and more rows are grouped exactly.
        """
        bits = min(max((total * SKETCH_LOAD).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
        counts = rows.select(F.explode(Sketch.counters(F.col(low), bits)).alias("counter")).groupBy("counter").count().where("count > 1")
        words = counts.groupBy(F.shiftright("counter", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(counter & 63 AS int)))").alias("ones")).toArrow()
        out = np.zeros(1 << (bits + 1 - 6), np.uint64)
        out[words["word"].to_numpy()] = words["ones"].to_numpy().view(np.uint64)
        return Sketch(out, bits)

    def above_one(self, low: np.ndarray) -> np.ndarray:
        """Whether the estimate of each digest, the least of its counters, is above one."""
        low, out = np.asarray(low, np.int64).view(np.uint64), np.ones(len(low), bool)
        for counter in (low & np.uint64((1 << self.bits) - 1), (low >> np.uint64(64 - self.bits)) + np.uint64(1 << self.bits)):
            out &= (self.words[counter >> np.uint64(6)] >> (counter & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _ends_digest(ends: DataFrame, total: int) -> DataFrame:
    """``(depth, hi, lo, ends_sha256)``: SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined.

    Ranges of (node, id) write their ids in blobs; a node's blobs are then hashed one after another, never held together.
    """
    key = ["depth", "hi", "lo"]
    parts = parts_for(total, PART_ROWS, ends.sparkSession)

    def blobs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, some in frame.groupby(key, sort=False):
                ids = some["conv"].tolist()
                out += [(*node, ids[at], ",".join(map(str, ids[at:at + BLOB_IDS]))) for at in range(0, len(ids), BLOB_IDS)]
            yield pd.DataFrame(out, columns=[*key, "first", "blob"])

    def hashed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for frame in frames:
            out = []
            for *node, blob in frame[[*key, "blob"]].itertuples(index=False, name=None):
                if node != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(blob.encode())
                else:
                    digest.update(b"," + blob.encode())
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*key, "ends_sha256"])

    rows = ends.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv")
    rows = rows.mapInPandas(blobs, "depth bigint, hi bigint, lo bigint, first bigint, blob string")
    return rows.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(hashed, "depth bigint, hi bigint, lo bigint, ends_sha256 string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``(node, leaves, saved)`` summed over the subtrees of ``nodes(node, up, leaves, saved)``; the root's ``up`` is NULL.

    After some rounds a node's sums take in all nodes less than that power of two below it, and ``up`` points that far up.
    """
    live = stage(nodes, "subtrees")
    while not live.where("up IS NOT NULL").isEmpty():
        below = live.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("n"))
        total = stage(live.join(below, "node", "left"), "sums")
        ups = total.where("n IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("next"), "n")
        moving = total.where("up IS NOT NULL").drop("n")
        moved = hot_join(moving, ups, "up", "n", total.count()).drop("n", "up").withColumnRenamed("next", "up")
        both = moved.unionByName(total.where("up IS NULL").drop("n"))
        live = stage(both.select(
            "node", "up", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ), "subtrees")
    return live.select("node", "leaves", "saved")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations; the contract's columns, and ``shared`` (has two members or more).

    Turns are ordered by number, NULL first, then by role and text; NULL roles and texts count as empty. Rows without a conversation's id
    belong to none. Repeated rows are turns of their own. An empty table has no node, not even a root. Other columns are not read.
    Ids are integers.
    """
    spark = turns.sparkSession
    small_batches(spark)
    turns = turns.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    convs, prefixes = _rebuilt(turns)
    total = prefixes.count()
    sketch = spark.sparkContext.broadcast(Sketch.of(prefixes, "lo", total))

    @F.pandas_udf("boolean")
    def maybe_shared(low: pd.Series) -> pd.Series:
        return pd.Series(sketch.value.above_one(low.to_numpy()))

    up_shared = F.when(F.col("depth") > 1, maybe_shared("up_lo")).otherwise(F.lit(True))
    seen = stage(prefixes.withColumns({"maybe": maybe_shared("lo"), "up_maybe": up_shared}), "screened")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv", *[zero.alias(x) for x in ("depth", "hi", "lo", "up_hi", "up_lo", "bytes")], (F.col("length") == 0).alias("last"))
    possible = seen.where("maybe").drop("maybe", "up_maybe").unionByName(roots)

    # Exact grouping of what may be shared.
    key = ["depth", "hi", "lo"]
    groups = possible.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min(F.struct("up_hi", "up_lo", "bytes")).alias("rest"), F.max("last").alias("last"))
    groups = stage(groups.select(*key, "conv", "n", "rest.*", "last"), "groups")
    nodes = groups.where((F.col("n") > 1) | (F.col("depth") == 0))
    single = groups.where((F.col("n") == 1) & (F.col("depth") > 0))
    # A member's node is its own at each depth, so conversation and depth name a node.
    alone = seen.where(~F.col("maybe")).select(*key, "conv", "up_hi", "up_lo", "last", "up_maybe").unionByName(
        single.select(*key, "conv", "up_hi", "up_lo", "last").withColumn("up_maybe", F.lit(True)),
    )
    tails = alone.where(~F.col("up_maybe")).select("conv", "depth", F.col("conv").alias("parent"), "last")
    heads = stage(alone.where("up_maybe").select("conv", "depth", "up_hi", "up_lo", "last"), "tail-heads")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv").alias("parent"), "n")
    with_parent = _find(heads, above, total)
    heads = with_parent.select("conv", "depth", F.coalesce("parent", "conv").alias("parent"), "last", F.col("parent").isNotNull().alias("attached"))
    heads = stage(heads, "tail-parents")

    linked = stage(_find(nodes.select(*key, "conv", "n", "up_hi", "up_lo", "bytes").withColumnRenamed("n", "members"), above, total).drop("n"), "shared")
    node, up = F.struct("conv", "depth"), F.struct(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
    single_children = heads.where("attached").groupBy(up.alias("node")).agg(F.count(F.lit(1)).alias("singles"))
    shared_children = linked.where("parent IS NOT NULL").groupBy(up.alias("node")).agg(F.count(F.lit(1)).alias("branches"))
    shaped = linked.withColumn("node", node).join(single_children, "node", "left").join(shared_children, "node", "left").na.fill(0, ["singles", "branches"])
    shaped = stage(shaped.withColumn("children", F.col("singles") + F.col("branches")), "shapes")
    sums = _subtrees(shaped.select(
        "node", F.when(F.col("parent").isNotNull(), up).alias("up"), F.when(F.col("children") == 0, 1).otherwise(F.col("singles")).cast("bigint").alias("leaves"),
        ((F.col("members") - 1) * F.col("bytes")).alias("saved"),
    ))
    ends = _ends_digest(possible.where("last").select(*key, "conv"), total)
    none = hashlib.sha256(b"").hexdigest()
    shared = shaped.join(sums, "node").join(ends, key, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        (F.col("members") > 1).alias("shared"),
    )
    lonely = tails.unionByName(heads.drop("attached")).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(none)).alias("ends_sha256"), F.lit(False).alias("shared"),
    )
    return shared.unionByName(lonely)


def _find(rows: DataFrame, above: DataFrame, total: int) -> DataFrame:
    """Left join of ``rows`` with the nodes above them. Nodes with a thousandth of all prefixes, at most 1,000, are broadcast."""
    key = ["depth", "up_hi", "up_lo"]
    hot = rows.join(F.broadcast(above.where(F.col("n") * HOT_PARTS >= F.lit(total))), key, "left")
    rest = hot.where("parent IS NULL").drop("parent", "n").join(above.where(F.col("n") * HOT_PARTS < F.lit(total)), key, "left")
    return hot.where("parent IS NOT NULL").unionByName(rest)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations; see ``prefix_trie``."""
    settle(spark)
    shared_dir(spark)
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
