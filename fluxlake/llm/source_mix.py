"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, passed through as often as ``repeats`` allows. A document's virtual
finish time is the words of its source up to and with it, divided by the source's target, so all sources run
at speeds in proportion to their targets. The mix is the global order of finish times, cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlake.llm.common import by_shuffle, documents, word_count
from fluxlake.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
# Slices of a source's queue and of the finish times; each is summed before rows inside one are ordered.
SLICES = 4096


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, weight, target)`` for one row per source ``(source, source_size)``.

    Targets share ``share`` times all words by weight; none is above ``most`` times its source's words, and what is
    over goes to the others by weight. The result of handing on the excess until none is above is a common level:
    ``target = min(most * source_size, level * weight)``. Sources sorted by the level at which they are full give it
    from running sums. Windows run over one row per source. ``share`` above ``most`` fills all sources.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    table = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    table = table.select(
        "*", full.alias("full"), (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        (F.sum("source_size").over(all_rows) * F.lit(float(share))).alias("budget"),
    )
    # The level if the sources before this one are full and the rest is shared. It rises up to the first source that it
    # doesn't fill, which is the right one, and falls after it.
    level = (F.col("budget") - F.col("full")) / F.col("open")
    table = table.select("*", F.max(level).over(all_rows).alias("level"))
    return table.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _cut(queue: DataFrame, budget: float, repeats: int) -> Column | None:
    """The key of the last entry that the budget takes, as a struct literal; None if it takes every entry.

    Finish times are cut into ranges, whose words are summed; only the range in which the budget ends is ordered.
    The range is found from at most ``2 * SLICES + 1`` sums.
    """
    entries = queue.select("*", F.explode(F.array(*[F.lit(p) for p in range(repeats)])).alias("pass")).select("size", _key(F.col("pass")).alias("key"))
    part = F.least(F.floor(F.col("key.finish") * SLICES), F.lit(2 * SLICES)).alias("part")
    sums = entries.groupBy(part).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    last = sums.select("part", "words", upto.alias("upto")).where(F.col("upto") >= budget).orderBy("part").first()
    if last is None:
        return None
    left = budget - (last["upto"] - last["words"])
    before = F.coalesce(F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = entries.where(part == last["part"]).select("key", before.alias("before")).where(F.col("before") < left)
    end = inside.agg(F.max("key").alias("key")).first()["key"]
    return F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("finish", "source", "turn"), end, ("double", "string", "bigint"))])


def _key(number: Column) -> Column:
    """The place in the mix of pass ``number`` of a queue row: finish time, then source and shuffle hash."""
    finish = (F.col("upto") + number * F.col("source_size")) / F.col("target")
    return F.struct(finish.alias("finish"), F.col("source").cast("string").alias("source"), F.col("turn").alias("turn"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, repeats: int = 2,
    weights: tuple[float, ...] = WEIGHTS, seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken, copies, finish``.

    ``copies`` is how often the mix takes the document, ``taken`` its words times that, ``finish`` the virtual time of
    its first copy. The shuffle is a hash of id, size and source, so reruns agree; rows that tie in all three are
    taken together. NULL source is one source and the last in order; NULL ids are kept. NULL, empty and blank texts
    have size 0 and are never taken. The entry in which the budget ends is still taken, so each source ends within
    one document of its target. An empty table gives an empty result; other columns are not read.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
    ).withColumn("turn", F.xxhash64("doc_id", "size", "source", F.lit(seed)))
    # NULL as a key of its own: joins are then on plain equality.
    base = base.select("*", F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name"))
    base = stage(base.withColumn("slice", F.shiftrightunsigned("turn", 52).cast("int")), "mix-sizes")
    slices = stage(base.groupBy("unnamed", "name", "slice").agg(F.sum("size").alias("words")), "mix-slices")
    sizes = slices.groupBy("unnamed", "name").agg(F.sum("words").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size")
    wanted = stage(targets(sizes, share, float(repeats), weights), "mix-targets")
    budget = wanted.agg(F.sum("target")).first()[0] or 0.0
    wanted = wanted.select(F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target")

    # Words of the source before each slice, then up to each document inside its slice.
    order = Window.partitionBy("unnamed", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("unnamed", "name", "slice", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("start"))
    starts = starts.join(wanted, ["unnamed", "name"])
    inside = Window.partitionBy("unnamed", "name", "slice").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    queue = base.withColumn("inside", F.sum("size").over(inside)).join(by_shuffle(starts), ["unnamed", "name", "slice"])
    queue = stage(
        queue.select("doc_id", "source", "turn", "size", "source_size", "target", (F.col("start") + F.col("inside")).alias("upto")), "mix-queue"
    )
    live = (F.col("size") > 0) & (F.col("target") > 0)
    end = _cut(queue.where(live), budget, repeats)
    copies = sum((F.lit(1) if end is None else (_key(F.lit(p)) <= end).cast("int") for p in range(repeats)), F.lit(0))
    return queue.withColumn("copies", F.when(live, copies).otherwise(0)).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
        F.when(live, F.col("upto") / F.col("target")).alias("finish"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as the mix takes it.

    Rows are in order of finish time, over partitions and inside them. They are matched by id, source and size, so rows that
    repeat all three take one decision.
    """
    named = {"_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_nameless": F.col(id_col).isNull(), "_size": word_count(F.col(text_col)),
             "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_unnamed": F.col(source_col).isNull()}
    of_mix = {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_nameless": F.col("doc_id").isNull(), "_size": F.col("size"),
              "_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_unnamed": F.col("source").isNull()}
    taken = mix(docs, id_col, text_col, source_col, **settings).where("copies > 0")
    taken = taken.select(*[c.alias(n) for n, c in of_mix.items()], "copies", "finish", (F.col("source_size") / F.col("target")).alias("_again")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in named.items()]).join(by_shuffle(taken), list(named))
    passes = rows.select("_row", "finish", "_again", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_pass"))
    placed = passes.select("_row", (F.col("finish") + F.col("_pass") * F.col("_again")).alias("_finish"))
    return placed.repartitionByRange("_finish").sortWithinPartitions("_finish").select("_row.*")


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "finish")
