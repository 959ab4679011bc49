"""Exact quantiles that no single task has to hold, in two scans of the table.

The first scan counts each group and brackets every wanted order statistic by approximate percentiles a little
below and above it. The second counts the rows below each bracket and tallies the distinct values inside, both combined before
the shuffle. A tally beyond ``ORDERED`` values is narrowed: its values are counted in slices, the counts are summed up over the
slices, and only the slices with the wanted ranks are kept, until few enough values are left. A running sum over those gives the exact
values. A bracket that misses its rank, which the approximation's error bound rules out, is widened until it holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlake.operators.keyed import attach
from fluxlake.session import stage

# Relative rank error of the approximate percentiles is at most 1 / ACCURACY; brackets reach MARGIN times that.
ACCURACY = 10_000
MARGIN = 3.0
# Distinct values that one task orders at most, and the slices that more of them are counted in.
ORDERED = 65_536
SLICES = 256


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = (), ordered: int = ORDERED) -> DataFrame:
    """``(keys.., name, q_0, q_1, ..)``: linearly interpolated quantiles of the values.

    NULL and NaN are left out. Infinities are values like others: a quantile between a finite and an infinite
    value is infinite, one between opposite infinities is NULL. Groups without values give no row; a NULL key
    is a group. No task orders more than ``ordered`` (at least 8) values of a group's order statistic.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    # Structs with NULLs in the same places are equal, so one struct of all keys keeps NULL keys through every join.
    group, margin = ["_keys", "name"] if keys else ["name"], MARGIN / ACCURACY
    own = [F.struct(*keys).alias("_keys")] if keys else []
    values = df.select(*own, pairs.alias("pair")).select(*group[:-1], "pair.name", F.nanvl("pair.value", F.lit(None).cast("double")).alias("value"))
    values = values.where("value IS NOT NULL")
    while True:
        answers, missed = _bracketed(values, group, probabilities, margin, max(ordered, 8))
        if not missed:
            return answers.select("_keys.*", *[c for c in answers.columns if c != "_keys"]) if keys else answers
        margin *= 8


def _bracketed(values: DataFrame, group: list[str], probabilities: Sequence[float], margin: float, ordered: int) -> tuple[DataFrame, bool]:
    ends = [(max(0.0, p - margin), min(1.0, p + margin)) for p in probabilities]
    percents = F.array(*[F.lit(float(e)) for pair in ends for e in pair])
    sizes = stage(
        values.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("value", percents, ACCURACY).alias("at")), "quantile_brackets"
    )
    slots = []
    for i in range(len(probabilities)):
        low, high = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        inside = F.when(F.col("value") >= low, F.col("value"))
        slots.append(F.when(F.col("value") <= high, F.struct(F.lit(i).alias("slot"), inside.alias("inside"))))
    near = attach(values, sizes.select(*group, "at"), group).select(*group, F.explode(F.array_compact(F.array(*slots))).alias("s")).select(*group, "s.*")
    # Rows below a bracket have no ``inside``; the rest are its distinct values.
    tally = stage(near.groupBy(*group, "slot", "inside").agg(F.count("*").alias("c")), "quantile_tally")
    slot = [*group, "slot"]
    probability = F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("slot") + 1)
    wanted = sizes.select(*group, "n", F.explode(F.sequence(F.lit(0), F.lit(len(probabilities) - 1))).alias("slot")).withColumn("position", probability * (F.col("n") - 1))
    below = tally.where("inside IS NULL").select(*slot, F.col("c").alias("below"))
    wanted = wanted.drop("n").join(below, slot, "left").fillna(0, ["below"])
    asked = stage(wanted, "quantile_ranks")
    held, wanted = _narrowed(tally.where("inside IS NOT NULL"), asked, slot, ordered)
    running = F.sum("c").over(W.partitionBy(*slot).orderBy("inside").rowsBetween(W.unboundedPreceding, 0))
    placed = attach(held.withColumn("upto", running), wanted, slot).withColumn("upto", F.col("upto") + F.col("below"))
    value_at = lambda rank: F.min_by("inside", F.when(F.col("upto") > rank(F.col("position")), F.col("upto")))
    # A rank below the bracket has no value, nor has one above it.
    starts = F.first("below") <= F.floor(F.first("position"))
    found = placed.groupBy(*slot).agg(
        F.when(starts, value_at(F.floor)).alias("low"), F.when(starts, value_at(F.ceil)).alias("high"), F.first("position").alias("position")
    )
    found = stage(asked.select(*slot).join(found, slot, "left"), "quantile_ends")
    missed = not found.where("low IS NULL OR high IS NULL").isEmpty()
    part = F.col("position") - F.floor("position")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).when(part == 0, F.col("low")).otherwise(
        F.nanvl(F.col("low") + (F.col("high") - F.col("low")) * part, F.lit(None).cast("double"))
    )
    wide = found.withColumn("q", between).groupBy(*group).agg(*[F.max(F.when(F.col("slot") == i, F.col("q"))).alias(f"q_{i}") for i in range(len(probabilities))])
    return wide, missed


def _narrowed(held: DataFrame, wanted: DataFrame, slot: list[str], ordered: int) -> tuple[DataFrame, DataFrame]:
    """The distinct values around each slot's rank, at most ``ordered`` of them, and the rows below those.

    ``held``: ``(slot.., inside, c)``, a value and its number of rows; ``wanted``: ``(slot.., position, below)``. Cuts between the slices are approximate
    percentiles of the distinct values, the counts of the slices are exact: only where the cuts lie is approximate. A slice has a small part
    of the values, so each round divides them by about half the number of slices.
    """
    slices = min(SLICES, ordered // 2)
    while not held.groupBy(*slot).agg(F.count("*").alias("values")).where(F.col("values") > ordered).isEmpty():
        percents = F.array(*[F.lit(i / slices) for i in range(1, slices)])
        crowd = stage(held.groupBy(*slot).agg(F.count("*").alias("values"), F.percentile_approx("inside", percents, ACCURACY).alias("cuts")), "quantile_cuts")
        # Slots with few values are one slice.
        cuts = crowd.select(*slot, F.when(F.col("values") > ordered, F.array_distinct("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts"))
        sliced = attach(held, cuts, slot).withColumn("slice", F.size(F.filter("cuts", lambda cut: cut < F.col("inside")))).drop("cuts")
        counts = sliced.groupBy(*slot, "slice").agg(F.sum("c").alias("rows"))
        # At most one row per slice and slot.
        upto = F.sum("rows").over(W.partitionBy(*slot).orderBy("slice").rowsBetween(W.unboundedPreceding, 0))
        spans = counts.withColumn("end", upto).join(wanted, slot).withColumns({"end": F.col("below") + F.col("end"), "start": F.col("below") + F.col("end") - F.col("rows")})
        first, last = F.floor("position"), F.ceil("position")
        # Of slots with one slice all of it stays, so that a rank outside is still seen to be missed.
        hit = ((F.col("start") <= last) & (F.col("end") > first)) | (F.count("*").over(W.partitionBy(*slot)) == 1)
        kept = stage(spans.withColumn("hit", hit).where("hit").select(*slot, "slice", "start", "position"), "quantile_slices")
        held = stage(attach(sliced, kept.select(*slot, "slice"), [*slot, "slice"]).drop("slice"), "quantile_held")
        wanted = stage(kept.groupBy(*slot).agg(F.first("position").alias("position"), F.min("start").alias("below")), "quantile_ranks")
    return held, wanted
