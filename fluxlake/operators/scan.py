"""A prefix scan of carries in several levels, so that no task sees more than one fan-out of a series.

A carry is a number that each element of a series turns into another by ``x -> a * x + b``: a count (a = 1), a run that an element
continues or ends (a = 1 or 0), a decaying sum (a < 1). Such steps combine to one of the same form in any grouping. Going up, every
``fan_out`` neighbours are combined to one element of the next level, until one is left; going down, each level's elements
get what their parent starts with.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlake.functions.times import whole_div
from fluxlake.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN_OUT = 512


def carried(df: DataFrame, steps: Mapping[str, tuple[str, str]], position: str, keys: Sequence[str] = (), fan_out: int = FAN_OUT) -> DataFrame:
    """``(keys.., position, name..)``: the carry that each element of a key's series starts from, 0 at its first one.

    ``steps``: for each carry its columns ``(a, b)``. Positions are whole numbers, distinct inside a key; gaps do not matter. NULL keys are
    a key. ``df`` is read several times and should be staged.
    """
    names = list(steps)
    key_type = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    numbers = [f"{part}{i}" for i in range(len(names)) for part in ("a", "b")]
    level = df.select(*keys, F.col(position).cast("bigint").alias("at"), *[F.col(c).cast("double").alias(numbers[2 * i + j]) for i, n in enumerate(names) for j, c in enumerate(steps[n])])
    ends = level.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    if ends["low"] is None:
        return level.select(*keys, F.col("at").alias(position), *[F.lit(0.0).alias(n) for n in names])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What comes before each element in its group, as one step, and the steps of its group up to it: at the last one, of the whole group."""
        state = [(1.0, 0.0)] * len(names)
        for batch in batches:
            begins, found = batch.column("_begins").to_pylist(), {}
            for i in range(len(names)):
                (a, b), parts = state[i], ([], [], [], [])
                for first, x, y in zip(begins, *(batch.column(f"{part}{i}").to_numpy(zero_copy_only=False).tolist() for part in ("a", "b"))):
                    if first:
                        a, b = 1.0, 0.0
                    parts[0].append(a)
                    parts[1].append(b)
                    a, b = a * x, b * x + y
                    parts[2].append(a)
                    parts[3].append(b)
                state[i] = a, b
                found.update(zip((f"a{i}", f"b{i}", f"all_a{i}", f"all_b{i}"), (pa.array(part, pa.float64(), from_pandas=True) for part in parts)))
            same = {name: batch.column(name) for name in (*keys, "at", "up", "last")}
            yield pa.RecordBatch.from_pydict({name: (found | same)[name] for name in shape_names})

    # Counted from the first position: groups of negative and of other numbers would never meet.
    base, high, levels = ends["low"], ends["high"] - ends["low"], []
    level = level.withColumn("at", F.col("at") - F.lit(base))
    wide = ", ".join(f"{n} double" for n in numbers)
    shape = f"{key_type}at bigint, {wide}, up bigint, {', '.join(f'all_{n} double' for n in numbers)}, last boolean"
    shape_names = [*keys, "at", *numbers, "up", *[f"all_{n}" for n in numbers], "last"]
    # A task takes its groups one after the other: there may be as many as there are keys.
    window = W.partitionBy(*keys, "up").orderBy("at")
    while True:
        high //= fan_out
        grouped = level.withColumn("up", whole_div(F.col("at"), fan_out)).withColumns(
            {"_begins": F.row_number().over(window) == 1, "last": F.lead("at").over(window).isNull()}
        )
        levels.append(stage(grouped.sortWithinPartitions(*keys, "up", "at").mapInArrow(scan, shape), "scan_level"))
        if not high:
            break
        level = levels[-1].where("last").select(*keys, F.col("up").alias("at"), *[F.col(f"all_{n}").alias(n) for n in numbers])
    found = None
    for rows in reversed(levels):
        if found is None:
            carry = {n: F.col(f"b{i}") for i, n in enumerate(names)}
        else:
            parents = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("at").alias("_of_at"), *[F.col(n).alias(f"_in_{n}") for n in names])
            same = F.col("up") == F.col("_of_at")
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
            rows = rows.join(parents, same)
            carry = {n: F.col(f"a{i}") * F.col(f"_in_{n}") + F.col(f"b{i}") for i, n in enumerate(names)}
        found = rows.select(*keys, "at", *[c.alias(n) for n, c in carry.items()])
    return found.withColumn("at", F.col("at") + F.lit(base)).withColumnRenamed("at", position)
