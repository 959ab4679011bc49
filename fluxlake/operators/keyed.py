"""Joins of many rows with one row per group, where a group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of the small side that are sent to every task at most, and the slices of a group beyond that.
BROADCAST_ROWS = 100_000
SALTS = 16


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per group; a NULL key is a group like others.

    The groups are counted. Few are broadcast, so no row moves; otherwise each group's rows are dealt to slices by a
    hash of the whole row and the groups are repeated once per slice, so no task gets a whole group. Both give the same
    rows. ``groups`` is read twice: pass a staged table when it is costly.
    """
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _same_keys(rows, groups, keys, small=True)
    return attach_salted(rows, groups, keys)


def attach_salted(rows: DataFrame, groups: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return _same_keys(salted, repeated, [*keys, "_salt"]).drop("_salt")


def _same_keys(rows: DataFrame, groups: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    named = groups.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys])
    return rows.join(F.broadcast(named) if small else named, same).drop(*[f"_of_{k}" for k in keys])
