"""Time arithmetic on naive UTC stamps. All of it assumes a UTC session (``session.settle``)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros_of(length: timedelta) -> int:
    return (length.days * 86_400 + length.seconds) * 1_000_000 + length.microseconds


def to_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a naive stamp."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    """The naive stamp that many microseconds after 1970."""
    column = F.col(us) if isinstance(us, str) else us
    return F.timestamp_micros(column).cast("timestamp_ntz")


def whole_div(value: Column, width: int) -> Column:
    """Integer division of a bigint column, rounding down for negative values too."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def bin_number(ts: Column | str, cadence: timedelta, origin_us: int = 0) -> Column:
    """Ordinal of the left-closed bin of width ``cadence`` that holds ``ts``."""
    return whole_div(to_micros(ts) - F.lit(origin_us), micros_of(cadence))


def bin_start(number: Column | str, cadence: timedelta, origin_us: int = 0) -> Column:
    """The stamp a bin is labelled with: its left edge."""
    column = F.col(number) if isinstance(number, str) else number
    return from_micros(column * F.lit(micros_of(cadence)) + F.lit(origin_us))


def shift_time(ts: Column | str, cadence: timedelta, steps: Column | int) -> Column:
    """The stamp ``steps`` grid steps later: the time a forecast made at ``ts`` is valid for."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    return from_micros(to_micros(ts) + steps.cast("bigint") * F.lit(micros_of(cadence)))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Absolute difference of two stamps in seconds."""
    return F.abs(to_micros(a) - to_micros(b)) / F.lit(1_000_000.0)
