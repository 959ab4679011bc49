"""Two text layouts of flux files, parsed with column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlake.functions.times import from_micros, to_micros
from fluxlake.operators.keyed import attach
from fluxlake.session import stage

# ---- fixed values: white space, comment marks, whole and decimal numbers -----------------------
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DATA_LINE = f"^{SPACE}*(?!{SPACE}|#|%|//|!)."
WHOLE_NUMBER = r"^[+-]?\d+(_\d+)*$"
DECIMAL_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
NAMED_NUMBER = r"(?i)^[+-]?(inf|infinity|nan)$"
REJECT_LINES = 5


def _is_data(line: Column) -> Column:
    """Neither blank nor a comment; one match at the start of the line."""
    return line.rlike(DATA_LINE)


def _tokens(line: Column) -> Column:
    """Words of a line. Splitting on one plain character needs no pattern compiled per row."""
    return F.array_remove(F.split(F.translate(line, SPACES, " " * len(SPACES)), " "), "")


def _whole(token: Column) -> Column:
    return F.when(token.rlike(WHOLE_NUMBER), F.replace(token, F.lit("_"), F.lit("")).try_cast("bigint"))


def _decimal(token: Column) -> Column:
    ok = token.rlike(DECIMAL_NUMBER) | token.rlike(NAMED_NUMBER)
    return F.when(ok, F.replace(token, F.lit("_"), F.lit("")).try_cast("double"))


def with_layouts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``a`` and ``b``, each ``struct(ts, electron_flux)`` or NULL: the line read by either layout.

    Layout A is ``YYYY DOY HH MM SS flux ..``; the parts of its time are added up, so a day 400 or an
    hour 30 rolls over. Layout B is ``date time flux ..`` or ``dateTtime flux``; with three or more values
    the first two are the stamp, so an ISO stamp followed by two values is rejected.
    The line is split once and every token parsed once, each in a projection of its own.
    """
    part = lambda i: F.get(F.col("_parts"), i)
    split_stamp = F.size("_parts") >= 3
    stamp = F.when(split_stamp, F.concat_ws(" ", part(0), part(1))).otherwise(F.translate(part(0), "T", " "))
    typed = lines.withColumn("_parts", _tokens(F.col(line))).withColumns(
        {
            "_year": _whole(part(0)), "_doy": _whole(part(1)), "_hour": _whole(part(2)), "_minute": _whole(part(3)),
            "_second": _decimal(part(4)), "_flux_a": _decimal(part(5)),
            "_stamp": stamp.try_cast("timestamp_ntz"), "_flux_b": F.when(split_stamp, _decimal(part(2))).otherwise(_decimal(part(1))),
        }
    )
    january = F.make_date(F.col("_year").cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    whole = (F.col("_doy") - 1) * F.lit(86_400) + F.col("_hour") * F.lit(3_600) + F.col("_minute") * F.lit(60)
    us = to_micros(january) + whole * F.lit(1_000_000) + F.rint(F.col("_second") * F.lit(1e6)).cast("bigint")
    bounds = {"_doy": 1e8, "_hour": 1e9, "_minute": 1e10, "_second": 1e12}
    in_range = F.col("_year").between(1, 9999)
    for name, limit in bounds.items():
        in_range = in_range & (F.abs(F.col(name)) < F.lit(limit))
    a = F.when(in_range & F.col("_flux_a").isNotNull(), F.struct(from_micros(us).alias("ts"), F.col("_flux_a").alias("electron_flux")))
    b = F.when(
        F.col("_stamp").isNotNull() & F.col("_flux_b").isNotNull(),
        F.struct(F.col("_stamp").alias("ts"), F.col("_flux_b").alias("electron_flux")),
    )
    return typed.select(*lines.columns, a.alias("a"), b.alias("b"))


def layout_rows(lines: DataFrame, layout: str, carry: Sequence[str]) -> DataFrame:
    """``(carry.., ts, electron_flux)`` of the lines that fit layout ``a`` or ``b``."""
    return with_layouts(lines).where(F.col(layout).isNotNull()).select(*carry, f"{layout}.*")


def parse_text(lines: DataFrame, file: Sequence[str] = ("archive", "member")) -> DataFrame:
    """Lines as ``(file.., line_no, layout, ts, electron_flux)``.

    The layout is chosen per file: one line that fits A means only its A lines count. That is one small
    aggregate per file, combined before the shuffle, rather than a window over all lines of a file. The
    lines are opened and parsed once and staged, because both that aggregate and the result read them.
    """
    carried = [c for c in ("member_no",) if c in lines.columns]
    read = with_layouts(lines.where(_is_data(F.col("line")))).select(*file, *carried, "line_no", "a", "b")
    data = stage(read, "parsed_lines")
    layouts = data.groupBy(*file).agg(F.bool_or(F.col("a").isNotNull()).alias("_has_a"))
    record = F.when(F.col("_has_a"), F.col("a")).otherwise(F.col("b"))
    return (
        attach(data, layouts, file)
        .where(record.isNotNull())
        .select(
            *file, *carried, "line_no", F.when(F.col("_has_a"), "A").otherwise("B").alias("layout"),
            record["ts"].alias("ts"), record["electron_flux"].alias("electron_flux"),
        )
    )


def rejected_lines(lines: DataFrame, file: Sequence[str] = ("archive", "member")) -> DataFrame:
    """The first lines of each file that has data lines but fits neither layout, to look at by hand."""
    fits = F.col("a").isNotNull() | F.col("b").isNotNull()
    data = _is_data(F.col("line"))
    failed = (
        with_layouts(lines).groupBy(*file)
        .agg(
            F.bool_or(data).alias("_has_data"),
            F.bool_or(data & fits).alias("_fits"),
            F.min(F.when(F.col("line").rlike(f"(?!{SPACE})."), F.col("line_no"))).alias("_first"),
        )
        .where("_has_data AND NOT _fits")
    )
    head = F.col("line_no").between(F.col("_first"), F.col("_first") + REJECT_LINES - 1)
    return attach(lines, stage(failed, "failed_files"), file).where(head).select(*file, "line_no", "line")
