"""Inputs the driver's tables do not contain, derived from every row of ``events`` by fixed rules."""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARCHIVE_EVENTS = 2_000
FOLDER_EVENTS = 500
FILL = -1e31
# Archives end with a comment of one line end, which is what the text writer puts behind a row.
LINE_END = b"\n"

# Sent along with the tasks, so that workers do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def source_file() -> Column:
    return F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string"))


def damaged_value() -> Column:
    """Fill values and zeros among the readings."""
    return F.when(F.col("event_id") % 97 == 0, F.lit(FILL)).when(F.col("event_id") % 89 == 0, F.lit(0.0)).otherwise(F.col("value"))


def vector() -> Column:
    good = F.array(F.col("value") - 50, F.col("value") / 2, (F.col("event_id") % 7).cast("double"))
    return F.when(F.col("event_id") % 97 == 0, F.array(F.lit(FILL), F.lit(FILL), F.lit(FILL))).otherwise(good)


def flux_records(events: DataFrame, name: str = "E2W_COR_FLUX") -> DataFrame:
    """Two-channel flux records."""
    return events.select(
        F.col("ts").alias("Epoch"), F.array(damaged_value(), F.col("value") / 2).alias(name),
        source_file().alias("source_file"), F.col("event_id").alias("ordinal"),
    )


def field_records(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").alias("Epoch"), vector().alias("BGSE"), source_file().alias("source_file"), F.col("event_id").alias("ordinal"))


def plasma_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").alias("Epoch"), vector().alias("V_GSE"), (damaged_value() / 10).alias("Np"),
        source_file().alias("source_file"), F.col("event_id").alias("ordinal"),
    )


def hourly_records(events: DataFrame) -> DataFrame:
    """Records with many duplicates: stamps cut to the hour."""
    return events.select(
        F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts"), damaged_value().alias("electron_flux"),
        source_file().alias("source_file"), F.col("event_id").alias("ordinal"),
    )


def misdated_records(events: DataFrame) -> DataFrame:
    """Some stamps 26 years too early and some 31 years too late."""
    kind = F.col("event_id") % 500
    years = F.when(kind == 0, F.lit(-26 * 12)).when(kind == 1, F.lit(31 * 12)).otherwise(F.lit(0))
    return events.select(
        "event_id", (F.col("ts") + F.make_ym_interval(F.lit(0), years)).alias("ts"), "value", source_file().alias("source_file")
    )


def line_a() -> Column:
    """Layout A; every tenth line is written as hour + 24 of the day before."""
    rolled = F.col("event_id") % 10 == 0
    doy, hour = F.dayofyear("ts"), F.hour("ts")
    return F.concat_ws(
        " ", F.year("ts"), F.when(rolled, doy - 1).otherwise(doy), F.when(rolled, hour + 24).otherwise(hour), F.minute("ts"),
        F.expr("extract(SECOND FROM ts)"), F.col("value"),
    )


def line_b() -> Column:
    """Layout B: two or one token for the stamp; every fiftieth ISO line has a second value."""
    stamp = lambda sep: F.date_format("ts", f"yyyy-MM-dd{sep}HH:mm:ss.SSSSSS")
    return (
        F.when(F.col("event_id") % 50 == 0, F.concat_ws(" ", stamp("'T'"), F.col("value"), F.lit("0.5")))
        .when(F.col("event_id") % 2 == 0, F.concat_ws("   ", stamp(" "), F.col("value"), F.lit("7")))
        .otherwise(F.concat_ws("\t", stamp("'T'"), F.col("value")))
    )


def text_lines(events: DataFrame) -> DataFrame:
    """Three files: one per layout and one mixed, with comment lines."""
    member = F.col("user_id") % 3
    text = F.when(member == 0, line_a()).when(member == 1, line_b()).when(F.col("event_id") % 2 == 0, line_a()).otherwise(line_b())
    line = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("  # "), text)).otherwise(text)
    return events.select(
        F.lit("events").alias("archive"), F.concat(F.lit("m"), member.cast("string"), F.lit(".txt")).alias("member"),
        F.col("event_id").alias("line_no"), line.alias("line"),
    )


def _zipped(group: pd.DataFrame, damaged: int = 0) -> pd.DataFrame:
    group = group.sort_values("event_id")
    name = group["archive"].iloc[0]
    document = (
        f'<product id="{name}"><instrument><name>counter</name><unit scale="log">flux</unit></instrument>'
        f"<first>{group['event_id'].min()}</first><records>0</records><records>{len(group)}</records></product>"
    )
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("FLUX.TXT", "# year doy hour minute second flux\n" + "\n".join(group["line"]) + "\n")
        archive.writestr("meta.xml", document)
        archive.writestr("plot.PNG", b"\x89PNG", zipfile.ZIP_STORED)
        archive.comment = LINE_END
    content = packed.getvalue()
    if damaged and int(name[1:]) % damaged == 0:
        # One byte of the last member's data, which its checksum then no longer fits.
        content = content.replace(b"\x89PNG", b"\x89PNX")
    return pd.DataFrame({"path": [f"/archives/{name}.zip"], "content": [content]})


def archives(events: DataFrame, damaged: int = 0, size: int = ARCHIVE_EVENTS) -> DataFrame:
    """The events packed into ZIP files of a bounded number of consecutive records each.

    With ``damaged``, every so manieth archive, from the first on, holds a member that fails its checksum.
    """
    number = F.call_function("div", F.col("event_id"), F.lit(size))
    lines = events.select("event_id", F.concat(F.lit("a"), F.lpad(number.cast("string"), 9, "0")).alias("archive"), line_a().alias("line"))
    return lines.groupBy("archive").applyInPandas(lambda group: _zipped(group, damaged), "path string, content binary")


def write_archive_folder(events: DataFrame, path: str, damaged: int, strange: int) -> None:
    """The archives as files in a folder laid out as ``archive=..``, and a text file that is no archive for every so manieth."""
    packed = archives(events, damaged, FOLDER_EVENTS).select(
        F.substring_index("path", "/", -1).alias("archive"), F.expr("substring(content, 1, length(content) - 1)").cast("string").alias("value")
    )
    number = F.call_function("div", F.col("event_id"), F.lit(FOLDER_EVENTS))
    others = events.select(number.alias("number")).where(F.col("number") % strange == 0).distinct().select(
        F.concat(F.lit("x"), F.col("number").cast("string"), F.lit(".zip")).alias("archive"), F.lit("no archive").alias("value")
    )
    packed.unionByName(others).write.partitionBy("archive").text(path)
