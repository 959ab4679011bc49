"""Listing folders of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def open_folder(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The matching files of a folder with their contents, unread so far; an absent folder is a missing file."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no folder {path}") from error
