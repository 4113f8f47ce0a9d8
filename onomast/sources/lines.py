"""Names as lines of text files, one name a line, and their results as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions.names import json_record


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every line of the files at ``path``."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_lines``, as files arrive in the folder ``path``."""
    return spark.readStream.text(path)


def names_of(spark: SparkSession, *names: str) -> DataFrame:
    """(value) of names given one by one."""
    return spark.createDataFrame([(n,) for n in names], "value string")


def records_as_lines(parsed: DataFrame, p: str = "p") -> DataFrame:
    """(value) JSON of each record; an empty line where there was no name, so that
    lines stay aligned with their input."""
    return parsed.select(F.coalesce(json_record(p), F.lit("")).alias("value"))


def matches_as_lines(matches: DataFrame, text_col: str = "value") -> DataFrame:
    """(value) of matching input lines without white space around."""
    return matches.select(F.trim(text_col).alias("value"))
