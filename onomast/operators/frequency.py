"""Counts over parsed names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions.names import surname


def surname_frequency(parsed: DataFrame, k: int, p: str = "p") -> DataFrame:
    """The ``k`` most frequent surnames, ties by surname."""
    counted = parsed.where(F.col(p).isNotNull()).groupBy(surname(p).alias("surname")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "surname").limit(k)


def parse_stats(parsed: DataFrame, *by: str, p: str = "p") -> DataFrame:
    """How many rows were names and how many were not."""
    valid = F.col(p).isNotNull()
    return parsed.groupBy(*by).agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))


def block_sizes(parsed: DataFrame, p: str = "p") -> DataFrame:
    """(surname_key, n): what a match join has to pair up."""
    return parsed.where(F.col(p).isNotNull()).groupBy(F.col(p)["surname_key"].alias("surname_key")).agg(F.count("*").alias("n"))
