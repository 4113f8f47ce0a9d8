"""What Arrow kernels need on a worker: the transliteration table, broadcast once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from onomast.functions.transliteration import table

_broadcasts: dict[int, object] = {}


def shared_table():
    """The broadcast table of the active session (some 30,000 letters, a fixed size)."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("name functions need an active SparkSession")
    key = id(spark.sparkContext)
    if key not in _broadcasts:
        _broadcasts[key] = spark.sparkContext.broadcast(table(spark))
    return _broadcasts[key]


def ready(broadcast) -> None:
    """Install the table in this worker, the first time."""
    from onomast.kernel import translit

    if not translit._installed:
        translit.install(broadcast.value)
