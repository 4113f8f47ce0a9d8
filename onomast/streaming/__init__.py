"""The same functions over streams: stateless, so batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from onomast.functions.names import parse_name
from onomast.operators.match_join import match_pairs


def parsed_stream(names: DataFrame, text_col: str = "value") -> DataFrame:
    """The stream with its records in ``p``."""
    return names.withColumn("p", parse_name(text_col))


def matched_stream(names: DataFrame, registry: DataFrame, id_col: str, registry_id: str) -> DataFrame:
    """(left_id, right_id) of streamed names and a static table of parsed names."""
    return match_pairs(names, registry, id_col, registry_id)


def windowed_surnames(names: DataFrame, time_col: str, window: str = "1 day", late: str = "1 day", p: str = "p") -> DataFrame:
    """Surname counts per event-time window, final once the watermark has passed."""
    surname = F.array_join(F.col(p)["surname_words"], " ")
    timed = names.where(F.col(p).isNotNull()).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window), surname.alias("surname")).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, path: str) -> StreamingQuery:
    """Write all that is there now as Parquet under ``path`` and stop."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/table")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
