"""Raw files in the shared folder, for tasks that write or read bytes.

Paths are URIs; pyarrow's file systems open them, so local paths, HDFS and object
stores work alike and no task touches its machine's own folders.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def sliced(batches, rows: int = 256):
    """Arrow batches cut small, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def create(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None)


def stream(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)


def opened(uri: str):
    """A file to seek in."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def read_range(uri: str, offset: int, length: int):
    """A buffer with the bytes of a part of a file."""
    with opened(uri) as f:
        f.seek(offset)
        return f.read_buffer(length)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def dealt(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` (one per file or block), one task for each as far as ``most``."""
    return rows.repartition(max(1, min(most, rows.count())))
