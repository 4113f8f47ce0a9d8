"""Scratch tables and files in the folder that all executors share.

The folder comes from ``spark.checkpoint.dir``; only a local session that leaves it
unset (tests) gets one of this machine's.
"""

from __future__ import annotations

import atexit
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT = "/tmp/checkpoints/onomast"
#: Seconds between collections of plans that are not used any more.
_SWEEP_S = 20
#: (session, folder, weak reference to the file index of the table in it)
_made: list[tuple[object, str, object]] = []
_swept = 0.0


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; sets one if a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{_DEFAULT}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def made(spark: SparkSession, path: str) -> str:
    """The folder ``path``, made if it is not there, as a full URI."""
    fs, p = _filesystem(spark, path)
    fs.mkdirs(p)
    return fs.makeQualified(p).toString()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder URI under the shared folder.  It goes when it is dropped, when no
    plan reads the table in it any more, or with the session's JVM or this process."""
    _sweep(spark)
    path = made(spark, f"{shared_dir(spark)}/onomast-{label}-{uuid.uuid4().hex}")
    fs, p = _filesystem(spark, path)
    fs.deleteOnExit(p)
    _made.append((spark, path, None))
    return path


def _sweep(spark: SparkSession) -> None:
    """Drop the tables that no plan of the session reads: every plan over a table shares
    its file index, so the index is collected after the last of them."""
    global _swept
    if time.monotonic() - _swept < _SWEEP_S or not any(index is not None for *_, index in _made):
        return
    spark.sparkContext._jvm.System.gc()
    for entry in list(_made):
        owner, path, index = entry
        if index is not None and owner.sparkContext is spark.sparkContext and index.get() is None:
            _made.remove(entry)
            drop(spark, path)
    _swept = time.monotonic()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no plan needs again."""
    _made[:] = [entry for entry in _made if entry[1] != path]
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, label: str, rows: str = "few") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts
    lineage and survives the loss of any executor.

    ``rows`` says how many there are beside the table that they come from: "few"
    (after a shuffle) merges partitions, "slim" (a scan's small rows) deals them out
    anew after the scan's work, both to a sixteenth of the shuffle partitions, so that
    derived tables are not many tiny files; "all" keeps the partitions.
    """
    spark = df.sparkSession
    files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    if rows == "few":
        df = df.coalesce(files)
    elif rows == "slim":
        df = df.repartition(files)
    folder = scratch(spark, label)
    df.write.parquet(f"{folder}/table")
    out = spark.read.schema(df.schema).parquet(f"{folder}/table")
    index = out._jdf.queryExecution().analyzed().relation().location()
    _made[:] = [entry for entry in _made if entry[1] != folder]
    _made.append((spark, folder, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return out


@atexit.register
def _tidy() -> None:
    for spark, path, _ in list(_made):
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            continue
        try:
            drop(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
