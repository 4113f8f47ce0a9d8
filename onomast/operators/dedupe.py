"""One row per person, by a stated policy.

Consistency is not transitive, so "the same person" needs a policy:

* ``first``: a row stays unless an earlier row (smaller id) is consistent with it;
* ``components``: of each connected component of consistent pairs the smallest id stays.

Equal records are one before any pairing; different records meet in a join on surname
keys, and no block is gathered in one task.  Of its pairs only each record's nearest
one is written.  (A record that is not even
consistent with itself does not link its copies.)  Rows without a name stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.functions.matching import features, kernel_verdict, native_verdict, packed
from onomast.operators.components import components
from onomast.sources.scratch import written


def _records(df: DataFrame, id_col: str, p: str) -> DataFrame:
    """(record, f, first, own) of each different record: its smallest id, and that id
    again if the record is consistent with itself."""
    rows = df.where(F.col(p).isNotNull()).select(F.col(id_col).alias("id"), packed(F.col(p)).alias("record"), features(F.col(p)).alias("f"))
    one = rows.groupBy("record", "f").agg(F.min("id").alias("first"))
    return written(one.withColumn("own", F.when(kernel_verdict(F.col("record"), F.col("record")), F.col("first"))), "records")


def _nearest(records: DataFrame) -> DataFrame:
    """(a, b): for each record with a consistent one of another label, the smallest first
    id of those.  Pairs are summed up where they are found and never written."""
    left = records.select(F.col("first").alias("a"), F.col("record").alias("ra"), F.col("f").alias("fa"), F.col("label").alias("la"))
    right = records.select(F.col("first").alias("b"), F.col("record").alias("rb"), F.col("f").alias("fb"), F.col("label").alias("lb"))
    verdict = native_verdict(F.col("fa"), F.col("fb"))
    on = (F.col("fa")["key"] == F.col("fb")["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
    some = left.join(right, on & F.coalesce(verdict, F.lit(True))).withColumn("verdict", verdict)
    unsure = F.col("verdict").isNull()
    sure = F.coalesce("verdict", kernel_verdict(*(F.when(unsure, F.col(c)) for c in ("ra", "rb"))))
    both = some.where(sure).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    return written(both.groupBy("a").agg(F.min("b").alias("b")), "nearest")


def _roots(records: DataFrame) -> DataFrame:
    """(a, least): the smallest first id of the component of each record that has links.

    Boruvka's rounds: every component takes its records' nearest ones of other components,
    until there are none; consistent pairs of one component are not looked at again.
    """
    stars: DataFrame | None = None
    labelled = records.withColumn("label", F.col("first"))
    while not (links := _nearest(labelled)).isEmpty():
        edges = links if stars is None else links.unionByName(stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
        stars = components(edges)
        roots = stars.select("node", "root")
        labelled = records.join(roots, F.col("first") == F.col("node"), "left").withColumn("label", F.coalesce("root", "first"))
        labelled = written(labelled.select(*records.columns, "label"), "labelled")
    if stars is None:
        return links.select("a", F.col("b").alias("least"))
    roots = stars.select(F.col("node").alias("a"), F.col("root").alias("least"))
    return roots.union(roots.select(F.col("least").alias("a"), "least").distinct())


def dedupe(df: DataFrame, id_col: str, policy: str = "first", p: str = "p") -> DataFrame:
    """The rows of ``df`` that stay under a policy; ids must be unique."""
    if policy not in ("first", "components"):
        raise ValueError(f"unknown policy: {policy}")
    records = _records(df, id_col, p)
    if policy == "first":
        near = _nearest(records.withColumn("label", F.col("first"))).select("a", F.col("b").alias("least"))
    else:
        near = _roots(records)
    bar = records.join(near, F.col("first") == F.col("a"), "left").select("record", F.least("own", "least").alias("bar"))
    bar = bar.withColumnRenamed("record", "__record").withColumnRenamed("bar", "__bar")
    # A row goes if a smaller id stands for it.
    gone = F.coalesce(F.col("__bar") < F.col(id_col), F.lit(False))
    keyed = df.withColumn("__key", packed(F.col(p)))
    return keyed.join(bar, F.col("__key") == F.col("__record"), "left").where(~gone).select(*df.columns)
