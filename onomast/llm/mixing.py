"""Mixing sources to target weights by capped water-filling.

Each source wants ``budget`` x its share of the weights, but no more than
``max_epochs`` x its own size; what a capped source leaves is shared among the
others by weight until none is above its cap.  A document is taken once for each
whole repetition of its source, and the fractional repetition takes documents in
a seeded order until the source's target is met to within half a document.

Source tables stay distributed (one row per source, written to the shared
folder); the driver sees single rows of sums.  The text never moves: sizes and
keys alone are shuffled, salted by hash bucket so that a source that holds most
rows is spread over the cluster.

Defined results: null text has size 0; a null source is a source of its own,
last in order; rows that agree in id and text share one fate; an empty table
gives an empty result; other columns are not read (``mix`` passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.sources.scratch import written

#: The words of a text.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """How many runs of non-space characters a text holds; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ordered_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (key, size) with the repeating weights dealt in key order.

    A range partitioning sorts; ranks come from per-partition counts, so no task
    holds all sources.
    """
    n = len(weights)
    ranged = written(
        sources.repartitionByRange(F.col("key").isNull(), F.col("key")).sortWithinPartitions(F.col("key").isNull(), "key").withColumn("part", F.spark_partition_id()),
        "sources",
    )
    counts = ranged.groupBy("part").count().orderBy("part").collect()  # one row per partition
    offsets, total = {}, 0
    for row in counts:
        offsets[row.part], total = total, total + row["count"]
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map(F.lit(0), F.lit(0))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy(F.col("key").isNull(), "key"))
    dealt = F.array(*map(F.lit, weights))
    rank = in_part - 1 + start[F.col("part")]
    return ranged.select("key", "size", F.element_at(dealt, (rank % n + 1).cast("int")).cast("double").alias("weight"))


def water_fill(sources: DataFrame, budget_ratio: float, max_epochs: float) -> DataFrame:
    """``sources`` (key, size, weight) with ``target``.

    The share of an uncapped source is ``left * weight / weights``; a round caps
    those above ``max_epochs`` x size.  Shares only grow from round to round, so
    the rounds end when no source is newly capped.
    """
    cap = max_epochs * F.col("size")
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    left, weights = budget_ratio * total, None
    while True:
        open_ = F.lit(True) if weights is None else F.lit(left) * F.col("weight") / F.lit(weights) <= cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0.0)).alias("w"),
            F.coalesce(F.sum(F.when(~open_, cap)), F.lit(0.0)).alias("capped"),
        ).first()
        if weights == row.w or not row.w:
            break
        weights, left = row.w, budget_ratio * total - row.capped
    if not weights:
        return sources.withColumn("target", cap)
    share = F.lit(left) * F.col("weight") / F.lit(weights)
    return sources.withColumn("target", F.when(share > cap, cap).otherwise(share))


def _order(id_col: str, text_col: str, seed: str) -> Column:
    """The seeded order of documents: 32 hex digits that depend on id and text alone."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text))


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): key, id, size and order of each document; key, size,
    target, whole repetitions and the last order that the fractional one takes.

    A source's cumulative sizes are summed per hash bucket first; only the one
    bucket in which its target falls is ordered document by document.
    """
    sized = written(
        docs.select(
            F.col(source_col).alias("key"),
            F.col(id_col).alias("id"),
            word_count(text_col).alias("size"),
            _order(id_col, text_col, seed).alias("order"),
        ),
        "sizes",
        "slim",
    )
    sources = ordered_weights(sized.groupBy("key").agg(F.sum("size").alias("size")), weights)
    filled = water_fill(sources, budget_ratio, max_epochs)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    filled = written(filled.withColumn("whole", epochs).withColumn("rest", F.col("target") - epochs * F.col("size")), "targets")

    bucket = F.substring("order", 1, 3)
    sums = sized.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("bsize"))
    upto = F.sum("bsize").over(Window.partitionBy("key").orderBy("bucket"))
    sums = sums.withColumn("before", upto - F.col("bsize"))
    rest = filled.select(F.col("key").alias("skey"), "rest")
    edge = sums.join(rest, F.col("key").eqNullSafe(F.col("skey")))
    edge = edge.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bsize") > F.col("rest")))
    edge = written(edge.select("skey", "bucket", "before", "rest"), "edges")

    inside = sized.join(edge, F.col("key").eqNullSafe(F.col("skey")) & (bucket == F.col("bucket")))
    order = Window.partitionBy("key").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("mid", F.col("before") + F.sum("size").over(order) - F.col("size") / 2.0)
    last = inside.where(F.col("mid") <= F.col("rest")).groupBy(F.col("key").alias("lkey")).agg(F.max("order").alias("last"))
    ends = edge.join(last, F.col("skey").eqNullSafe(F.col("lkey")), "left").select(
        F.col("skey").alias("ekey"), F.coalesce("last", "bucket").alias("last")
    )
    ready = filled.join(ends, F.col("key").eqNullSafe(F.col("ekey")), "left").select(
        F.col("key").alias("source_key"), F.col("size").alias("source_size"), "target", "whole", F.coalesce("last", F.lit("")).alias("last")
    )
    return sized, written(ready, "mix")


def _times(order: Column) -> Column:
    return F.col("whole") + (order <= F.col("last")).cast("long")


def taken(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: id, size, source_size, target and ``taken``, the
    words that the mix takes of it with repetitions."""
    sized, sources = plan(docs, id_col, **kw)
    return sized.join(sources, F.col("key").eqNullSafe(F.col("source_key"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (_times(F.col("order")) * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **kw) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it.

    Joins one row per source to the documents; Spark broadcasts that table only
    while it is below its own threshold.
    """
    _, sources = plan(docs, id_col, text_col, source_col, seed=seed, **kw)
    plain = [f"c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, plain, strict=True))
    times = _times(_order(at[id_col], at[text_col], seed))
    joined = docs.toDF(*plain).join(sources, F.col(at[source_col]).eqNullSafe(F.col("source_key")))
    repeated = joined.select(*plain, F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("copy"))
    return repeated.select(*plain).toDF(*docs.columns)
