"""Joins of name tables by the consistency predicate.

Equal records of a side are one before any pairing: pairs are of different records, and
rows come back to them by a native join on the record.  Semi and anti joins need no row
of the other side for that, and copies are multiplied only where pairs are asked for.
Rows of a stream stay apart, for gathering them takes state.  Joins told the column of
raw texts parse each different text (once for its record, and again where rows come back
to the record) instead of every row.

Equal surname keys are necessary, so every pairing is an equi-join on the key (spread
by AQE where a key is hot) with native conjuncts in its condition; the kernel runs on
the pairs that natives cannot decide.  Ids must be unique on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.functions.matching import features, kernel_verdict, names_consistent, native_verdict, packed
from onomast.functions.names import parse_name

#: Parts that the left rows of one name are dealt out to where inner and left joins multiply rows.
DEALS = 8


def _rows(df: DataFrame, id_col: str, p: str, tag: str) -> DataFrame:
    """(id, p) of the rows with a name, the record packed."""
    some = df.where(F.col(p).isNotNull())
    return some.select(F.col(id_col).alias(f"{tag}_id"), packed(F.col(p)).alias(f"{tag}_p"))


def _records(df: DataFrame, id_col: str, p: str, tag: str) -> DataFrame:
    """(p, f) of each different record, and its rows' ``__deals`` if they have any; of a
    stream (id, p, f) of each row."""
    some = df.where(F.col(p).isNotNull())
    record = packed(F.col(p)).alias(f"{tag}_p"), features(F.col(p)).alias(f"{tag}_f")
    if df.isStreaming:
        return some.select(F.col(id_col).alias(f"{tag}_id"), *record)
    if "__deals" in df.columns:
        return some.groupBy(*record).agg(F.bit_or("__deals").alias("__deals"))
    return some.select(*record).distinct()


def _members(df: DataFrame, id_col: str, p: str, tag: str) -> DataFrame:
    """``_rows`` to join with pairs of records.  The few pairs make most rows, so they are dealt
    out by record: with a side broadcast they would all be multiplied in one task."""
    return _rows(df, id_col, p, tag).hint("merge")


def _texts(df: DataFrame, text: str) -> DataFrame:
    """(text, p) of each different text, and its rows' ``__deals`` if they have any."""
    some = df.where(F.col(text).isNotNull())
    one = some.groupBy(text).agg(F.bit_or("__deals").alias("__deals")) if "__deals" in df.columns else some.select(text).distinct()
    return one.withColumn("p", parse_name(text))


def candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, p: str = "p") -> DataFrame:
    """Pairs of records of one surname key that no native conjunct rules out: packed records
    (with the id on a side that is a stream) and ``verdict``, true where natives alone are sure."""
    a, b = _records(left, left_id, p, "left"), _records(right, right_id, p, "right")
    on = F.col("left_f")["key"] == F.col("right_f")["key"]
    verdict = native_verdict(F.col("left_f"), F.col("right_f"))
    some = a.join(b, on & F.coalesce(verdict, F.lit(True)))
    return some.withColumn("verdict", verdict).drop("left_f", "right_f")


def _record_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, p: str) -> DataFrame:
    """(left_p, right_p) of all consistent records, with the id on a side that is a stream."""
    some = candidates(left, right, left_id, right_id, p)
    unsure = F.col("verdict").isNull()
    kernel = kernel_verdict(*(F.when(unsure, F.col(c)) for c in ("left_p", "right_p")))
    return some.where(F.coalesce("verdict", kernel)).drop("verdict")


def match_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, p: str = "p", also: Column | None = None) -> DataFrame:
    """(left_id, right_id) of all consistent pairs."""
    pairs = _record_pairs(left, right, left_id, right_id, p)
    for df, id_col, tag in ((left, left_id, "left"), (right, right_id, "right")):
        if not df.isStreaming:
            pairs = pairs.join(_members(df, id_col, p, tag), f"{tag}_p")
    if also is not None:
        pairs = pairs.where(also)
    return pairs.select("left_id", "right_id")


def _matching(left: DataFrame, right: DataFrame, left_id: str, right_id: str, p: str, text: str | None) -> tuple[Column, DataFrame]:
    """(what a left row is found by, ``__found`` of the rows that have a match)."""
    if text is None:
        pairs = _record_pairs(left, right, left_id, right_id, p)
        own, theirs = (F.col(left_id), "left_id") if left.isStreaming else (packed(F.col(p)), "left_p")
        return own, pairs.select(F.col(theirs).alias("__found")).distinct()
    ours, others = _texts(left, text), _texts(right, text)
    own, found = _matching(ours, others, text, text, "p", None)
    return F.col(text), ours.withColumn("__own", own).join(found, F.col("__own") == F.col("__found"), "left_semi").select(F.col(text).alias("__found"))


def _found(left: DataFrame, right: DataFrame, left_id: str, right_id: str, p: str, text: str | None) -> tuple[Column, DataFrame]:
    """(what a left row is found by, (``__found``, ``right_id``, ``__deals``) of all matches)."""
    if text is None:
        pairs = _record_pairs(left, right, left_id, right_id, p)
        own, theirs = (F.col(left_id), "left_id") if left.isStreaming else (packed(F.col(p)), "left_p")
        if not right.isStreaming:
            pairs = pairs.join(_members(right, right_id, p, "right"), "right_p")
        return own, pairs.withColumnRenamed(theirs, "__found")
    ours, others = _texts(left, text), _texts(right, text)
    pairs = _record_pairs(ours, others, text, text, "p").join(_rows(ours, text, "p", "left"), "left_p")
    pairs = pairs.join(_rows(others, text, "p", "right").withColumnRenamed("right_id", "__text"), "right_p")
    rows = right.select(F.col(text).alias("__text"), F.col(right_id).alias("right_id")).hint("merge")
    return F.col(text), pairs.join(rows, "__text").withColumnRenamed("left_id", "__found")


def _dealt(left: DataFrame, right: DataFrame, left_id: str, right_id: str, p: str, text: str | None) -> tuple[DataFrame, DataFrame, Column]:
    """The left rows, the matches, and the condition of their join, in which few bytes make
    many rows: so partitions are not merged by their bytes, and the left rows of one name
    are in several parts, each of which meets all matches of that name."""
    deal = F.pmod(F.xxhash64(left_id), F.lit(DEALS)).cast("int")
    marked = left.withColumn("__deals", F.call_function("shiftleft", F.lit(1), deal))
    own, found = _found(marked, right, left_id, right_id, p, text)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = F.filter(F.sequence(F.lit(0), F.lit(DEALS - 1)), lambda d: F.getbit("__deals", d) == 1)
    found = found.select("__found", "right_id", F.explode(taken).alias("__part")).repartition(parts, "__found", "__part")
    keyed = left.withColumn("__own", own).withColumn("__deal", deal).repartition(parts, "__own", "__deal")
    on = (F.col("__own") == F.col("__found")) & (F.col("__deal") == F.col("__part"))
    return keyed, found.hint("merge"), on


def match_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, how: str = "inner", p: str = "p", text: str | None = None) -> DataFrame:
    """Rows of ``left`` by whether ``right`` has a consistent name.

    inner and left add the column ``right_id``; left_semi and left_anti filter.  With
    ``text``, names are the raw texts of that column of both tables, which need no ``p``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown join type: {how}")
    streaming = left.isStreaming or right.isStreaming
    if text is not None and streaming:
        raise ValueError("texts are gathered first, which a stream cannot do: parse it and join by p")
    if how in ("left_semi", "left_anti"):
        own, found = _matching(left, right, left_id, right_id, p, text)
        keyed, on = left.withColumn("__own", own), F.col("__own") == F.col("__found")
    elif streaming:
        own, found = _found(left, right, left_id, right_id, p, None)
        keyed, on = left.withColumn("__own", own), F.col("__own") == F.col("__found")
        found = found.select("__found", "right_id")
    else:
        keyed, found, on = _dealt(left, right, left_id, right_id, p, text)
    return keyed.join(found, on, how).drop("__own", "__found", "__deal", "__part")


def self_pairs(df: DataFrame, id_col: str, p: str = "p") -> DataFrame:
    """(left_id, right_id) of consistent pairs within one table, smaller id first."""
    return match_pairs(df, df, id_col, id_col, p, F.col("left_id") < F.col("right_id"))


def probe(df: DataFrame, name: str, p: str = "p") -> DataFrame:
    """The rows consistent with one name; raises if that is no name."""
    one = df.sparkSession.range(1).select(parse_name(F.lit(name)).alias("__probe"))
    if one.first()[0] is None:
        raise ValueError(f"not a name: {name!r}")
    on = F.col(p)["surname_key"] == F.col("__probe")["surname_key"]
    some = df.join(F.broadcast(one), on)  # one row
    return some.where(names_consistent(F.col(p), F.col("__probe"))).drop("__probe")
