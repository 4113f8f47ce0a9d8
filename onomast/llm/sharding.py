"""Sharding by extendible hashing, in DataFrame operations only.

A row's 64-bit hash names its bucket by a prefix: the directory starts with one
bucket, and only buckets above the byte limit split on another bit.  As sizes
only fall with depth, a row's shard is its shortest prefix whose rows fit.  Sizes
are summed per cell of a few bits more than the shards need, prefixes of all
depths are summed from cells, and only cells that are still too large go on to
further bits.

Rows that agree in id and text are told apart by their place in the input, so
copies under one id spread too.  A bucket with a single row above the limit
cannot split and is a shard of its own.

Defined results: null text has 0 bytes; null ids hash by their text; an empty
table gives no shards; other columns are not read (``with_shards`` passes them
on, but a column ``shard`` of the input gives way to the new one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.sources.scratch import written

_MORE = 4
_WIDE = 22


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def _prefix(bits: str | Column, h: Column) -> Column:
    """The first bits of a hash, 0 for none."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (F.lit(64) - bits).cast("int")))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(level, base, depth, prefix, bytes, n_rows) of the shards of ``rows`` (h0, h1,
    bytes).

    Level 0 uses the bits of h0, level 1 those of h1 below one full h0 (``base``).
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    found: DataFrame | None = None
    left, level, fixed = rows.withColumn("base", F.lit(0).cast("long")).withColumn("h", F.col("h0")), 0, 0
    wide = min(_WIDE, max(4, math.ceil(math.log2(max(total / limit, 1))) + _MORE))
    while True:
        deep = min(64, fixed + wide)
        cells = left.groupBy("base", _prefix(deep, F.col("h")).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows"))
        depths = F.explode(F.sequence(F.lit(fixed), F.lit(deep)))
        at = cells.withColumn("depth", depths).withColumn(
            "prefix", F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int"))
        )
        sums = at.groupBy("base", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        sums = written(sums.withColumn("fits", (F.col("bytes") <= limit) | (F.col("n_rows") == 1)), "prefixes")
        # A prefix is a shard if it fits and its parent does not.
        above = sums.where("not fits").selectExpr("base as abase", "depth + 1 as adepth", "prefix as aprefix")
        parent = F.when(F.col("depth") > fixed, F.shiftright("prefix", 1))
        own = sums.where("fits").withColumn("parent", parent)
        match = (F.col("base") == F.col("abase")) & (F.col("depth") == F.col("adepth")) & (F.col("parent") == F.col("aprefix"))
        shards = own.join(above, match, "left_semi").unionByName(own.where(F.col("depth") == fixed) if not fixed else own.limit(0))
        shards = shards.select(F.lit(level).alias("level"), "base", "depth", "prefix", "bytes", "n_rows")
        found = shards if found is None else found.unionByName(shards)
        full = sums.where((F.col("depth") == deep) & ~F.col("fits")).select(F.col("base").alias("fbase"), F.col("prefix").alias("fcell"))
        if full.isEmpty():
            return written(found, "shards")
        on = (F.col("base") == F.col("fbase")) & (_prefix(deep, F.col("h")) == F.col("fcell"))
        left = written(left.join(full, on, "left_semi"), "split")
        fixed = deep
        if deep == 64:
            if level:
                raise ValueError("rows that agree in 128 hash bits do not fit a shard")
            left, level, fixed = left.withColumn("base", F.col("h0")).withColumn("h", F.col("h1")), 1, 0
            more = left.groupBy("base").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
            wide = min(_WIDE, max(4, math.ceil(math.log2(max(more / limit, 1))) + _MORE))
        else:
            wide = 8


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with h0 and h1, written once: a row's place is the same for good."""
    place = F.xxhash64(F.monotonically_increasing_id())
    return docs.withColumn("h0", _hash(id_col, text_col)).withColumn("h1", place)


def _cells(entries: DataFrame, keys: list[str], cut: Column) -> DataFrame:
    """``entries`` (keys, depth, prefix, ...) gathered below the prefix of ``cut`` bits that
    they share.  Hashes are even, so a cell at the depth of the highest entry holds few."""
    cell = F.call_function("shiftrightunsigned", F.col("prefix"), (F.col("depth") - cut).cast("int"))
    cell = F.when(cut == 0, F.lit(0).cast("long")).otherwise(cell)
    own = F.struct(*[c for c in entries.columns if c not in keys])
    return entries.groupBy(*keys, cell.alias("cell")).agg(F.collect_list(own).alias("entries"))


def _entry(h: str) -> Column:
    """The one entry of a cell that is a prefix of ``h``."""
    return F.get(F.filter("entries", lambda e: e["prefix"] == _prefix(e["depth"], F.col(h))), 0)


def _looked_up(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` with ``shard``: one equality join by a cell of h0, and one more by a cell of
    h1 where the directory has shards below a full h0."""
    deep = shards.where("level = 1").select(F.col("base").alias("base"), "depth", "prefix")
    cuts = written(deep.groupBy("base").agg(F.min("depth").alias("cut")), "cuts")
    top = shards.where("level = 0").select("depth", "prefix", F.lit(None).cast("int").alias("cut"))
    top = top.unionByName(cuts.select(F.lit(64).alias("depth"), F.col("base").alias("prefix"), F.col("cut").cast("int").alias("cut")))
    least = top.agg(F.coalesce(F.min("depth"), F.lit(0))).first()[0]
    cells = written(_cells(top, [], F.lit(least)), "cells")
    found = rows.join(cells, _prefix(least, F.col("h0")) == F.col("cell"), "left").withColumn("e0", _entry("h0")).drop("cell", "entries")
    name = F.concat(F.lit("0-"), F.col("e0.depth").cast("string"), F.lit("-"), F.lower(F.hex("e0.prefix")))
    if not cuts.isEmpty():
        below = _cells(deep.join(cuts, "base"), ["base", "cut"], F.col("cut"))
        below = written(below.select("base", F.col("cell").alias("cell"), "entries"), "cells")
        on = (F.col("h0") == F.col("base")) & (_prefix(F.col("e0.cut"), F.col("h1")) == F.col("cell"))
        found = found.join(below, on, "left").withColumn("e1", _entry("h1")).drop("base", "cell", "entries")
        lower = F.concat(F.lit("1-"), F.col("e1.depth").cast("string"), F.lit("-"), F.lower(F.hex("e1.prefix")), F.lit("-"), F.lower(F.hex("h0")))
        name = F.when(F.col("e0.cut").isNull(), name).otherwise(lower)
        return found.withColumn("shard", name).drop("e0", "e1")
    return found.withColumn("shard", name).drop("e0")


def shards_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, directory): id, bytes and shard of every document, without its text."""
    rows = _marked(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", "t")
    rows = written(rows.select("i", "h0", "h1", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("bytes")), "hashed", "all")
    shards = directory(rows, limit)
    return _looked_up(rows, shards).select(F.col("i").alias(id_col), "bytes", "shard"), shards


def invariants(rows: DataFrame, shards: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """One row that says whether a directory is one of extendible hashing: what it holds,
    how many shards of several rows are above the limit, how many pairs of siblings would
    fit one bucket, and how many rows have no shard or shards other sizes than their rows."""
    name = F.concat_ws("-", "level", "depth", F.lower(F.hex("prefix")), F.when(F.col("level") == 1, F.lower(F.hex("base"))))
    pairs = shards.where("depth > 0").groupBy("level", "base", "depth", F.shiftright("prefix", 1).alias("parent"))
    pairs = pairs.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where(f"n = 2 and b <= {limit}")
    held = rows.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    odd = shards.select(name.alias("named"), "bytes", "n_rows").join(held, F.col("named").eqNullSafe(F.col("shard")), "full")
    odd = odd.where(~(F.col("bytes").eqNullSafe(F.col("b")) & F.col("n_rows").eqNullSafe(F.col("n"))))
    counts = [
        rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")),
        shards.agg(F.count_if((F.col("bytes") > limit) & (F.col("n_rows") > 1)).alias("too_large")),
        pairs.agg(F.count("*").alias("split_for_nothing")),
        odd.agg(F.count("*").alias("sizes_differ")),
    ]  # one row each
    out = counts[0].withColumn("one", F.lit(1))
    for c in counts[1:]:
        out = out.join(c.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """``docs`` with the column ``shard``, in the place of one that it may have."""
    columns = docs.columns
    plain = [f"c{k}" for k in range(len(columns))]
    at = {c: plain[k] for k, c in enumerate(columns)}
    marked = written(_marked(docs.toDF(*plain), at[id_col], at[text_col]), "marked", "all")
    shards = directory(marked.select("h0", "h1", F.coalesce(F.octet_length(at[text_col]), F.lit(0)).cast("long").alias("bytes")), limit)
    kept = [c for c in columns if c != "shard"]
    return _looked_up(marked, shards).select(*[F.col(at[c]).alias(c) for c in kept], "shard")
