"""Benchmark decontamination by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Every window of ``window`` consecutive
words of a benchmark item is a test string; an item of fewer words is one test
string.  Test strings of one length share a :class:`WuManber` table: the block
(two words) that ends the scan window looks up how far the window may move, a
zero shift looks up the suffix bucket, and a direct comparison confirms.

The benchmark is cut into pattern blocks of at most ``block_words`` words of
test strings; each block is one Arrow pass that adds its hits to the row, so a
benchmark of any size is searched whole with bounded memory.  With more than one
block the table is written between passes.

Defined results: null or empty texts and items have no words; an item whose id
is null still marks words but is not listed; items under one id count once;
repeated documents give repeated rows; an empty benchmark hits nothing; other
columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.files import sliced
from onomast.sources.scratch import written

#: Maps A-Z to a-z and every other ASCII byte outside [0-9a-z] to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    """The test strings of an item."""
    if not words:
        return set()
    if len(words) < window:
        return {tuple(words)}
    return {tuple(words[i : i + window]) for i in range(len(words) - window + 1)}


class WuManber:
    """Search for many word strings of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], set[bytes]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                block = p[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(p[length - self.block :], set()).add(p[0])

    def search(self, words: list[bytes]) -> Iterable[tuple[int, tuple[str, ...]]]:
        """(start, item ids) of every occurrence."""
        n, length, far, patterns = len(words), self.length, self.far, self.patterns
        shift, buckets, two = self.shift.get, self.buckets, self.block == 2
        end = length - 1
        while end < n:
            block = (words[end - 1], words[end]) if two else (words[end],)
            skip = shift(block, far)
            if skip:
                end += skip
                continue
            start = end - length + 1
            if words[start] in buckets[block]:
                found = patterns.get(tuple(words[start : end + 1]))
                if found is not None:
                    yield start, found
            end += 1


def build(items: Iterable[tuple[str | None, str | None]], window: int) -> list[WuManber]:
    """One searcher for each length of the items' test strings."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        for w in windows_of(words_of(text), window):
            ids = by_length.setdefault(len(w), {}).setdefault(w, set())
            if item is not None:
                ids.add(item)
    return [WuManber(n, {w: tuple(sorted(ids)) for w, ids in p.items()}) for n, p in sorted(by_length.items())]


def hits(words: list[bytes], searchers: list[WuManber], marks: bytearray, items: set[str]) -> None:
    """Mark the words inside occurrences and collect the items they belong to."""
    for s in searchers:
        done = 0
        for start, found in s.search(words):
            end = start + s.length
            lo = max(start, done)
            if lo < end:
                marks[lo:end] = b"\x01" * (end - lo)
            done = end
            items.update(found)


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Item lists whose test strings hold at most ``block_words`` words each (or one item)."""
    part = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    total = part.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    out, size = [], 0
    # The driver takes one part of some 32 MB at a time; repeated items change nothing.
    for row in part.repartition(1 + total // (32 << 20)).toLocalIterator():
        own = window * max(1, len(words_of(row.t)))
        if out and size + own > block_words:
            yield out
            out, size = [], 0
        out.append((row.i, row.t))
        size += own
    yield out


def _pass(docs: DataFrame, text_at: int, searchers, first: bool) -> DataFrame:
    """Add the hits of one pattern block to ``marks`` and ``items`` (the last two columns)."""
    from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

    schema = docs.schema
    if first:
        schema = StructType([*schema.fields, StructField("marks", BinaryType()), StructField("items", ArrayType(StringType()))])
    names = schema.names
    own = docs.sparkSession.sparkContext.broadcast(searchers)

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(text_at).to_pylist()
            marks_in = [None] * len(texts) if first else batch.column(len(names) - 2).to_pylist()
            items_in = [()] * len(texts) if first else batch.column(len(names) - 1).to_pylist()
            marks_out, items_out = [], []
            for text, m, i in zip(texts, marks_in, items_in, strict=True):
                words = words_of(text)
                marks, items = bytearray(m or bytes(len(words))), set(i or ())
                hits(words, own.value, marks, items)
                marks_out.append(bytes(marks))
                items_out.append(sorted(items))
            kept = batch.columns if first else batch.columns[:-2]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(marks_out, pa.binary()), pa.array(items_out, pa.list_(pa.string()))], names=names
            )

    return docs.mapInArrow(run, schema)


def _plain(docs: DataFrame) -> list[str]:
    return [f"c{k}" for k in range(len(docs.columns))]


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = 4_000_000,
) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... (so that no name clashes), ``marks`` (a byte
    for each word, 1 if hit) and ``items``.

    No shuffle: documents stream past the tables of one pattern block at a time.
    A block is broadcast only under its bound of ``block_words`` words.
    """
    out, at = docs.toDF(*_plain(docs)), docs.columns.index(text_col)
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_words)):
        if k:
            out = written(out, "decontaminate", "all")
        out = _pass(out, at, build(block, window), k == 0)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: n_words, n_hit, the items found and a digest of them."""
    found = search(docs.select(F.col(id_col), F.col(text_col).alias("t")), benchmark, "t", **kw)
    # Two hexadecimal digits a byte; those of unmarked words go.
    n_hit = F.expr("length(regexp_replace(hex(marks), '00|(01)', '$1')) div 2")
    return found.select(
        F.col("c0").alias(id_col),
        F.octet_length("marks").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        "items",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.contains("marks", F.lit(b"\x01")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns of ``docs``."""
    found = search(docs, benchmark, text_col, **kw)
    return found.where(~F.contains("marks", F.lit(b"\x01"))).select(*_plain(docs)).toDF(*docs.columns)
