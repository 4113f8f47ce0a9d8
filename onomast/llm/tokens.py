"""Token counts from flat token files by separator scan.

``write`` tokenises documents into flat files of little-endian 16-bit ids without
any index, each document followed by the end-of-document id.  ``scan`` counts
them without knowing where a document begins: files are cut into blocks of
``block_bytes``, a task searches its block for the separator with one vectorised
comparison, and a prefix scan over the blocks' separator counts and last
separators gives each document its number in the file and the start it had in an
earlier block.  Blocks are independent, so one huge file spreads over the cluster.

Each attempt at a task writes a file of its own, and its rows of the manifest name it;
they are written without a shuffle, so files of lost attempts are named by none and are
not read.  Ids of a vocabulary beyond 16 bits are written with 32.

Defined results: a null or empty text is a document of 0 tokens; tokens after the
last separator of a file are a document of their own; repeated rows are repeated;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast.llm.files import create, dealt, listing, read_range, sliced
from onomast.sources.scratch import drop, made, scratch, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published pre-tokenisation pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
_DTYPE = "<u2"
_encoders: dict[str, object] = {}


def encoder(ranks: dict[bytes, int], key: str):
    """A worker's tokenizer, built once per process."""
    if key not in _encoders:
        import tiktoken

        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END):
    """(folder, manifest, dtype): the token files, which document is which in them
    (id, file, ordinal), and the type of an id.  The vocabulary, some 50,000 entries, is
    broadcast."""
    spark = docs.sparkSession
    folder = made(spark, f"{scratch(spark, 'tokens')}/files")
    known = load_ranks(vocabulary)
    if end in set(known.values()):
        raise ValueError(f"{end} is a token of {vocabulary}")
    dtype = "<u2" if max(end, *known.values()) < 1 << 16 else "<u4"
    ranks = spark.sparkContext.broadcast(known)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        out, name, ordinal = None, "", 0
        for batch in sliced(batches):
            if out is None:
                name = uuid.uuid4().hex
                out, own = create(f"{folder}/{name}.tokens"), encoder(ranks.value, vocabulary)
            for text in batch.column(1):
                ids = own.encode_to_numpy(text.as_py() or "", disallowed_special=())
                out.write(np.append(ids, end).astype(dtype).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n))], names=[id_col, "file", "ordinal"]
            )
            ordinal += n
        if out is not None:
            out.close()

    manifest = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, file string, ordinal long")
    return folder, written(manifest, "token-manifest", "all"), dtype


def _name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*?)([.][^./]*)?$', 1)"


def scan(spark: SparkSession, folder: str, end: int = END, block_bytes: int = 8 << 20, dtype: str = _DTYPE, files: DataFrame | None = None) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the token files of a folder,
    or in those that ``files`` (file) names."""
    width = np.dtype(dtype).itemsize
    step = max(width, block_bytes // width * width)
    found = listing(spark, folder).where("length > 0")
    if files is not None:
        found = found.join(files, F.expr(_name("path")) == F.col("file"), "left_semi")
    found = written(found, "token-files")
    blocks = found.selectExpr("path", "length", f"posexplode(sequence(0L, length - 1, {step}L)) as (block, at)")

    def run(batches):
        for batch in batches:
            for path, length, block, at in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(read_range(path, at, min(step, length - at)), dtype=dtype)
                stops = np.flatnonzero(ids == end) + at // width
                starts = np.append(np.int64(-1), stops[:-1] + 1)[: len(stops)]
                n = len(stops)
                # The block's own row has number -1: its separators, and the last of them.
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * (n + 1), pa.string()),
                        pa.array(np.full(n + 1, block, dtype=np.int32)),
                        pa.array(np.arange(-1, n)),
                        pa.array(np.append(n, starts)),
                        pa.array(np.append(stops[-1] if n else -1, stops)),
                    ],
                    names=["path", "block", "number", "start", "stop"],
                )

    rows = dealt(blocks.select("path", "length", "block", "at")).mapInArrow(run, "path string, block int, number long, start long, stop long")
    rows = written(rows, "separators", "slim")
    over = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.where("number = -1").select(
        F.col("path").alias("bpath"),
        F.col("block").alias("bblock"),
        F.coalesce(F.sum("start").over(over), F.lit(0)).alias("before"),
        F.coalesce(F.max("stop").over(over), F.lit(-1)).alias("last"),
    )
    inner = rows.where("number >= 0").join(carried, (F.col("path") == F.col("bpath")) & (F.col("block") == F.col("bblock")))
    start = F.when(F.col("number") == 0, F.col("last") + 1).otherwise(F.col("start"))
    inner = inner.select("path", (F.col("before") + F.col("number")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))
    ends = rows.where("number = -1").groupBy("path").agg(F.sum("start").alias("ordinal"), (F.max("stop") + 1).alias("start"))
    tails = ends.join(found, "path").select("path", "ordinal", "start", (F.expr(f"length div {width}") - F.col("start")).alias("n_tokens"))
    out = inner.unionByName(tails.where("n_tokens > 0"))
    return out.select(F.expr(_name("path")).alias("file"), "ordinal", "start", "n_tokens")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(id, n_tokens) of every document, by way of token files."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    folder, manifest, dtype = write(docs, "id", "text", **kw)
    found = scan(docs.sparkSession, folder, kw.get("end", END), dtype=dtype, files=manifest.select("file").distinct())
    found = found.select("file", "ordinal", "n_tokens")
    drop(docs.sparkSession, folder)  # the separators have been written
    return manifest.join(found, ["file", "ordinal"], "left").select(F.col("id").alias(id_col), "n_tokens")
