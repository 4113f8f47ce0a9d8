"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of
``shingle`` words; a bit of its fingerprint is set if it is set in over half of the
shingles' hashes (XXH64, seed 42; wider fingerprints mix each hash into more words).

Multi-index hashing cuts fingerprints into segments of 21 or 22 bits, three a word.
Each distinct fingerprint stands once in each segment's table and asks for every value
of the Hamming ball around its own segment; what the table returns is verified on all
bits.  Plans are fixed, the same for any number of rows:

* ``complete_plan``: 64 bits, with radii that add up so that no two fingerprints within
  the distance are missed (distance 4: radii 1, 1 and 0);
* ``WIDE``: 256 bits, twelve segments of radius 2.  Two texts whose sets of shingles have
  similarity 0.8 differ in 0.15 of their bits; a segment finds them with probability 0.36,
  one of the twelve with 0.995 (0.99998 at similarity 0.9; by calculation).  Up to 56 differing bits are
  looked at, three standard deviations above the mean at 0.8, and then their sets of
  shingles are compared: only a Jaccard similarity of ``similarity`` or more links.

A table is cut by the first bits of a segment into parts of some ``block`` entries; a
query goes to the parts that its ball reaches, and only upwards, for a pair is found
from either side.  A part above ``block`` entries or queries is cut into blocks of both,
every block of queries against every block of entries.  Within a part the rest of the
ball is enumerated, candidates are verified in bounded steps, and a task returns a
spanning forest of the links that it verified, never all pairs, which keeps components
exact.  Copies are one fingerprint before any search.

Sets of shingles (32 bits of each hash, sorted) wait in flat files of the shared folder;
a task reads those of the pairs it has to compare, unless the links that it has found
already join the two.

Defined results: null or empty texts have fingerprint 0 and link like others; a
null id counts only if its component has no other; repeated rows are copies; an
empty table gives an empty result; other columns are not read (``one_of_each`` passes
them on).
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm.files import create, opened, sliced
from onomast.operators.components import components
from onomast.sources.scratch import drop, scratch, written

_CHUNK = 255
_PAIRS = 1 << 18
_CACHE = 64 << 20
_BITMAP = 1 << 15


@dataclass(frozen=True)
class Plan:
    """``segments``: (word, shift, bits, radius); a negative radius leaves one out."""

    words: int
    distance: int
    segments: tuple[tuple[int, int, int, int], ...]


def _cuts(words: int, radii: list[int]) -> tuple[tuple[int, int, int, int], ...]:
    thirds = [(w, shift, bits) for w in range(words) for shift, bits in ((0, 21), (21, 21), (42, 22))]
    return tuple((*third, r) for third, r in zip(thirds, radii, strict=True) if r >= 0)


def complete_plan(distance: int) -> Plan:
    """64 bits: of three segments one is within its radius, as (radius + 1) adds up to
    ``distance`` + 1."""
    spare = distance - 2
    return Plan(1, distance, _cuts(1, [spare // 3 + (i < spare % 3) for i in range(3)]))


WIDE = Plan(4, 56, _cuts(4, [2] * 12))


def shingles_of(text: str | None, size: int) -> list[bytes]:
    """The shingles of a text, repeats included; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths)[: len(words) - size + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, stops[size - 1 :].tolist(), strict=True)]


def hashes_of(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of a text."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles_of(text, size), repeat(42))), dtype=">u8").astype("<u8")


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The words of a wide fingerprint come from one hash by splitmix64."""
    z = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The fingerprint, as ``words`` unsigned words: bits set in over half the hashes."""
    counts = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        own = hashes[i : i + _CHUNK]
        lanes = np.stack([own, *(_mixed(own, k) for k in range(1, words))], axis=1) if words > 1 else own
        bits = np.unpackbits(lanes.view(np.uint8).reshape(len(own), 8 * words), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)  # at most 255 of them
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, size: int = 4) -> int:
    """The SimHash of a text, unsigned."""
    return int(majority(hashes_of(text, size))[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id_col, fp): the fingerprint of each row as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def _masks(bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, weight) of a Hamming ball."""
    return [(sum(1 << b for b in flips), k) for k in range(min(radius, bits) + 1) for flips in combinations(range(bits), k)]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (u, v): (node, smallest node)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


class AllNear:
    """Every pair within the distance is a link."""

    def __init__(self):
        self.keep: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, node: np.ndarray, u: np.ndarray, v: np.ndarray, apart: np.ndarray, places: list) -> None:
        self.keep.append((node[u], node[v]))
        self.held += len(u)
        if self.held > 2 * _PAIRS:
            self.keep, self.held = [self.links()], 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keep:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(*(np.concatenate(x) for x in zip(*self.keep, strict=True)))


class Similar:
    """Pairs whose sets of shingles have at least a similarity are links; near pairs come
    first, and pairs that links join already are not compared."""

    def __init__(self, similarity: float, folder: str):
        self.similarity, self.folder = similarity, folder
        self.root: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []
        self.sets: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self.held = 0
        self.files: OrderedDict[int, object] = OrderedDict()

    def _find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def _set(self, place: tuple[int, int, int]) -> np.ndarray:
        file, at, n = place
        if (file, at) in self.sets:
            self.sets.move_to_end((file, at))
            return self.sets[file, at]
        if file not in self.files:
            self.files[file] = opened(f"{self.folder}/{file}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        self.files[file].seek(4 * at)
        own = self.sets[file, at] = np.frombuffer(self.files[file].read(4 * n), dtype="<u4")
        self.held += own.nbytes
        while self.held > _CACHE and len(self.sets) > 1:
            self.held -= self.sets.popitem(last=False)[1].nbytes
        return own

    def _alike(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
        if a[2] > b[2]:
            a, b = b, a
        if a[2] < self.similarity * b[2]:
            return False
        x, y = self._set(a), self._set(b)
        at = np.searchsorted(y, x)
        both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
        return both >= self.similarity * (len(x) + len(y) - both)

    def add(self, node: np.ndarray, u: np.ndarray, v: np.ndarray, apart: np.ndarray, places: list) -> None:
        file, at, n = places
        order = np.argsort(apart, kind="stable")
        for i, j in zip(u[order].tolist(), v[order].tolist(), strict=True):
            a, b = self._find(int(node[i])), self._find(int(node[j]))
            if a != b and self._alike((int(file[i]), int(at[i]), int(n[i])), (int(file[j]), int(at[j]), int(n[j]))):
                self.root[max(a, b)] = min(a, b)
                self.found.append((a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(self.found, dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _part(plan: Plan, outer: list[int], seg: int, role, left, node, fps, places, judge) -> None:
    """All queries of a part against all its entries, in bounded steps."""
    word, shift, bits, radius = plan.segments[seg]
    inner = bits - outer[seg]
    value = ((fps[word] >> np.uint64(shift)) & np.uint64((1 << inner) - 1)).astype(np.int64)
    entries = np.flatnonzero(role & 1)
    if not len(entries):
        return
    entries = entries[np.argsort(value[entries], kind="stable")]
    ordered = value[entries]
    table = None
    if 16 * len(entries) >= 1 << inner:
        table = np.zeros((1 << inner) + 1, dtype=np.int32)
        np.cumsum(np.bincount(ordered, minlength=1 << inner), out=table[1:])

    def compare(queries, lows, counts):
        upto = np.cumsum(counts)
        i = 0
        while i < len(queries):
            base = upto[i] - counts[i]
            j = max(i + 1, int(np.searchsorted(upto, base + _PAIRS, side="right")))
            w = counts[i:j]
            q = np.repeat(queries[i:j], w)
            e = entries[np.repeat(lows[i:j] - (upto[i:j] - w - base), w) + np.arange(len(q))]
            # Two of one part find each other twice.
            once = (node[q] < node[e]) | ((left[q] < radius) & (node[q] != node[e]))
            q, e = q[once], e[once]
            apart = sum(np.bitwise_count(f[q] ^ f[e]).astype(np.int16) for f in fps)
            near = apart <= plan.distance
            if near.any():
                judge.add(node, q[near], e[near], apart[near], places)
            i = j

    asking = np.flatnonzero(role & 2)
    for r in np.unique(left[asking]).tolist():
        queries = asking[left[asking] == r]
        own = value[queries]
        held, size = [], 0
        for mask, _ in _masks(inner, r):
            wanted = own ^ mask
            if table is not None:
                low, high = table[wanted], table[wanted + 1]
            else:
                low, high = np.searchsorted(ordered, wanted, side="left"), np.searchsorted(ordered, wanted, side="right")
            some = np.flatnonzero(high > low)
            if len(some):
                held.append((queries[some], low[some].astype(np.int64), (high[some] - low[some]).astype(np.int64)))
                size += int(held[-1][2].sum())
            if size >= _PAIRS:
                compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            compare(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _search(plan: Plan, outer: list[int], new_judge):
    """Arrow pass over (part, seg, role, left, node, words..., place...) rows sorted by part."""

    def run(batches):
        judge = new_judge()
        held: list[pa.RecordBatch] = []

        def solve():
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                seg, role, left, node = (rows.column(k).to_numpy() for k in (1, 2, 3, 4))
                fps = [rows.column(5 + k).to_numpy().view(np.uint64) for k in range(plan.words)]
                places = [rows.column(k).to_numpy() for k in range(5 + plan.words, rows.num_columns)]
                _part(plan, outer, int(seg[0]), role, left, node, fps, places, judge)
                held.clear()

        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and held[0].column(0)[0].as_py() != part[a]:
                        solve()
                    held.append(batch.slice(a, b - a))
        solve()
        u, v = judge.links()
        for i in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 50_000]), pa.array(v[i : i + 50_000])], names=["a", "b"])

    return run


def links(nodes: DataFrame, plan: Plan, new_judge=AllNear, block: int = 1 << 19) -> DataFrame:
    """(a, b): links that connect the same nodes as all pairs that the plan finds and the
    judge accepts.  ``nodes`` has node (long, no repeats), f0 and further words, and what
    the judge needs of a node."""
    spread = max(12 / len(plan.segments), nodes.count() / block)
    cut = max(0, math.ceil(math.log2(spread)))
    outer = [min(cut, bits - 4) for _, _, bits, _ in plan.segments]
    dealt = []
    for i, (word, shift, bits, radius) in enumerate(plan.segments):
        first = f"(shiftrightunsigned(f{word}, {shift + bits - outer[i]}) & {(1 << outer[i]) - 1}L)"
        ball = ",".join(f"struct({m}L as mask, {k} as k)" for m, k in _masks(outer[i], radius))
        up = f"filter(array({ball}), m -> m.k = 0 or ({first} ^ m.mask) > {first})"
        role = "if(m.k = 0, 3, 2)"
        dealt.append(f"transform({up}, m -> struct({i << 32}L + ({first} ^ m.mask) as part, {i} as seg, {role} as role, {radius} - m.k as left))")
    rows = nodes.select(F.expr(f"inline(flatten(array({','.join(dealt)})))"), *nodes.columns)
    order = ["part", "seg", "role", "left", "node", *[f"f{k}" for k in range(plan.words)]]
    order += [c for c in nodes.columns if c not in order]
    rows = rows.select(order)
    sizes = rows.groupBy("part").agg(F.sum((F.col("role") == 3).cast("long")).alias("e"), F.count("*").alias("q"))
    hot = sizes.where((F.col("e") > block) | (F.col("q") > block))
    hot = written(hot.select(F.col("part").alias("hot"), F.ceil(F.col("e") / block).cast("int").alias("es"), F.ceil(F.col("q") / block).cast("int").alias("qs")), "hot")
    if hot.count():
        # A query goes to one row of blocks, an entry to one column.
        rows = rows.join(hot, F.col("part") == F.col("hot"), "left")
        own = "cast(pmod(xxhash64(node, 'part'), {}) as int)"
        asks = f"transform(sequence(0, es - 1), e -> struct(xxhash64(part, {own.format('qs')}, e) as part, 2 as role))"
        stands = f"transform(sequence(0, qs - 1), q -> struct(xxhash64(part, q, {own.format('es')}) as part, 1 as role))"
        both = f"if(hot is null, array(struct(part, role)), concat({asks}, if(role = 3, {stands}, array())))"
        rows = rows.withColumn("to", F.explode(F.expr(both))).select("to.part", "seg", "to.role", *order[3:])
    rows = rows.repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(_search(plan, outer, new_judge), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the
    smallest id that links reach."""
    return labelled(written(fingerprints(docs, id_col, text_col, shingle), "fingerprints", "slim"), id_col, distance)


def labelled(fps: DataFrame, id_col: str, distance: int) -> DataFrame:
    """``fps`` (id, fp) with component_id."""
    first = written(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    found = components(links(first.select(F.col("fp").alias("node"), F.col("fp").alias("f0")), complete_plan(distance)))
    rooted = first.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = rooted.select(F.col("fp").alias("key"), "root").join(lowest, "root").select("key", "component_id")
    out = fps.join(written(label, "labels"), F.col("fp") == F.col("key"))
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketched(docs: DataFrame, text_at: int, shingle: int, folder: str) -> DataFrame:
    """``docs`` with each row's place (uid), the words of its wide fingerprint, and where in
    ``folder`` its set of shingles is (file, at, n); written once, so that all agree for good."""
    words = [f"f{k}" for k in range(WIDE.words)]
    more = [T.StructField(w, T.LongType()) for w in (*words, "file", "at", "n")]
    placed = docs.withColumn("uid", F.monotonically_increasing_id())

    def run(batches):
        # One file an attempt; only the rows of the attempt that counts name it.
        out, file, end = None, TaskContext.get().taskAttemptId(), 0
        for batch in sliced(batches):
            out = out or create(f"{folder}/{file}")
            fps, at, n = [], [], []
            for text in batch.column(text_at):
                hashes = np.unique(hashes_of(text.as_py(), shingle))
                fps.append(majority(hashes, WIDE.words))
                own = np.unique((hashes >> np.uint64(32)).astype("<u4"))
                out.write(own.tobytes())
                at.append(end)
                n.append(len(own))
                end += len(own)
            new = [*np.ascontiguousarray(np.stack(fps).view(np.int64).T), np.full(len(n), file), np.array(at), np.array(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in new)], names=[*batch.schema.names, *words, "file", "at", "n"])
        if out is not None:
            out.close()

    return written(placed.mapInArrow(run, T.StructType([*placed.schema.fields, *more])), "sketched", "all")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of rows whose sets of shingles
    have at least ``similarity`` the row with the smallest id (null last), and one of
    repeated rows.  Fingerprints that agree in all 256 bits are copies."""
    columns = docs.columns
    plain = [f"c{k}" for k in range(len(columns))]
    folder = scratch(docs.sparkSession, "shingles")
    sketched = _sketched(docs.toDF(*plain), columns.index(text_col), shingle, folder)
    own_id = F.col(plain[columns.index(id_col)])
    words = [f"f{k}" for k in range(WIDE.words)]
    rank = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), "uid", "file", "at", "n")
    first = written(sketched.groupBy(*words).agg(F.min(rank).alias("first")), "distinct")
    nodes = first.select(F.col("first.uid").alias("node"), *words, "first.file", "first.at", "first.n")
    found = components(links(nodes, WIDE, lambda: Similar(similarity, folder)))
    rooted = first.select("first").join(found, F.col("first.uid") == F.col("node"), "left")
    lowest = rooted.groupBy(F.coalesce("root", "first.uid").alias("root")).agg(F.min("first").alias("low"))
    # What stays is a bit a row; the table of bitmaps is broadcast only while it is small.
    bits = lowest.groupBy(F.floor(F.col("low.uid") / _BITMAP).cast("long").alias("block"))
    bits = written(bits.agg(F.bitmap_construct_agg(F.col("low.uid") % _BITMAP).alias("bits")), "kept")
    drop(docs.sparkSession, folder)
    kept = sketched.withColumn("of", F.floor(F.col("uid") / _BITMAP).cast("long")).join(bits, F.col("of") == F.col("block"))
    bit = F.expr(f"shiftright(cast(conv(hex(substring(bits, cast(uid % {_BITMAP} div 8 as int) + 1, 1)), 16, 10) as int), cast(uid % 8 as int)) & 1")
    return kept.where(bit == 1).select(*plain).toDF(*columns)
