"""Quality rules with suffix-array repetition.

Counts per text (words are ``[^\\x20\\x09-\\x0D]+``) and the repetition of each
text with itself.  A suffix array over word ids, built by prefix doubling,
gives longest-common-prefix values of neighbours; every suffix that shares at
least ``min_repeat`` words with another one opens a span of that length, and
the union of those spans is what maximal repeated substrings cover.  A text
fails the method when that union covers more than ``max_covered`` of its words
or when the longest repeated substring has more than ``max_longest`` words.

Defined results: null or empty text has no words (all counts 0, fails the word
minimum); null ids are kept; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onomast.llm.files import sliced

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_PLAIN = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_BATCH_WORDS = 200_000


@dataclass(frozen=True)
class QualityRules:
    """min_words and max_repeat_pct are the base rules; the rest is the method's.

    Covered words also count in the base rule's repeated windows, so ``max_covered``
    only says something well below that rule's half: a quarter of the text, every
    occurrence counted.  (A tenth would already reject a short page whose title stands
    at its head and foot.)  A quotation or refrain may come twice; ``max_longest`` is
    the length of a whole paragraph.
    """

    min_words: int = 50
    max_repeat_pct: int = 50
    min_repeat: int = 8
    max_covered: float = 0.25
    max_longest: int = 100


def regroup(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense order-preserving ranks of ``key`` and the size of each entry's group."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.empty(len(key), dtype=bool)
    first[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    group = np.cumsum(first) - 1
    sizes = np.bincount(group)
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = group
    return rank, sizes[rank]


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the sequences that ``ids`` concatenates and the longest
    common prefix of each entry with the next one.

    ``ends[i]`` is the end of the sequence that holds position ``i``; equal ids in
    different sequences must differ.
    """
    n = len(ids)
    at = np.arange(n)
    rank, size = regroup(ids)
    levels, step = [rank], 1
    while n and size.max() > 1:
        tail = np.zeros(n, dtype=np.int64)
        inside = at + step < ends
        tail[inside] = rank[at[inside] + step] + 1
        rank, size = regroup(rank * (n + 1) + tail)
        levels.append(rank)
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = at
    left, right = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, level = 1 << k, levels[k]
        fits = (left + lcp + width <= ends[left]) & (right + lcp + width <= ends[right])
        a, b = left[fits] + lcp[fits], right[fits] + lcp[fits]
        same = level[a] == level[b]
        lcp[np.flatnonzero(fits)[same]] += width
    return order, lcp


def repeat_lengths(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the words its suffix shares with another suffix."""
    order, lcp = suffix_array(ids, ends)
    longest = np.zeros(len(ids), dtype=np.int64)
    if len(lcp):
        np.maximum.at(longest, order[:-1], lcp)
        np.maximum.at(longest, order[1:], lcp)
    return longest


def spans_of(longest: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The union of [i, i + longest[i]) over positions with at least ``least``."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(longest >= least):
        end = int(i + longest[i])
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((int(i), end))
    return out


def _repeated_windows(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int):
    """Positions in 3-word windows found twice in a document, and the documents
    that have a repeat of ``least`` words or might have one."""
    n = len(ids)
    at = np.arange(n)
    hit = np.zeros(n, dtype=bool)
    pair = at[at + 1 < ends]
    if not len(pair):
        return hit, np.zeros(0, dtype=np.int64)
    vocabulary = int(ids.max()) + 1
    key = ids[pair] * vocabulary + ids[pair + 1]
    if (int(doc[-1]) + 1) * vocabulary**2 >= 1 << 63:
        rank, size = regroup(doc[pair] * n + regroup(key)[0])
    else:
        rank, size = regroup(doc[pair] * vocabulary**2 + key)
    two = np.full(n, -1, dtype=np.int64)
    often = size > 1
    two[pair[often]] = rank[often]
    three = pair[often]
    three = three[three + 2 < ends[three]]
    if len(three):
        _, size = regroup(two[three] * vocabulary + ids[three + 2])
        start = three[size > 1]
        hit[start] = hit[start + 1] = hit[start + 2] = True
    width, level, live = 2, two, three
    while width < least and len(live):
        grow = min(width, least - width)
        live = live[live + width + grow <= ends[live]]
        live = live[level[live + grow] >= 0]
        if not len(live):
            break
        rank, size = regroup(level[live] * (n + 1) + level[live + grow])
        level = np.full(n, -1, dtype=np.int64)
        level[live[size > 1]] = rank[size > 1]
        live = live[size > 1]
        width += grow
    return hit, np.unique(doc[live])


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return again


def _batches(texts: list[str | None]) -> Iterator[list[tuple[str, bytes, list[bytes]]]]:
    rows, words = [], 0
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        split = raw.split()
        rows.append((text, raw, split))
        words += len(split)
        if words >= _BATCH_WORDS:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def measure(texts: list[str | None], rules: QualityRules) -> dict[str, list]:
    """The columns of :func:`quality` for a list of texts."""
    out: dict[str, list] = {k: [] for k in SCHEMA_FIELDS}
    for rows in _batches(texts):
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for _, _, s in rows for w in s), dtype=np.int64)
        counts = np.array([len(s) for _, _, s in rows], dtype=np.int64)
        stops = np.cumsum(counts)
        doc = np.repeat(np.arange(len(rows)), counts)
        ends = np.repeat(stops, counts)
        hit, deep = _repeated_windows(ids, doc, ends, rules.min_repeat)
        repeat = np.add.reduceat(np.append(hit, False), np.append(stops - counts, len(hit)))[:-1] if len(rows) else []
        repeat = np.where(counts > 0, repeat, 0)
        spans: dict[int, list[tuple[int, int]]] = {}
        longest: dict[int, int] = {}
        if len(deep):
            pick = np.isin(doc, deep)
            sizes = counts[deep]
            sub_ends = np.repeat(np.cumsum(sizes), sizes)
            shared = repeat_lengths(doc[pick] * len(known) + ids[pick], sub_ends)
            offset = 0
            for d, k in zip(deep.tolist(), sizes.tolist()):
                own = shared[offset : offset + k]
                offset += k
                spans[d], longest[d] = spans_of(own, rules.min_repeat), int(own.max())
        for i, (text, raw, split) in enumerate(rows):
            n, r = len(split), int(repeat[i])
            kept_spans = spans.get(i, [])
            covered = sum(b - a for a, b in kept_spans)
            long = longest.get(i, 0) if kept_spans else 0
            failed = n < rules.min_words or 100 * r > rules.max_repeat_pct * n
            out["n_words"].append(n)
            out["word_chars"].append(len(text) - (len(raw) - len(raw.translate(None, _SPACES))))
            out["n_symbols"].append(len(raw.translate(None, _PLAIN)))
            out["n_dup_lines"].append(_duplicate_lines(text) if "\n" in text else 0)
            out["n_repeat_words"].append(r)
            out["base_failed"].append(failed)
            out["covered_words"].append(covered)
            out["longest_repeat"].append(long)
            out["repeat_spans"].append([{"start": a, "end": b} for a, b in kept_spans])
            out["kept"].append(not failed and covered <= rules.max_covered * n and long <= rules.max_longest)
    return out


SCHEMA_FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
    "repeat_spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "kept": pa.bool_(),
}

_SQL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, repeat_spans array<struct<start:long,end:long>>, kept boolean"
)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: counts, repeat spans (word offsets) and ``kept``.

    Narrow: one Arrow pass over two columns, no shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches):
            cols = measure(batch.column(1).to_pylist(), rules)
            arrays = [batch.column(0), *(pa.array(cols[k], type=t) for k, t in SCHEMA_FIELDS.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *SCHEMA_FIELDS])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {_SQL}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, with the columns of ``docs``.

    Whole rows travel through the Arrow pass, so nothing is joined back.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            kept = measure(batch.column(at).to_pylist(), rules)["kept"]
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
