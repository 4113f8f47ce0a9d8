"""The consistency predicate over two records.

Native expressions decide what they can: block keys, generations, plain surnames,
and names with initials only.  The kernel sees the pairs that remain.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions.names import _col
from onomast.functions.worker import ready, shared_table


class _Record(NamedTuple):
    given_words: list[str]
    surname_words: list[str]
    initials: str
    spans: list[tuple[int, int]]
    generation: int | None
    surname_key: str


PACKED_FIELDS = ("given_words", "surname_words", "initials", "given_initial_spans", "generation", "surname_key")


def _verdicts(left: list, right: list, there: np.ndarray) -> pa.Array:
    """The predicate on pairs of records; null where ``there`` is false."""
    from onomast.kernel.match import consistent

    out = np.zeros(len(there), dtype=bool)
    out[there] = [consistent(x, y) for x, y in zip(left, right, strict=True)]
    return pa.array(out, mask=~there)


def agree_packed(left: pa.StringArray, right: pa.StringArray) -> pa.Array:
    """The predicate on two columns of packed records, null where either is null; each
    distinct record is unpacked once."""
    there = pc.and_(left.is_valid(), right.is_valid()).to_numpy(zero_copy_only=False)
    sides = []
    for side in (left, right):
        coded = side.dictionary_encode()
        known = [_unpacked(text) for text in coded.dictionary.to_pylist()]
        sides.append([known[i] for i in pc.fill_null(coded.indices, 0).to_numpy()[there]])
    return _verdicts(*sides, there)


def packed(p: Column) -> Column:
    """What the kernel needs of a record, as one string (null for no record)."""
    return F.when(p.isNotNull(), F.to_json(F.struct(*[p[f].alias(f) for f in PACKED_FIELDS])))


def _unpacked(text: str) -> _Record:
    r = json.loads(text)
    spans = [(x["start"], x["end"]) for x in r["given_initial_spans"]]
    return _Record(r["given_words"], r["surname_words"], r["initials"], spans, r.get("generation"), r["surname_key"])


def features(p: Column) -> Column:
    """What native expressions compare, worked out once per record: the key, the
    generation, a plain surname, a lone ASCII initial, a plain given name without others,
    and whether a given name is known."""
    words, initials = p["surname_words"], p["initials"]
    plain = F.when((F.size(words) == 1) & words[0].rlike("^[A-Za-z]+$"), F.lower(words[0]))
    return F.struct(
        p["surname_key"].alias("key"),
        p["generation"].alias("generation"),
        plain.alias("surname"),
        F.when(initials.rlike("^[A-Z]$"), initials).alias("initial"),
        F.when(initials.rlike("^[A-Z]$") & (F.size(p["given_words"]) == 1) & p["given_words"][0].rlike("^[A-Za-z]+$"), F.lower(p["given_words"][0])).alias("name"),
        (F.size(p["given_words"]) > 0).alias("given"),
    )


def native_verdict(a: Column, b: Column) -> Column:
    """True or false where the features of two records can tell; null where the kernel must."""
    conflict = F.coalesce(a["generation"] != b["generation"], F.lit(False))
    both_plain = a["surname"].isNotNull() & b["surname"].isNotNull()
    lone = a["initial"].isNotNull() & b["initial"].isNotNull() & ~(a["given"] & b["given"])
    return (
        F.when(a["key"].isNull() | b["key"].isNull() | (a["key"] != b["key"]) | conflict, F.lit(False))
        .when(both_plain & (a["surname"] != b["surname"]), F.lit(False))
        .when(lone & (a["initial"] != b["initial"]), F.lit(False))
        .when(both_plain & (lone | (a["name"] == b["name"])), F.lit(True))
    )


def kernel_verdict(a: Column, b: Column) -> Column:
    """The predicate by the kernel alone, on packed records; null if either side is null."""
    shared = shared_table()

    def kernel(left: pa.Array, right: pa.Array) -> pa.Array:
        ready(shared)
        return agree_packed(left, right)

    return F.arrow_udf(kernel, "boolean")(a, b)


def names_consistent(a: str | Column, b: str | Column) -> Column:
    """Whether two records may be of one person; false if either is null."""
    a, b = _col(a), _col(b)
    native = native_verdict(features(a), features(b))
    left, right = (F.when(native.isNull(), packed(p)) for p in (a, b))
    return F.coalesce(native, kernel_verdict(left, right), F.lit(False))


def names_variants_match(a: str | Column, b: str | Column) -> Column:
    """Whether two given names may be forms of one name."""
    shared = shared_table()

    def kernel(left: pa.Array, right: pa.Array) -> pa.Array:
        from onomast.kernel.match import given_alike

        ready(shared)
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else given_alike(x, y) for x, y in pairs], pa.bool_())

    return F.arrow_udf(kernel, "boolean")(_col(a), _col(b))
