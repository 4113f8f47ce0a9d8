"""SQL names of the functions.

Kernels are registered as Arrow functions.  Accessors become SQL functions, so that
Catalyst inlines them like any expression; ``parse_name`` and ``names_consistent`` are
SQL functions too, that decide plain names natively as the column functions do and
leave the rest to the kernels.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from onomast.functions.matching import PACKED_FIELDS, agree_packed
from onomast.functions.names import NAME_SCHEMA, PARTS, PLAIN, native_sql, parse_batch
from onomast.functions.worker import ready, shared_table

_TYPE = NAME_SCHEMA.simpleString()
_GIVEN = "try_element_at(p.given_words, 1)"
_SURNAME = "array_join(p.surname_words, ' ')"
_FIRST = "substring(p.initials, 1, 1)"
_GENERATION = "try_element_at(array('Sr.', 'Jr.', 'III', 'IV', 'V'), p.generation)"
_FULL = f"if(p.display_name is null, null, concat_ws(', ', p.display_name, {_GENERATION}))"

#: name -> (type, expression over the record ``p``)
ACCESSORS = {
    "name_surname": ("STRING", _SURNAME),
    "name_given": ("STRING", _GIVEN),
    "name_initials": ("STRING", "p.initials"),
    "name_first_initial": ("STRING", _FIRST),
    "name_middle_initials": ("STRING", "nullif(substring(p.initials, 2, 1024), '')"),
    "name_goes_by_middle": ("BOOLEAN", "if(p is null, null, coalesce(try_element_at(p.given_initial_spans, 1).start > 0, false))"),
    "name_middle": ("STRING", "if(size(p.given_words) > 1, array_join(slice(p.given_words, 2, greatest(size(p.given_words) - 1, 1)), ' '), null)"),
    "name_generation": ("STRING", _GENERATION),
    "name_honorific_prefix": ("STRING", "p.honorific_prefix"),
    "name_honorific_suffix": ("STRING", "p.honorific_suffix"),
    "name_display_first_last": ("STRING", f"coalesce(concat({_GIVEN}, ' ', {_SURNAME}), concat({_FIRST}, '. ', {_SURNAME}))"),
    "name_display_initial_surname": ("STRING", f"concat({_FIRST}, '. ', {_SURNAME})"),
    "name_display_full": ("STRING", _FULL),
    "name_display_full_with_honorifics": ("STRING", f"if(p is null, null, concat_ws(' ', p.honorific_prefix, {_FULL}, p.honorific_suffix))"),
    "name_byte_len": ("INT", f"octet_length({_FULL})"),
    "surname_key": ("STRING", "p.surname_key"),
    "surname_hash": ("BIGINT", "xxhash64(p.surname_key)"),
}


_IS_PLAIN, _PLAIN_RECORD = native_sql("t", "parts")
_FEATURES = """named_struct('key', p.surname_key, 'generation', p.generation,
    'surname', if(size(p.surname_words) = 1 AND p.surname_words[0] RLIKE '^[A-Za-z]+$', lower(p.surname_words[0]), null),
    'initial', if(p.initials RLIKE '^[A-Z]$', p.initials, null),
    'name', if(p.initials RLIKE '^[A-Z]$' AND size(p.given_words) = 1 AND p.given_words[0] RLIKE '^[A-Za-z]+$', lower(p.given_words[0]), null),
    'given', size(p.given_words) > 0)"""
_FEATURES_TYPE = "STRUCT<key: STRING, generation: INT, surname: STRING, initial: STRING, name: STRING, given: BOOLEAN>"
_LONE = "(x.initial IS NOT NULL AND y.initial IS NOT NULL AND NOT (x.given AND y.given))"
#: As ``native_verdict``: true or false where features tell, else null.
_VERDICT = f"""CASE WHEN x.key IS NULL OR y.key IS NULL OR x.key <> y.key OR coalesce(x.generation <> y.generation, false) THEN false
    WHEN x.surname <> y.surname THEN false WHEN {_LONE} AND x.initial <> y.initial THEN false
    WHEN x.surname IS NOT NULL AND y.surname IS NOT NULL AND ({_LONE} OR x.name = y.name) THEN true END"""


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL for this session; returns their names."""
    from onomast.operators.tokens import TokenRows  # operators import functions

    shared = shared_table()

    def parse(texts: pa.Array) -> pa.Array:
        ready(shared)
        return parse_batch(texts)

    def agree(left: pa.Array, right: pa.Array) -> pa.Array:
        ready(shared)
        return agree_packed(left, right)

    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        from onomast.kernel.match import given_alike

        ready(shared)
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else given_alike(x, y) for x, y in pairs], pa.bool_())

    def function(name: str, arguments: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

    # Not deterministic, so that no filter on a record runs the kernel again.
    spark.udf.register("name_parse_kernel", F.arrow_udf(parse, NAME_SCHEMA).asNondeterministic())
    spark.udf.register("name_agree_kernel", F.arrow_udf(agree, "boolean"))
    spark.udf.register("names_variants_match", F.arrow_udf(alike, "boolean"))
    function("name_of_parts", "t STRING, parts STRING", _TYPE, f"coalesce(if({_IS_PLAIN}, {_PLAIN_RECORD}, null), name_parse_kernel(if({_IS_PLAIN}, null, t)))")
    function("parse_name", "t STRING", _TYPE, f"name_of_parts(t, regexp_replace(t, r'{PLAIN}', '{PARTS}'))")
    packed = "if({0} IS NULL, null, to_json(named_struct(" + ", ".join(f"'{f}', {{0}}.{f}" for f in PACKED_FIELDS) + ")))"
    function("name_features", f"p {_TYPE}", _FEATURES_TYPE, _FEATURES)
    function("name_verdict", f"x {_FEATURES_TYPE}, y {_FEATURES_TYPE}", "BOOLEAN", _VERDICT)
    native = "name_verdict(name_features(a), name_features(b))"
    unsure = [f"if({native} IS NULL, {packed.format(c)}, null)" for c in ("a", "b")]
    function("names_consistent", f"a {_TYPE}, b {_TYPE}", "BOOLEAN", f"coalesce({native}, name_agree_kernel({', '.join(unsure)}), false)")
    for name, (kind, body) in ACCESSORS.items():
        function(name, f"p {_TYPE}", kind, body)
    spark.udtf.register("tokenize_name", TokenRows)
    return ["parse_name", "names_consistent", "names_variants_match", "tokenize_name", *ACCESSORS]
