"""``parse_name`` and the accessors of its result.

The parser is one Arrow kernel that returns the whole record.  Plain names (two or
three capitalised ASCII words, a middle initial, sort order) are decided by native
expressions; the kernel gets null for them.  Accessors are native.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.functions.worker import ready, shared_table
from onomast.kernel.tables import GENERATION_FORMS, GENERATION_NAMES, SUFFIXES, SURNAME_PREFIXES, TITLES

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
NAME_SCHEMA = T.StructType(
    [
        T.StructField("given_words", T.ArrayType(T.StringType())),
        T.StructField("surname_words", T.ArrayType(T.StringType())),
        T.StructField("initials", T.StringType()),
        T.StructField("given_initial_spans", T.ArrayType(_SPAN)),
        T.StructField("display_name", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("honorific_prefix", T.StringType()),
        T.StructField("honorific_suffix", T.StringType()),
        T.StructField("surname_key", T.StringType()),
    ]
)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = [
    ("given_words", pa.list_(pa.string())),
    ("surname_words", pa.list_(pa.string())),
    ("initials", pa.string()),
    ("given_initial_spans", _ARROW_SPANS),
    ("display_name", pa.string()),
    ("generation", pa.int32()),
    ("honorific_prefix", pa.string()),
    ("honorific_suffix", pa.string()),
    ("surname_key", pa.string()),
]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_batch(texts: pa.Array) -> pa.Array:
    """The records of a column of texts; equal texts of a batch are parsed once and
    their records are spread over the rows by Arrow."""
    from onomast.kernel.parse import parse

    coded = texts.dictionary_encode()
    known = [parse(t) for t in coded.dictionary.to_pylist()]
    columns = list(zip(*((r if r is not None else (None,) * len(_ARROW)) for r in known), strict=True)) or [()] * len(_ARROW)
    spans = [None if s is None else [{"start": a, "end": b} for a, b in s] for s in columns[3]]
    arrays = [pa.array(spans if k == 3 else columns[k], type=t) for k, (_, t) in enumerate(_ARROW)]
    records = pa.StructArray.from_arrays(arrays, names=[n for n, _ in _ARROW], mask=pa.array([r is None for r in known], pa.bool_()))
    return records.take(coded.indices)


# Plain forms: capitalised ASCII words with a vowel, and single letters that are no
# conjunction (E, Y).  In longer forms a word could be a title, credential or particle.
_WORD = r"(?=[A-Za-z]*[AEIOUYaeiouy])[A-Z][a-z]+"
_LETTER = r"([A-DF-XZ])\.?"
_FORMS = (
    rf"({_WORD}) ({_WORD})",
    rf"({_WORD}) {_LETTER} ({_WORD})",
    rf"((?=[A-Za-z]{{3}}){_WORD}) ({_WORD}) ({_WORD})",
    rf"({_WORD}), ({_WORD})",
    rf"({_WORD}), ({_WORD}) {_LETTER}",
)
PLAIN = f"^(?:{'|'.join(_FORMS)})$"
BETWEEN = "\u0001"
#: given, second given, initial and surname, from whichever form matched
PARTS = BETWEEN.join(("$1$3$6$10$12", "$7", "$4$13", "$2$5$8$9$11"))
NOT_FIRST = sorted(TITLES)
NOT_MIDDLE = sorted(SURNAME_PREFIXES)
NOT_LAST = sorted({*GENERATION_FORMS, *SUFFIXES})


def _among(c: Column, words: list[str]) -> Column:
    """``c.isin(words)``; the words go to the JVM as one string, not in a call for each."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    listed = jvm.java.util.regex.Pattern.compile(BETWEEN).split(BETWEEN.join(words))
    return type(c)(c._jc.isin(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(listed)))


def _natively(text: Column) -> tuple[Column, Column]:
    """(whether a text has a plain form, the record if so).

    One regular expression both tells and takes apart; everything stays in generated code.
    """
    parts = F.regexp_replace(text, F.lit(PLAIN), F.lit(PARTS))
    given, second, letter, last = (F.split_part(parts, F.lit(BETWEEN), F.lit(i)) for i in (1, 2, 3, 4))
    short = (second == "") & (letter == "")
    ordinary = ~_among(given, NOT_FIRST) & ~_among(second, NOT_MIDDLE) & ~_among(last, NOT_LAST)
    plain = (parts != text) & (short | ordinary)
    none = F.lit(None).cast("string")
    first_span = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))
    second_span = F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"))
    record = F.struct(
        F.when(second == "", F.array(given)).otherwise(F.array(given, second)).alias("given_words"),
        F.array(last).alias("surname_words"),
        F.concat(F.substring(given, 1, 1), F.substring(second, 1, 1), letter).alias("initials"),
        F.when(second == "", F.array(first_span)).otherwise(F.array(first_span, second_span)).alias("given_initial_spans"),
        F.concat_ws(" ", given, F.nullif(second, F.lit("")), F.when(letter != "", F.concat(letter, F.lit("."))), last).alias("display_name"),
        F.lit(None).cast("int").alias("generation"),
        none.alias("honorific_prefix"),
        none.alias("honorific_suffix"),
        F.reverse(F.lower(F.right(last, F.lit(4)))).alias("surname_key"),
    )
    return F.coalesce(plain, F.lit(False)), record


def native_sql(t: str, parts: str) -> tuple[str, str]:
    """As ``_natively`` in SQL, over the text ``t`` and its ``parts``."""
    given, second, letter, last = (f"split_part({parts}, '{BETWEEN}', {i})" for i in (1, 2, 3, 4))
    lists = [", ".join('"' + w + '"' for w in words) for words in (NOT_FIRST, NOT_MIDDLE, NOT_LAST)]
    ordinary = f"{given} NOT IN ({lists[0]}) AND {second} NOT IN ({lists[1]}) AND {last} NOT IN ({lists[2]})"
    plain = f"coalesce({parts} <> {t} AND (({second} = '' AND {letter} = '') OR ({ordinary})), false)"
    record = f"""named_struct(
        'given_words', if({second} = '', array({given}), array({given}, {second})),
        'surname_words', array({last}),
        'initials', concat(substring({given}, 1, 1), substring({second}, 1, 1), {letter}),
        'given_initial_spans', if({second} = '', array(named_struct('start', 0, 'end', 1)), array(named_struct('start', 0, 'end', 1), named_struct('start', 1, 'end', 2))),
        'display_name', concat_ws(' ', {given}, nullif({second}, ''), if({letter} <> '', concat({letter}, '.'), null), {last}),
        'generation', cast(null as int), 'honorific_prefix', cast(null as string), 'honorific_suffix', cast(null as string),
        'surname_key', reverse(lower(right({last}, 4))))"""
    return plain, record


def parse_name(text: str | Column, fast: bool = True) -> Column:
    """The record of a free-text name (``NAME_SCHEMA``); null if it is no plausible name."""
    text = _col(text)
    shared = shared_table()

    def kernel(texts: pa.Array) -> pa.Array:
        ready(shared)
        return parse_batch(texts)

    # Called nondeterministic so that a filter on the record is not pushed below it,
    # which would run the kernel or the regular expression again.
    udf = F.arrow_udf(kernel, NAME_SCHEMA).asNondeterministic()
    if not fast:
        return udf(text)
    plain, record = _natively(text)
    return F.coalesce(F.when(plain & (F.rand(0) + 1 > 0), record), udf(F.when(~plain, text)))


# --- accessors ------------------------------------------------------------------------


def first_initial(p: str | Column) -> Column:
    return F.substring(_col(p)["initials"], 1, 1)


def given_name(p: str | Column) -> Column:
    return F.try_element_at(_col(p)["given_words"], F.lit(1))


def goes_by_middle_name(p: str | Column) -> Column:
    p = _col(p)
    starts = F.try_element_at(p["given_initial_spans"], F.lit(1))["start"]
    return F.when(p.isNotNull(), F.coalesce(starts > 0, F.lit(False)))


def middle_names(p: str | Column) -> Column:
    given = _col(p)["given_words"]
    return F.when(F.size(given) > 1, F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(1))))


def middle_name(p: str | Column) -> Column:
    return F.array_join(middle_names(p), " ")


def middle_initials(p: str | Column) -> Column:
    return F.nullif(F.substring(_col(p)["initials"], 2, 1024), F.lit(""))


def surname(p: str | Column) -> Column:
    return F.array_join(_col(p)["surname_words"], " ")


def generational_suffix(p: str | Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, GENERATION_NAMES)), _col(p)["generation"])


def display_initial_surname(p: str | Column) -> Column:
    return F.concat(first_initial(p), F.lit(". "), surname(p))


def display_first_last(p: str | Column) -> Column:
    return F.coalesce(F.concat(given_name(p), F.lit(" "), surname(p)), display_initial_surname(p))


def display_full(p: str | Column) -> Column:
    shown = _col(p)["display_name"]
    return F.when(shown.isNotNull(), F.concat_ws(", ", shown, generational_suffix(p)))


def display_full_with_honorifics(p: str | Column) -> Column:
    p = _col(p)
    return F.when(p.isNotNull(), F.concat_ws(" ", p["honorific_prefix"], display_full(p), p["honorific_suffix"]))


def byte_len(p: str | Column) -> Column:
    return F.octet_length(display_full(p))


def surname_hash(p: str | Column) -> Column:
    """Equal for all names that can be consistent."""
    return F.xxhash64(_col(p)["surname_key"])


def json_record(p: str | Column) -> Column:
    """The record as a JSON object without missing fields; null for no name."""
    c = _col(p)
    fields = F.struct(
        first_initial(c).alias("first_initial"),
        surname(c).alias("surname"),
        given_name(c).alias("given_name"),
        middle_initials(c).alias("middle_initials"),
        middle_name(c).alias("middle_names"),
        generational_suffix(c).alias("generational_suffix"),
        c["honorific_prefix"].alias("honorific_prefix"),
        c["honorific_suffix"].alias("honorific_suffix"),
    )
    return F.when(c.isNotNull(), F.to_json(fields))
