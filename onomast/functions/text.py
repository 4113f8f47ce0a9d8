"""Character and word functions on columns: native where Spark has the means, one Arrow
kernel each for decomposition, nicknames, name case and transliteration."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from onomast.functions.names import _col
from onomast.functions.worker import ready, shared_table


def vowelless(word: str | Column) -> Column:
    """No a, e, i, o, u or y."""
    return ~_col(word).rlike("[aeiouyAEIOUY]")


def starts_with_consonant(word: str | Column) -> Column:
    """An ASCII letter that is not a, e, i, o or u comes first; y counts."""
    return _col(word).rlike("^[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]")


def starts_with_uppercase(word: str | Column) -> Column:
    return _col(word).rlike(r"^\p{IsUppercase}")


def adjacent_letters(word: str | Column) -> Column:
    return _col(word).rlike(r"\p{IsAlphabetic}{2}")


def mixed_case(text: str | Column) -> Column:
    return _col(text).rlike(r"\p{IsUppercase}") & _col(text).rlike(r"\p{IsLowercase}")


def letter_count(word: str | Column) -> Column:
    return F.length(F.regexp_replace(_col(word), r"\P{IsAlphabetic}", ""))


def combining_count(word: str | Column) -> Column:
    """Characters of a decomposed word whose combining class is not 0 (which is less than
    category Mn: some vowel signs have class 0)."""

    def kernel(texts: pa.Array) -> pa.Array:
        from onomast.kernel.text import combining

        coded = texts.dictionary_encode()
        known = [None if t is None else sum(map(combining, t)) for t in coded.dictionary.to_pylist()]
        return pa.array(known, pa.int32()).take(coded.indices)

    return F.arrow_udf(kernel, "int")(_col(word))


def folded(text: str | Column) -> Column:
    """The letters of a text in lower case."""
    return F.regexp_replace(F.lower(_col(text)), r"\P{IsAlphabetic}", "")


def prefix_alike(a: str | Column, b: str | Column) -> Column:
    """Whether one folded text begins with the other."""
    a, b = folded(a), folded(b)
    return F.startswith(a, b) | F.startswith(b, a)


def suffix_alike(a: str | Column, b: str | Column) -> Column:
    """Whether one folded text ends with the other."""
    a, b = folded(a), folded(b)
    return F.endswith(a, b) | F.endswith(b, a)


def _mapped(text: str | Column, function: Callable[[str], str | None], letters: bool = False) -> Column:
    """A string function of the kernel, once for each distinct value of a batch."""
    shared = shared_table() if letters else None

    def kernel(texts: pa.Array) -> pa.Array:
        if shared is not None:
            ready(shared)
        coded = texts.dictionary_encode()
        return pa.array(map(function, coded.dictionary.to_pylist()), pa.string()).take(coded.indices)

    return F.arrow_udf(kernel, "string")(_col(text))


def normalised(text: str | Column) -> Column:
    """White space as plain spaces, compatibility decomposition."""
    from onomast.kernel.text import normalised as function

    return _mapped(text, function)


def without_nickname(text: str | Column) -> Column:
    """A normalised text without parenthesised or quoted nicknames."""
    from onomast.kernel.text import normalised, without_nickname

    return _mapped(text, lambda t: without_nickname(normalised(t)))


def capitalised(word: str | Column) -> Column:
    from onomast.kernel.text import capitalised as function

    return _mapped(word, function)


def name_cased(word: str | Column, particle: bool = False) -> Column:
    """A word as names write it; ``particle`` allows lower-case particles."""
    from onomast.kernel.text import name_case

    return _mapped(word, lambda w: name_case(w, particle))


def ascii_letters(text: str | Column) -> Column:
    """The ASCII letters that a text stands for, in lower case; null if there are none."""
    from onomast.kernel.translit import ascii_letters as function

    return _mapped(text, lambda t: function(t) or None, letters=True)


def ascii_initial(text: str | Column) -> Column:
    """The first ASCII letter that a text's first character stands for, in upper case."""
    from onomast.kernel.translit import ascii_initial as function

    return _mapped(text, lambda t: function(t[0]) if t else None, letters=True)
