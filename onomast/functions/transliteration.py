"""Generates the transliteration table from the ICU library that Spark ships.

Characters are fed one by one (a line each), so the table is context-free.  The
result depends on the ICU version alone and is a few hundred kilobytes at most: one
entry per letter of the basic plane that no rule of the kernel covers.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import SparkSession

from onomast.kernel import translit

_tables: dict[int, dict[str, str]] = {}


def _wanted() -> list[str]:
    return [
        c
        for c in map(chr, range(0x80, min(sys.maxunicode, 0xFFFF) + 1))
        if unicodedata.category(c)[0] == "L" and not 0xAC00 <= ord(c) <= 0xD7A3 and translit._by_name(c) is None
    ]


def table(spark: SparkSession) -> dict[str, str]:
    """character -> ASCII letters, made once per application."""
    key = id(spark.sparkContext)
    if key not in _tables:
        letters = _wanted()
        icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII")
        lines = icu.transliterate("\n".join(letters)).split("\n")
        plain = (("".join(x for x in line if x.isascii() and x.isalpha()), c) for c, line in zip(letters, lines, strict=True))
        _tables[key] = {c: line for line, c in plain if line}
    return _tables[key]
