"""Names made from integer keys.

The tables hold no person names, so queries build a raw text from ingredients that
integer arithmetic picks from word lists, and parse it.  The SQL side never parses:
it states the ingredients as they should come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onomast.functions.names import parse_name

GIVEN = "Alice Daniel Elena George Helena Isaac Julia Kevin Laura Martin Nadia Oscar Paula Quentin Rosa Simon Teresa".split()
MIDDLE = "Maria Louis Irene Victor Olive Edgar Amelia".split()
SURNAME = (
    "Anderson Bennett Carter Dawson Ellison Foster Gardner Hudson Iverson Jenkins Keller Lawson Mercer Norton Osborne Parker "
    "Quinlan Ramirez Sanders Turner Underwood Vaughan Walker Yardley Zimmerman"
).split()
PARTICLED = ["van Dyke", "de la Vega", "von Trapp", "del Rio", "di Marco", "da Costa"]
MAC = ["MacDonald", "McDonald", "MacArthur", "McKenzie", "Macias", "Mackie"]
CREDENTIALS = [("PhD", "Ph.D."), ("MD", "MD"), ("Esq.", "Esq."), ("MBA", "MBA")]
TITLES = [("Dr.", "Dr."), ("Prof", "Prof."), ("Mrs", "Mrs."), ("Captain", "Capt."), ("Senator", "Sen."), ("Sister", "Sr.")]
GENERATIONS = ["Sr.", "Jr.", "III", "IV", "V"]


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


class Picks:
    """``{given}`` and the like in a template, as Spark SQL or as DuckDB SQL."""

    PICKS = {
        "given": (GIVEN, "{k} % {n}"),
        "middle": (MIDDLE, "({k} DIV 7) % {n}"),
        "surname": (SURNAME, "({k} DIV 3) % {n}"),
        "particled": (PARTICLED, "{k} % {n}"),
        "mac": (MAC, "{k} % {n}"),
        "title": ([a for a, _ in TITLES], "{k} % {n}"),
        "titled": ([b for _, b in TITLES], "{k} % {n}"),
        "credential": ([a for a, _ in CREDENTIALS], "{k} % {n}"),
        "credited": ([b for _, b in CREDENTIALS], "{k} % {n}"),
        "generation": (GENERATIONS, "{k} % {n}"),
    }

    @classmethod
    def fill(cls, template: str, key: str, spark: bool) -> str:
        out = template
        for name, (words, index) in cls.PICKS.items():
            at = index.format(k=key, n=len(words))
            if spark:
                text = f"element_at(array({_quoted(words)}), cast({at} as int) + 1)"
            else:
                text = f"([{_quoted(words)}])[1 + ({at.replace('DIV', '//')})]"
            out = out.replace("{" + name + "}", text)
        return out.replace("{k}", key)


def raw_names(spark: SparkSession, sf_dir: str, raw: str, table: str = "customer", key: str = "c_custkey", keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, raw, kept columns) of a table, ``raw`` filled from the template."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(F.col(key).alias("k"), F.expr(Picks.fill(raw, key, True)).alias("raw"), *keep)


def parsed_names(spark: SparkSession, sf_dir: str, raw: str, table: str = "customer", key: str = "c_custkey", keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``raw_names``, with the record ``p``."""
    return raw_names(spark, sf_dir, raw, table, key, keep).withColumn("p", parse_name("raw"))


def sql(template: str, key: str = "c_custkey") -> str:
    return Picks.fill(template, key, False)


def text(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)
