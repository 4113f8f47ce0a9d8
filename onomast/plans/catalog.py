"""The query catalogue: each query and the SQL that states its result."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onomast import functions as N
from onomast.functions import text as T
from onomast.operators import block_sizes, dedupe, match_join, match_pairs, name_tokens, parse_stats, probe, surname_frequency
from onomast.plans.ingredients import parsed_names, raw_names, sql
from onomast.sources import matches_as_lines, read_lines, records_as_lines
from onomast.sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_FULL = "{given} || ' ' || {surname}"


def _query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- parsing by format: ingredients come out as they went in -----------------------------

_COLUMNS = {
    "given_name": N.given_name,
    "middle_names": N.middle_name,
    "middle_initials": N.middle_initials,
    "surname": N.surname,
    "suffix": N.generational_suffix,
    "display": N.display_full,
}


def _format(name: str, raw: str, **expected: str) -> None:
    """A query that parses ``raw`` for every customer; expected columns as SQL."""
    want = {"given_name": "{given}", "middle_names": "NULL", "middle_initials": "NULL", "surname": "{surname}", "suffix": "NULL"} | expected
    if "display" not in want:
        want["display"] = f"{want['given_name']} || ' ' || {want['surname']}"
    columns = ", ".join(f"CAST({sql(e)} AS VARCHAR) AS {c}" for c, e in want.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsed_names(spark, sf_dir, raw)
        return rows.select("k", *[f("p").alias(c) for c, f in _COLUMNS.items()])

    _query(name, f"SELECT c_custkey AS k, {columns} FROM customer")(run)


_MID = {"middle_names": "{middle}", "middle_initials": "substr({middle}, 1, 1)", "display": "{given} || ' ' || {middle} || ' ' || {surname}"}
_INI = {"middle_initials": "substr({middle}, 1, 1)", "display": "{given} || ' ' || substr({middle}, 1, 1) || '. ' || {surname}"}
_SUF = {"suffix": "{generation}", "display": "{given} || ' ' || {surname} || ', ' || {generation}"}

_format("parse_first_last", _FULL)
_format("parse_sort_order", "{surname} || ', ' || {given}")
_format("parse_middle_initial", "{given} || ' ' || substr({middle}, 1, 1) || '. ' || {surname}", **_INI)
_format("parse_sort_middle_initial", "{surname} || ', ' || {given} || ' ' || substr({middle}, 1, 1)", **_INI)
_format("parse_full_middle", "{given} || ' ' || {middle} || ' ' || {surname}", **_MID)
_format(
    "parse_generation_all_positions",
    "CASE {k} % 3 WHEN 0 THEN {given} || ' ' || {surname} || ' ' || {generation} "
    "WHEN 1 THEN {given} || ' ' || {surname} || ', ' || {generation} ELSE {surname} || ', ' || {given} || ', ' || {generation} END",
    **_SUF,
)
_format("parse_nickname_parens", "{given} || ' (Ace) ' || {surname}")
_format("parse_nickname_quotes", "{given} || ' \"Ace\" ' || {surname}")
_format("parse_nickname_angle", "{given} || ' <Ace of Spades> ' || {surname}")
_format("parse_all_caps", "upper({given} || ' ' || {middle} || ' ' || {surname})", **_MID)
_format("parse_lower", "lower({given} || ' ' || {middle} || ' ' || {surname})", **_MID)
_format("parse_mac_mc", "upper({given} || ' ' || {mac})", surname="{mac}")
_format("parse_particles", "{given} || ' ' || {particled}", surname="{particled}")
_format("parse_particles_caps", "upper({given} || ' ' || {particled})", surname="{particled}")
_format("parse_conjunctions", "{given} || ' ' || {surname} || ' y Garza'", surname="{surname} || ' y Garza'")
_format(
    "parse_initials_only",
    "substr({given}, 1, 1) || '. ' || substr({middle}, 1, 1) || '. ' || {surname}",
    given_name="NULL",
    middle_initials="substr({middle}, 1, 1)",
    display="substr({given}, 1, 1) || '. ' || substr({middle}, 1, 1) || '. ' || {surname}",
)
_format("parse_hyphenated", "{given} || ' ' || {surname} || '-Nolan'", surname="{surname} || '-Nolan'")
_format("parse_spaces", "'  ' || {given} || '   ' || {surname} || ' '")
_format("parse_compound", "{given} || ' ' || {surname} || ', Mr.'")


def _honorifics(name: str, raw: str, prefix: str, suffix: str, shown: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = F.col("p")
        return parsed_names(spark, sf_dir, raw).select(
            "k",
            p["honorific_prefix"].alias("prefix"),
            p["honorific_suffix"].alias("suffix"),
            N.display_full_with_honorifics("p").alias("display"),
        )

    columns = ", ".join(f"CAST({sql(e)} AS VARCHAR) AS {c}" for c, e in (("prefix", prefix), ("suffix", suffix), ("display", shown)))
    _query(name, f"SELECT c_custkey AS k, {columns} FROM customer")(run)


_honorifics("parse_honorific_prefix", "{title} || ' ' || {given} || ' ' || {surname}", "{titled}", "NULL", "{titled} || ' ' || {given} || ' ' || {surname}")
_honorifics(
    "parse_honorific_suffix", "{given} || ' ' || {surname} || ', ' || {credential}", "NULL", "{credited}", "{given} || ' ' || {surname} || ' ' || {credited}"
)
_honorifics(
    "parse_honorific_both",
    "{title} || ' ' || {given} || ' ' || {surname} || ', ' || {credential}",
    "{titled}",
    "{credited}",
    "{titled} || ' ' || {given} || ' ' || {surname} || ' ' || {credited}",
)


# --- displays and other accessors ----------------------------------------------------------

_DISPLAY = "CASE {k} % 2 WHEN 0 THEN substr({given}, 1, 1) || '. ' || {middle} || ' ' || {surname} ELSE {given} || ' ' || {surname} END"


@_query(
    "display_forms",
    sql(
        "SELECT c_custkey AS k, substr({given}, 1, 1) || '. ' || {surname} AS initial_surname, "
        "CASE {k} % 2 WHEN 0 THEN {middle} ELSE {given} END || ' ' || {surname} AS first_last, " + _DISPLAY + " AS full_name, "
        "CAST(strlen(" + _DISPLAY + ") AS INTEGER) AS bytes, {k} % 2 = 0 AS by_middle FROM customer"
    ),
)
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_names(spark, sf_dir, _DISPLAY)
    return rows.select(
        "k",
        N.display_initial_surname("p").alias("initial_surname"),
        N.display_first_last("p").alias("first_last"),
        N.display_full("p").alias("full_name"),
        N.byte_len("p").alias("bytes"),
        N.goes_by_middle_name("p").alias("by_middle"),
    )


@_query(
    "json_lines",
    sql(
        "SELECT CASE {k} % 5 WHEN 0 THEN '' ELSE '{\"first_initial\":\"' || substr({given}, 1, 1) || '\",\"surname\":\"' || {surname} || "
        "'\",\"given_name\":\"' || {given} || '\",\"generational_suffix\":\"' || {generation} || '\"}' END AS value FROM customer"
    ),
)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE {k} % 5 WHEN 0 THEN {given} ELSE {given} || ' ' || {surname} || ' ' || {generation} END"
    return records_as_lines(parsed_names(spark, sf_dir, raw))


@_query("parse_accents", sql("SELECT c_custkey AS k, 'Jose' AS plain_given, 'Nunez' AS plain_surname, 'zenu' AS surname_key, CAST(16 AS INTEGER) AS bytes FROM customer"))
def parse_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed letters come out decomposed: marks are characters of their own."""
    rows = parsed_names(spark, sf_dir, "'José Núñez' || repeat(' ', cast({k} % 3 as int))")
    bare = lambda c: F.regexp_replace(c, r"\p{Mn}", "")
    return rows.select("k", bare(N.given_name("p")).alias("plain_given"), bare(N.surname("p")).alias("plain_surname"), F.col("p")["surname_key"].alias("surname_key"), N.byte_len("p").alias("bytes"))


# --- parsing as it fails -------------------------------------------------------------------

_JUNK = "CASE {k} % 4 WHEN 0 THEN {given} || ' ' || {surname} WHEN 1 THEN {given} WHEN 2 THEN '12 ' || {k} ELSE 'x y z' END"


@_query("unparseable_rate", "SELECT c_custkey % 4 AS fmt, count(*) FILTER (c_custkey % 4 = 0) AS valid, count(*) FILTER (c_custkey % 4 <> 0) AS invalid FROM customer GROUP BY 1")
def unparseable_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_names(spark, sf_dir, _JUNK).withColumn("fmt", F.col("k") % 4)
    return parse_stats(rows, "fmt")


@_query("customer_code_reject", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS names FROM customer")
def customer_code_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(N.parse_name("c_name").alias("p"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNotNull()).alias("names"))


@_query(
    "region_names_parse",
    "SELECT r_name, CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle' END AS given_name, CASE r_name WHEN 'MIDDLE EAST' THEN 'East' END AS surname FROM region",
)
def region_names_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("p", N.parse_name("r_name"))
    return rows.select("r_name", N.given_name("p").alias("given_name"), N.surname("p").alias("surname"))


@_query(
    "priority_parse",
    "SELECT o_orderpriority AS priority, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' END AS display, count(*) AS n FROM orders GROUP BY 1, 2",
)
def priority_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return rows.withColumn("p", N.parse_name("priority")).select("priority", N.display_full("p").alias("display"), "n")


@_query("long_lines_reject", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE strlen(line) >= 1024")
def long_lines_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 1024 bytes are no names, whatever they hold."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.where(F.octet_length("line") >= 1024).withColumn("p", N.parse_name("line"))
    return rows.agg(F.count_if(F.col("p").isNull()).alias("n"))


_LINES_OF = "SELECT unnest(string_split(text, chr(10))) AS line FROM {0}"


@_query(
    "documents_junk_parse",
    "SELECT count(*) AS n_lines, CAST(0 AS BIGINT) AS too_long_names, CAST(0 AS BIGINT) AS names_without_surname, CAST(0 AS BIGINT) AS names_without_letters "
    f"FROM ({_LINES_OF.format('documents')} UNION ALL {_LINES_OF.format('conversations')})",
)
def documents_junk_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any line of prose may be parsed without error, and what is taken for a name keeps to
    the rules for names."""
    texts = [spark.read.parquet(f"{sf_dir}/{table}.parquet").select("text") for table in ("documents", "conversations")]
    lines = texts[0].unionByName(texts[1]).select(F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.withColumn("p", N.parse_name("line")).select("line", F.col("p").isNotNull().alias("name"), N.surname("p").alias("surname"))
    return rows.agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("name") & (F.octet_length("line") >= 1024)).alias("too_long_names"),
        F.count_if(F.col("name") & (F.coalesce("surname", F.lit("")) == "")).alias("names_without_surname"),
        F.count_if(F.col("name") & ~F.col("line").rlike(r"\p{IsAlphabetic}")).alias("names_without_letters"),
    )


_TOKEN_TEXT = "{title} || ' ' || {given} || ' ' || {particled} || ' Jr.'"
_TOKEN_SQL = sql(
    "SELECT k, CAST(i AS INTEGER) AS \"at\", words[i + 1] AS word, "
    "CASE words[i + 1] WHEN 'Dr.' THEN 'abbreviation' WHEN 'Jr.' THEN 'abbreviation' WHEN 'Mrs' THEN 'initials' ELSE 'name' END AS kind "
    "FROM (SELECT k, words, unnest(range(len(words))) AS i FROM (SELECT c_custkey AS k, string_split(" + _TOKEN_TEXT + ", ' ') AS words FROM customer))"
)


@_query("tokenize_debug", _TOKEN_SQL)
def tokenize_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_names(spark, sf_dir, _TOKEN_TEXT)
    return rows.select("k", F.posexplode(name_tokens("raw")).alias("at", "t")).select("k", "at", "t.word", "t.kind")


@_query("tokenize_sql", _TOKEN_SQL)
def tokenize_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens by the table function."""
    N.register(spark)
    raw_names(spark, sf_dir, _TOKEN_TEXT).createOrReplaceTempView("onomast_tokens")
    return spark.sql("SELECT k, t.at, t.word, t.kind FROM onomast_tokens, LATERAL tokenize_name(raw) AS t")


# --- natural columns -------------------------------------------------------------------------

_CAP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_PG, _PS = _CAP.format("split_part(p_name, ' ', 1)"), _CAP.format("split_part(p_name, ' ', 2)")


@_query("parse_part_names", f"SELECT p_partkey AS k, {_PG} AS given_name, {_PS} AS surname, upper(substr(p_name, 1, 1)) AS first_initial FROM part")
def parse_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p", N.parse_name("p_name"))
    return rows.select(F.col("p_partkey").alias("k"), N.given_name("p").alias("given_name"), N.surname("p").alias("surname"), N.first_initial("p").alias("first_initial"))


@_query("part_surname_topk", f"SELECT {_PS} AS surname, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, surname LIMIT 3")
def part_surname_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surname_frequency(spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p", N.parse_name("p_name")), 3)


# --- aggregates -------------------------------------------------------------------------------

_MANY = (
    "CASE {k} % 4 WHEN 0 THEN {given} || ' ' || {surname} WHEN 1 THEN {surname} || ', ' || {given} "
    "WHEN 2 THEN 'Dr. ' || {given} || ' ' || {middle} || ' ' || {surname} ELSE upper({given} || ' ' || {surname} || ' III') END"
)


@_query("surname_topk", sql("SELECT {surname} AS surname, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, surname LIMIT 10"))
def surname_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surname_frequency(parsed_names(spark, sf_dir, _MANY), 10)


@_query("surname_key_hist", sql("SELECT reverse(right(lower({surname}), 4)) AS surname_key, count(*) AS n FROM customer GROUP BY 1"))
def surname_key_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_sizes(parsed_names(spark, sf_dir, _MANY))


@_query(
    "orders_value_by_surname",
    sql("SELECT {surname} AS surname, count(*) AS n, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
)
def orders_value_by_surname(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parsed_names(spark, sf_dir, _MANY).select("k", N.surname("p").alias("surname"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice")
    joined = names.join(orders, F.col("k") == F.col("o_custkey"))
    return joined.groupBy("surname").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total"))


@_query("customers_by_nation_surname", sql("SELECT n_name AS nation, {surname} AS surname, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"))
def customers_by_nation_surname(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parsed_names(spark, sf_dir, _MANY, keep=("c_nationkey",))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("nation"))
    joined = names.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("nation", N.surname("p").alias("surname")).agg(F.count("*").alias("n"))


@_query(
    "rank_surnames_in_nation",
    sql(
        "SELECT nation, surname, n, rank FROM (SELECT c_nationkey AS nation, {surname} AS surname, count(*) AS n, "
        "CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, {surname}) AS INTEGER) AS rank FROM customer GROUP BY 1, 2) WHERE rank <= 3"
    ),
)
def rank_surnames_in_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parsed_names(spark, sf_dir, _MANY, keep=("c_nationkey",))
    counted = names.groupBy(F.col("c_nationkey").alias("nation"), N.surname("p").alias("surname")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("nation").orderBy(F.desc("n"), "surname")
    return counted.withColumn("rank", F.row_number().over(order)).where("rank <= 3")


@_query(
    "rollup_format_generation",
    sql("SELECT fmt, suffix, count(*) AS n FROM (SELECT CAST(c_custkey % 4 AS VARCHAR) AS fmt, CASE c_custkey % 4 WHEN 3 THEN 'III' END AS suffix FROM customer) GROUP BY ROLLUP (fmt, suffix)"),
)
def rollup_format_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parsed_names(spark, sf_dir, _MANY).select((F.col("k") % 4).cast("string").alias("fmt"), N.generational_suffix("p").alias("suffix"))
    return names.rollup("fmt", "suffix").agg(F.count("*").alias("n"))


@_query("distinct_display_intersect", sql("SELECT DISTINCT {given} || ' ' || {surname} AS display FROM customer INTERSECT SELECT DISTINCT ") + sql("{given} || ' ' || {surname} FROM supplier", "s_suppkey"))
def distinct_display_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = parsed_names(spark, sf_dir, _FULL).select(N.display_full("p").alias("display"))
    theirs = parsed_names(spark, sf_dir, "{surname} || ', ' || {given}", "supplier", "s_suppkey").select(N.display_full("p").alias("display"))
    return ours.intersect(theirs)


@_query(
    "events_by_user_name_window",
    sql("SELECT strftime(ts, '%Y-%m-%d') AS day, {surname} AS surname, count(*) AS n FROM events GROUP BY 1, 2", "user_id"),
)
def events_by_user_name_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = parsed_names(spark, sf_dir, _FULL, "events", "user_id", keep=("ts",))
    windowed = names.groupBy(F.window("ts", "1 day"), N.surname("p").alias("surname")).agg(F.count("*").alias("n"))
    return windowed.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "surname", "n")


# --- matching ---------------------------------------------------------------------------------

#: Suppliers go by initials that not all customers' given names have.
_INITIAL = "substr({middle}, 1, 1) || '. ' || {surname}"
_GIVEN_SUP, _SURNAME_SUP = sql("{middle}", "s_suppkey"), sql("{surname}", "s_suppkey")
_SUPPLIERS = f"(SELECT s_suppkey, {_GIVEN_SUP} AS sg, {_SURNAME_SUP} AS ss FROM supplier)"
_CUSTOMERS = f"(SELECT c_custkey, {sql('{given}')} AS cg, {sql('{surname}')} AS cs FROM customer)"
_SAME = "ss = cs AND substr(sg, 1, 1) = substr(cg, 1, 1)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parsed_names(spark, sf_dir, _INITIAL, "supplier", "s_suppkey"), parsed_names(spark, sf_dir, _FULL)


def _raw_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return raw_names(spark, sf_dir, _INITIAL, "supplier", "s_suppkey"), raw_names(spark, sf_dir, _FULL)


@_query("consistent_pairs_initial_vs_full", f"SELECT s_suppkey AS left_id, c_custkey AS right_id FROM {_SUPPLIERS} JOIN {_CUSTOMERS} ON {_SAME}")
def consistent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = _sides(spark, sf_dir)
    return match_pairs(suppliers, customers, "k", "k")


@_query("semi_match", f"SELECT s_suppkey AS k FROM {_SUPPLIERS} WHERE EXISTS (SELECT 1 FROM {_CUSTOMERS} WHERE {_SAME})")
def semi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = _raw_sides(spark, sf_dir)
    return match_join(suppliers, customers, "k", "k", "left_semi", text="raw").select("k")


@_query("anti_match", f"SELECT s_suppkey AS k FROM {_SUPPLIERS} WHERE NOT EXISTS (SELECT 1 FROM {_CUSTOMERS} WHERE {_SAME})")
def anti_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = _sides(spark, sf_dir)
    return match_join(suppliers, customers, "k", "k", "left_anti").select("k")


@_query("left_match", f"SELECT s_suppkey AS k, CAST(c_custkey AS VARCHAR) AS right_id FROM {_SUPPLIERS} LEFT JOIN {_CUSTOMERS} ON {_SAME}")
def left_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = _raw_sides(spark, sf_dir)
    return match_join(suppliers, customers.withColumn("k", F.col("k").cast("string")), "k", "k", "left", text="raw").select("k", "right_id")


@_query("probe_match", sql("SELECT c_custkey AS k FROM customer WHERE {surname} = 'Hudson' AND {given} = 'Julia'"))
def probe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe(parsed_names(spark, sf_dir, _MANY), "HUDSON, Julia").select("k")


@_query("candidate_pairs", f"SELECT count(*) AS n FROM {_SUPPLIERS} JOIN {_CUSTOMERS} ON right(ss, 4) = right(cs, 4)")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, customers = (block_sizes(x) for x in _sides(spark, sf_dir))
    both = suppliers.join(customers.withColumnRenamed("n", "m"), "surname_key")
    return both.agg(F.sum(F.col("n") * F.col("m")).alias("n"))


@_query(
    "consistent_suffix_conflict",
    sql("SELECT c_custkey AS k, c_custkey % 3 = 0 OR c_custkey % 5 = 2 AS same FROM customer"),
)
def consistent_suffix_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation conflicts only with another one."""
    rows = raw_names(spark, sf_dir, "{given} || ' ' || {surname} || CASE {k} % 3 WHEN 0 THEN '' ELSE ' ' || {generation} END")
    other = raw_names(spark, sf_dir, "{given} || ' ' || {surname} || ' III'").select("k", F.col("raw").alias("third"))
    both = rows.join(other, "k").select("k", N.parse_name("raw").alias("a"), N.parse_name("third").alias("b"))
    return both.select("k", N.names_consistent("a", "b").alias("same"))


@_query("surname_compound_match", sql("SELECT c_custkey AS k, c_custkey % 2 = 0 AS same FROM customer"))
def surname_compound_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surname agrees with one that ends in all of it, as words."""
    rows = raw_names(spark, sf_dir, "{given} || ' de ' || {surname} || CASE {k} % 2 WHEN 0 THEN '-Nolan' ELSE '-Nylan' END")
    rows = rows.withColumn("short", F.concat(F.split("raw", " ")[0], F.lit(" Nolan")))
    both = rows.select("k", N.parse_name("raw").alias("a"), N.parse_name("short").alias("b"))
    return both.select("k", N.names_consistent("a", "b").alias("same"))


#: Facts about names in English use.
_NICKNAMES = [
    *[(a, b, True) for a, b in (x.split() for x in (
        "Peggy Margaret", "Bill William", "Ted Theodore", "Kate Katherine", "Jack John", "Hank Henry", "Chuck Charles", "Gus Augustus",
        "Nell Eleanor", "Larry Lawrence", "Fritz Friedrich", "Phil Philippa", "Josie Josephine", "Tommy Thomas", "Bella Isabella"))],
    *[(a, b, False) for a, b in (x.split() for x in (
        "Peggy Kate", "Bill Ted", "Jack James", "Hank Harriet", "Peter Paula", "Nell Nora", "Hugo Ruth"))],
]


@_query("nickname_pairs", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(v).lower()})" for a, b, v in _NICKNAMES) + ") AS t(a, b, same)")
def nickname_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(a, b) for a, b, _ in _NICKNAMES], "a string, b string")
    return rows.withColumn("same", N.names_variants_match("a", "b"))


#: raw, given, middle, surname, suffix, prefix, credentials: written for this catalogue.
_SAMPLES = [
    ("Dr. Elena Maria Fuentes, PhD", "Elena", "Maria", "Fuentes", None, "Dr.", "Ph.D."),
    ("OKAFOR, CHIDI T., JR", "Chidi", None, "Okafor", "Jr.", None, None),
    ("ludwig van beethoven", "Ludwig", None, "van Beethoven", None, None, None),
    ("Prof. Dr. Anna Keller", "Anna", None, "Keller", None, "Prof. Dr.", None),
    ("mary o'brien", "Mary", None, "O'Brien", None, None, None),
    ("Rear Admiral Grace Hopper", "Grace", None, "Hopper", None, "Rear Adm.", None),
    ("Luis Ortega y Gasset", "Luis", None, "Ortega y Gasset", None, None, None),
    ("W. E. B. Bonner", None, None, "Bonner", None, None, None),
    ("Smith-Jones, Sarah-Jane", "Sarah-Jane", None, "Smith-Jones", None, None, None),
    ("Robert \"Bob\" Parr III", "Robert", None, "Parr", "III", None, None),
    ("JOHN MCALLISTER", "John", None, "McAllister", None, None, None),
    ("Hon. Ruth Adler, Esq.", "Ruth", None, "Adler", None, "Hon.", "Esq."),
]


def _literal(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


@_query("golden_parse", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in _SAMPLES) + ") AS t(raw, given_name, middle_names, surname, suffix, prefix, credentials)")
def golden_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r[0],) for r in _SAMPLES], "raw string").withColumn("p", N.parse_name("raw"))
    return rows.select(
        "raw", N.given_name("p").alias("given_name"), N.middle_name("p").alias("middle_names"), N.surname("p").alias("surname"),
        N.generational_suffix("p").alias("suffix"), F.col("p")["honorific_prefix"].alias("prefix"), F.col("p")["honorific_suffix"].alias("credentials"),
    )


_PAIRS = [
    ("Jane Q. Doe", "Jane Doe", True), ("Jane Q. Doe", "J. Doe", True), ("Jane Q. Doe", "Jane R. Doe", False),
    ("Jane Doe", "John Doe", False), ("Jane Doe Jr.", "Jane Doe III", False), ("Bill Hewlett", "William Hewlett", True),
    ("Juan de la Cruz", "Juan Cruz", True), ("Ana Li", "Ana Lu", False), ("Hans-Peter Fischer", "Hans Fischer", True),
    ("郑和", "Zheng He", True), ("João Silva", "Joao Silva", True), ("A. Bell", "Bea Bell", False),
]


@_query("golden_pairs", "SELECT * FROM (VALUES " + ", ".join(f"({_literal(a)}, {_literal(b)}, {str(v).lower()}, {str(v).lower()})" for a, b, v in _PAIRS) + ") AS t(a, b, forth, back)")
def golden_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(a, b) for a, b, _ in _PAIRS], "a string, b string")
    rows = rows.select("a", "b", N.parse_name("a").alias("x"), N.parse_name("b").alias("y"))
    return rows.select("a", "b", N.names_consistent("x", "y").alias("forth"), N.names_consistent("y", "x").alias("back"))


@_query("golden_reject", "SELECT * FROM (VALUES ('Alice'), ('Smith Jr.'), ('vt gh'), ('ABC'), ('a b c'), ('23'), (''), ('Mr. Andrews')) AS t(raw)")
def golden_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Alice", "Smith Jr.", "vt gh", "ABC", "a b c", "23", "", "Mr. Andrews"]
    rows = spark.createDataFrame([(w,) for w in words], "raw string")
    return rows.withColumn("p", N.parse_name("raw")).where("p IS NULL").select("raw")


_BY_NAME = sql("SELECT min(c_custkey) AS k FROM customer GROUP BY {given}, {surname}")


@_query("dedupe_first", _BY_NAME)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_names(spark, sf_dir, _FULL)
    return dedupe(rows, "k", "first").select("k")


@_query("dedupe_components", _BY_NAME)
def dedupe_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_names(spark, sf_dir, _FULL)
    return dedupe(rows, "k", "components").select("k")


# --- words and characters ----------------------------------------------------------------------

_WORD_FORMS = "CASE {k} % 5 WHEN 0 THEN {given} WHEN 1 THEN upper({surname}) WHEN 2 THEN 'Ng' WHEN 3 THEN 'j.r.' ELSE lower({middle}) END"


@_query(
    "text_predicates",
    sql(
        "SELECT k, NOT regexp_matches(w, '[aeiouyAEIOUY]') AS vowelless, regexp_matches(w, '^[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]') AS consonant, "
        "upper(substr(w, 1, 1)) = substr(w, 1, 1) AS upper, regexp_matches(w, '[A-Za-z]{2}') AS adjacent, w <> upper(w) AND w <> lower(w) AS mixed, "
        "CAST(length(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS INTEGER) AS letters FROM (SELECT c_custkey AS k, " + _WORD_FORMS + " AS w FROM customer)"
    ),
)
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_names(spark, sf_dir, _WORD_FORMS)
    return rows.select(
        "k", T.vowelless("raw").alias("vowelless"), T.starts_with_consonant("raw").alias("consonant"), T.starts_with_uppercase("raw").alias("upper"),
        T.adjacent_letters("raw").alias("adjacent"), T.mixed_case("raw").alias("mixed"), T.letter_count("raw").alias("letters"),
    )


@_query("fold_alike", "SELECT c_custkey AS k, c_custkey % 3 <> 2 AS prefix, c_custkey % 3 <> 1 AS suffix FROM customer")
def fold_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case and punctuation do not count when texts are compared from either end."""
    rows = raw_names(spark, sf_dir, "CASE {k} % 3 WHEN 0 THEN upper({surname}) WHEN 1 THEN {surname} || '-Q' ELSE 'Q-' || {surname} END")
    both = rows.join(raw_names(spark, sf_dir, "{surname}").withColumnRenamed("raw", "other"), "k")
    return both.select("k", T.prefix_alike("raw", "other").alias("prefix"), T.suffix_alike("raw", "other").alias("suffix"))


#: raw, without nickname, capitalised
_CASES = [
    ("x (y) z", "x z", "X (Y) Z"), ("x 'y' z", "x z", "X 'Y' Z"), ("o'neil", "o'neil", "O'Neil"), ("anne-marie", "anne-marie", "Anne-Marie"),
    ("MCKAY", "MCKAY", "Mckay"),
]
#: raw, its ASCII letters, its first one
_FOLDS = [
    ("Straße", "strasse", "S"), ("Žižka", "zizka", "Z"), ("Γαλήνη", "galene", "G"), ("Щербина", "shcherbina", "S"), ("鄭", "zheng", "Z"),
    ("O'Neil", "oneil", "O"), ("12", None, None),
]


@_query("text_kernels", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _CASES) + ") AS t(raw, bare, capital)")
def text_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r[0],) for r in _CASES], "raw string")
    return rows.select("raw", T.without_nickname("raw").alias("bare"), T.capitalised("raw").alias("capital"))


@_query("ascii_folds", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _FOLDS) + ") AS t(raw, letters, initial)")
def ascii_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(r[0],) for r in _FOLDS], "raw string")
    return rows.select("raw", T.ascii_letters("raw").alias("letters"), T.ascii_initial("raw").alias("initial"))


@_query("name_cased_mac", sql("SELECT c_custkey AS k, {mac} AS cased FROM customer"))
def name_cased_mac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_names(spark, sf_dir, "upper({mac})").select("k", T.name_cased("raw").alias("cased"))


# --- SQL surface and streams --------------------------------------------------------------------


@_query("sql_functions", sql("SELECT {surname} AS surname, {titled} AS prefix, count(*) AS n, min({given} || ' ' || {surname}) AS first_display FROM customer GROUP BY 1, 2"))
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    N.register(spark)
    raw_names(spark, sf_dir, "{title} || ' ' || {given} || ' ' || {surname}").createOrReplaceTempView("onomast_names")
    return spark.sql(
        "SELECT name_surname(p) AS surname, name_honorific_prefix(p) AS prefix, count(*) AS n, min(name_display_full(p)) AS first_display "
        "FROM (SELECT parse_name(raw) AS p FROM onomast_names) GROUP BY 1, 2"
    )


_ALL_PARTS = "{title} || ' ' || {given} || ' ' || {middle} || ' ' || {surname} || ' ' || {generation} || ' PhD'"
_SHOWN = "{given} || ' ' || {middle} || ' ' || {surname} || ', ' || {generation}"
#: SQL function: (what it gives for _ALL_PARTS, what it gives for a plain name), as SQL
_BY_FUNCTION = {
    "name_surname": ("{surname}", "{surname}"),
    "name_given": ("{given}", "{given}"),
    "name_initials": ("substr({given}, 1, 1) || substr({middle}, 1, 1)", "substr({given}, 1, 1)"),
    "name_first_initial": ("substr({given}, 1, 1)", "substr({given}, 1, 1)"),
    "name_middle_initials": ("substr({middle}, 1, 1)", "NULL"),
    "name_goes_by_middle": ("false", "false"),
    "name_middle": ("{middle}", "NULL"),
    "name_generation": ("{generation}", "NULL"),
    "name_honorific_prefix": ("{titled}", "NULL"),
    "name_honorific_suffix": ("'Ph.D.'", "NULL"),
    "name_display_first_last": ("{given} || ' ' || {surname}", "{given} || ' ' || {surname}"),
    "name_display_initial_surname": ("substr({given}, 1, 1) || '. ' || {surname}", "substr({given}, 1, 1) || '. ' || {surname}"),
    "name_display_full": (_SHOWN, "{given} || ' ' || {surname}"),
    "name_display_full_with_honorifics": ("{titled} || ' ' || " + _SHOWN + " || ' Ph.D.'", "{given} || ' ' || {surname}"),
    "name_byte_len": (f"CAST(strlen({_SHOWN}) AS INTEGER)", "CAST(strlen({given} || ' ' || {surname}) AS INTEGER)"),
    "surname_key": ("reverse(right(lower({surname}), 4))", "reverse(right(lower({surname}), 4))"),
}


@_query(
    "sql_accessors",
    sql("SELECT c_custkey AS k, " + ", ".join(f"CASE {{k}} % 2 WHEN 0 THEN {a} ELSE {b} END AS {f}" for f, (a, b) in _BY_FUNCTION.items()) + " FROM customer"),
)
def sql_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accessor by its SQL name, on names that reach the kernel and on plain ones."""
    N.register(spark)
    raw_names(spark, sf_dir, f"CASE {{k}} % 2 WHEN 0 THEN {_ALL_PARTS} ELSE {_FULL} END").createOrReplaceTempView("onomast_names")
    calls = ", ".join(f"{f}(p) AS {f}" for f in _BY_FUNCTION)
    return spark.sql(f"SELECT k, {calls} FROM (SELECT k, parse_name(raw) AS p FROM onomast_names)")


@_query("sql_surname_hash", sql("SELECT count(*) AS n, count(DISTINCT right({surname}, 4)) AS keys, count(DISTINCT right({surname}, 4)) AS hashes, CAST(0 AS BIGINT) AS unequal FROM customer"))
def sql_surname_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes tell surname keys apart and no more."""
    N.register(spark)
    raw_names(spark, sf_dir, _MANY).createOrReplaceTempView("onomast_names")
    return spark.sql(
        "SELECT sum(n) AS n, count(DISTINCT key) AS keys, count(DISTINCT hash) AS hashes, count(*) - count(DISTINCT key) AS unequal FROM "
        "(SELECT surname_key(p) AS key, surname_hash(p) AS hash, count(*) AS n FROM (SELECT parse_name(raw) AS p FROM onomast_names) GROUP BY 1, 2)"
    )


@_query("sql_consistent", sql("SELECT c_custkey AS k, true AS initial, c_custkey % 2 = 0 AS generation, true AS given FROM customer"))
def sql_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates by their SQL names."""
    N.register(spark)
    forms = "{given} || ' ' || {surname} || ' III', substr({given}, 1, 1) || '. ' || {surname}, {surname} || ', ' || {given} || CASE {k} % 2 WHEN 0 THEN ' III' ELSE ' Jr.' END"
    raw_names(spark, sf_dir, f"array({forms})").createOrReplaceTempView("onomast_names")
    return spark.sql(
        "SELECT k, names_consistent(a, b) AS initial, names_consistent(a, c) AS generation, names_variants_match(name_given(a), name_given(c)) AS given FROM "
        "(SELECT k, parse_name(raw[0]) AS a, parse_name(raw[1]) AS b, parse_name(raw[2]) AS c FROM onomast_names)"
    )


# --- lines of text in and out ---------------------------------------------------------------------


def _as_lines(spark: SparkSession, sf_dir: str, raw: str) -> DataFrame:
    """The raw names written to files of text and read back, a name a line."""
    folder = f"{scratch(spark, 'lines')}/text"
    raw_names(spark, sf_dir, raw).select("raw").write.text(folder)
    return read_lines(spark, folder)


@_query("lines_parse", ORACLES["json_lines"])
def lines_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parse -``: lines of names in, a JSON line each out, empty where there is no name."""
    raw = "CASE {k} % 5 WHEN 0 THEN {given} ELSE '  ' || {given} || ' ' || {surname} || ' ' || {generation} || ' ' END"
    lines = _as_lines(spark, sf_dir, raw).withColumn("p", N.parse_name("value"))
    folder = f"{scratch(spark, 'lines')}/json"
    records_as_lines(lines).write.text(folder)
    return read_lines(spark, folder)


@_query("lines_match", sql("SELECT {surname} || ', ' || {given} AS value FROM customer WHERE {surname} = 'Hudson' AND {given} = 'Julia'"))
def lines_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eq - NAME``: the lines that match a name, as they are."""
    lines = _as_lines(spark, sf_dir, "'  ' || {surname} || ', ' || {given} || ' '").withColumn("p", N.parse_name("value"))
    folder = f"{scratch(spark, 'lines')}/found"
    matches_as_lines(probe(lines, "JULIA HUDSON")).write.text(folder)
    return read_lines(spark, folder)


@_query("exit_status", "SELECT * FROM (VALUES ('parse Jane Doe', 0), ('parse xyz', 1), ('eq', 64), ('eq -', 64), ('eq Jane Doe|J. Doe', 0), ('eq Jane Doe|John Doe', 1)) AS t(arguments, status)")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line's calls end with."""
    from onomast.cli import main

    calls = {"parse Jane Doe": ["parse", "Jane", "Doe"], "parse xyz": ["parse", "xyz"], "eq": ["eq"], "eq -": ["eq", "-"]}
    calls |= {"eq Jane Doe|J. Doe": ["eq", "Jane Doe", "J. Doe"], "eq Jane Doe|John Doe": ["eq", "Jane Doe", "John Doe"]}
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        rows = [(c, main(a)) for c, a in calls.items()]
    return spark.createDataFrame(rows, "arguments string, status int")


@_query("stream_parse", sql("SELECT c_custkey AS k, {given} AS given_name, {surname} AS surname FROM customer"))
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as a stream, parsed and written by a streaming query."""
    from onomast.plans.ingredients import Picks
    from onomast.streaming import drained, parsed_stream

    path = f"{sf_dir}/customer.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    names = rows.select(F.col("c_custkey").alias("k"), F.expr(Picks.fill(_MANY, "c_custkey", True)).alias("value"))
    out = parsed_stream(names).select("k", N.given_name("p").alias("given_name"), N.surname("p").alias("surname"))
    folder = scratch(spark, "stream")
    drained(out, folder)
    return spark.read.parquet(f"{folder}/table")
