"""Column functions, SQL functions, operators, sources and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from onomast import functions as N
from onomast.operators import components, dedupe, match_join, match_pairs, name_tokens, parse_stats, probe, surname_frequency
from onomast.sources import matches_as_lines, names_of, read_lines, records_as_lines

TEXTS = [
    "Jane Doe", "Jane Q. Doe", "Jane Q Doe", "Mary E. Lee", "Dr. Jane Doe", "Bo Li", "Senior X. Smith", "Jane X. Senior", "Al Gore", "JANE DOE",
    "Doe, Jane", "Sir Y. Lee", "Jo Q. Public", "nobody", "", None, "郑和", "J. Quinn Doe Jr.",
]


@pytest.fixture(scope="module")
def names(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, raw string")
    return rows.withColumn("p", N.parse_name("raw")).cache()


def test_native_path_equals_kernel(names):
    both = names.withColumn("q", N.parse_name("raw", fast=False))
    assert both.where(~F.to_json("p").eqNullSafe(F.to_json("q"))).count() == 0


def test_native_path_equals_kernel_on_mixtures(spark):
    """All short mixtures of ordinary words, titles, particles, suffixes and initials."""
    words = "Jane Doe Jo Ng Captain King Van Ben Jr Senior Iv Phd Q. X V E Y McAvoy O'Doe Li".split()
    texts = [f"{a} {b}" for a in words for b in words] + [f"{a}, {b}" for a in words for b in words]
    texts += [f"{a} {b} {c}" for a in words for b in words for c in words] + [f"{a}, {b} {c}" for a in words for b in words for c in words]
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    both = rows.select("raw", F.to_json(N.parse_name("raw")).alias("x"), F.to_json(N.parse_name("raw", fast=False)).alias("y"))
    assert both.where("NOT x <=> y").limit(5).collect() == []


def test_accessors(names):
    row = names.where("id = 17").select(
        N.first_initial("p"), N.given_name("p"), N.middle_name("p"), N.middle_initials("p"), N.surname("p"), N.generational_suffix("p"),
        N.display_initial_surname("p"), N.display_first_last("p"), N.display_full("p"), N.byte_len("p"), N.goes_by_middle_name("p"),
    ).first()
    assert tuple(row) == ("J", "Quinn", None, "Q", "Doe", "Jr.", "J. Doe", "Quinn Doe", "J. Quinn Doe, Jr.", 17, True)
    nothing = names.where("raw = 'nobody'").select(N.display_full("p"), N.byte_len("p"), N.goes_by_middle_name("p"), N.middle_names("p")).first()
    assert tuple(nothing) == (None, None, None, None)


def test_json_lines_stay_aligned(names):
    lines = [r.value for r in records_as_lines(names.orderBy("id")).collect()]
    assert len(lines) == len(TEXTS) and lines[13] == lines[14] == lines[15] == ""
    assert list(json.loads(lines[1])) == ["first_initial", "surname", "given_name", "middle_initials"]


def test_sql_functions(spark, names):
    N.register(spark)
    names.createOrReplaceTempView("names_t")
    ours = names.select("id", N.display_full("p"), N.middle_name("p"), N.goes_by_middle_name("p"), N.byte_len("p"), N.surname_hash("p"))
    sql = spark.sql("SELECT id, name_display_full(p), name_middle(p), name_goes_by_middle(p), name_byte_len(p), surname_hash(p) FROM names_t")
    assert sorted(map(str, ours.collect())) and [tuple(r) for r in ours.orderBy("id").collect()] == [tuple(r) for r in sql.orderBy("id").collect()]
    assert spark.sql("SELECT names_consistent(parse_name('Jane Doe'), parse_name('J. Doe')), names_variants_match('Bill', 'William')").first()[:] == (True, True)


def test_native_verdict_equals_kernel(names):
    a, b = names.select(F.col("p").alias("a")), names.select(F.col("p").alias("b"))
    pairs = a.join(b, F.lit(True))
    both = pairs.select(N.names_consistent("a", "b").alias("x"), F.expr("true"), F.coalesce(N.matching.kernel_verdict(*(N.matching.packed(F.col(c)) for c in "ab")), F.lit(False)).alias("y"))
    assert both.where("x <> y").count() == 0 and both.where("x").count() > len(TEXTS) - 4


def test_joins(spark, names):
    probes = spark.createDataFrame([(100, "J. Doe"), (101, "Zed Zimmer"), (102, None)], "pid long, raw string").withColumn("p", N.parse_name("raw"))
    got = {r.right_id for r in match_pairs(probes, names, "pid", "id").collect()}
    assert got == {0, 1, 2, 4, 9, 10, 17}
    assert [r.pid for r in match_join(probes, names, "pid", "id", "left_semi").collect()] == [100]
    assert sorted(r.pid for r in match_join(probes, names, "pid", "id", "left_anti").collect()) == [101, 102]
    assert match_join(probes, names, "pid", "id", "left").count() == 9
    with pytest.raises(ValueError):
        match_join(probes, names, "pid", "id", "cross")


def test_join_plan_has_no_cross_join(names):
    plan = match_pairs(names, names, "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_probe(names):
    assert sorted(r.id for r in probe(names, "Doe, J.").collect()) == [0, 1, 2, 4, 9, 10, 17]
    with pytest.raises(ValueError):
        probe(names, "nobody")


def test_counts(names):
    assert tuple(parse_stats(names).first()) == (14, 4)  # "Jane X. Senior" has a generation and no surname
    assert [tuple(r) for r in surname_frequency(names, 2).collect()] == [("Doe", 7), ("Lee", 2)]


def test_dedupe(spark):
    rows = spark.createDataFrame([(1, "J. Doe"), (2, "Jane Doe"), (3, "Jim Doe"), (4, "nobody"), (5, "Ann Roe")], "id long, raw string")
    rows = rows.withColumn("p", N.parse_name("raw"))
    assert sorted(r.id for r in dedupe(rows, "id", "first").collect()) == [1, 4, 5]
    assert sorted(r.id for r in dedupe(rows, "id", "components").collect()) == [1, 4, 5]


def test_dedupe_of_copies(spark):
    odd = "Doe-Roe Jane Quinn Jane"  # not consistent with itself
    texts = ["Jane Doe", "Jane Doe", odd, odd, "Jim Doe", "J. Doe", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, raw string").withColumn("p", N.parse_name("raw"))
    for policy in ("first", "components"):
        out = dedupe(rows, "id", policy)
        assert sorted(r.id for r in out.collect()) == ([0, 2, 3, 4, 6] if policy == "first" else [0, 2, 3, 6]) and out.columns == rows.columns
    with pytest.raises(ValueError):
        dedupe(rows, "id", "other")


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (3, 2), (2, 3), (5, 5), (None, 1), (20, 21), (21, 22), (22, 9)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {7: 1, 8: 1, 9: 1, 20: 1, 21: 1, 22: 1, 3: 2}
    assert components(edges.where("false")).count() == 0


def test_tokens(names):
    found = names.where("id = 4").select(F.explode(name_tokens("raw")).alias("t")).select("t.word", "t.kind").collect()
    assert [tuple(r) for r in found] == [("Dr.", "abbreviation"), ("Jane", "name"), ("Doe", "name")]


def test_lines_and_stream(spark, tmp_path):
    from onomast.sources import stream_lines
    from onomast.streaming import drained, matched_stream, parsed_stream, windowed_surnames

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Jane Doe\n\n  J. Doe \nnobody\n")
    batch = read_lines(spark, str(folder)).withColumn("p", N.parse_name("value"))
    drained(parsed_stream(stream_lines(spark, str(folder))), str(tmp_path / "out"))
    streamed = spark.read.parquet(str(tmp_path / "out" / "table"))
    assert sorted(map(str, batch.collect())) == sorted(map(str, streamed.collect()))
    assert sorted(r.value for r in matches_as_lines(probe(batch, "Jane Doe")).collect()) == ["J. Doe", "Jane Doe"]
    registry = names_of(spark, "Jane Doe").withColumn("p", N.parse_name("value"))
    stream = parsed_stream(stream_lines(spark, str(folder)))
    drained(matched_stream(stream, registry, "value", "value"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m" / "table")).count() == 2
    assert windowed_surnames(stream.withColumn("ts", F.current_timestamp()), "ts").isStreaming


def test_command_line(capsys, spark, monkeypatch):
    from onomast import cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["parse", "Doe,", "Jane"]) == 0 and '"surname":"Doe"' in capsys.readouterr().out
    assert cli.main(["parse", "nobody"]) == 1
    assert cli.main(["eq", "J. Doe", "Jane Doe"]) == 0 and capsys.readouterr().out.strip().endswith("y")
    assert cli.main(["eq", "J. Doe", "Ann Doe"]) == 1
    assert cli.main([]) == cli.main(["eq", "x"]) == 64
    monkeypatch.setattr("sys.stdin", iter(["Jane Doe\n", "x\n", "J. Doe\n"]))
    assert cli.main(["eq", "-", "J Doe"]) == 0 and capsys.readouterr().out.split("\n")[-3:] == ["Jane Doe", "J. Doe", ""]
    monkeypatch.setattr("sys.stdin", iter(["Jane Doe\n", "x\n"]))
    assert cli.main(["parse", "-"]) == 0 and capsys.readouterr().out.count("\n") == 2
    assert cli.main(["eq", "-", "x"]) == 1
