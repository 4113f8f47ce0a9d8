"""Joins of name tables that hold many copies of equal names."""

import pytest

from onomast import functions as N
from onomast.kernel.match import consistent
from onomast.kernel.parse import parse
from onomast.operators import candidates, match_join, match_pairs
from onomast.plans import QUERIES

COPIES = 300
LEFT = ["J. Doe", "Jane Q. Doe", "Zed Zimmer", "Doe-Roe Jane Quinn Jane", None]
RIGHT = ["Jane Doe", "Jane Doe Jr.", "K. Doe", "Doe-Roe Jane Quinn Jane", "nobody"]


@pytest.fixture(scope="module")
def sides(spark):
    def table(texts):
        rows = spark.createDataFrame(list(enumerate(texts * COPIES)), "id long, raw string")
        return rows.withColumn("p", N.parse_name("raw"))

    return table(LEFT), table(RIGHT)


@pytest.fixture(scope="module")
def want():
    """(left id, right id) of all pairs, by the kernel on every pair of texts."""
    agree = {}
    for i, a in enumerate(LEFT):
        for j, b in enumerate(RIGHT):
            x, y = a and parse(a), b and parse(b)
            agree[i, j] = bool(x and y and consistent(x, y))
    n, m = len(LEFT), len(RIGHT)
    return {(i, j) for i in range(n * COPIES) for j in range(m * COPIES) if agree[i % n, j % m]}


def joined_rows(df) -> list[int]:
    """The rows that each join of an executed plan made."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind.endswith("JoinExec"):
                out.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def test_anti_match_makes_no_pairs_of_copies(sides, want):
    left, right = sides
    out = match_join(left, right, "id", "id", "left_anti")
    got = sorted(r.id for r in out.collect())
    assert got == sorted(set(range(len(LEFT) * COPIES)) - {a for a, _ in want}) and out.columns == left.columns
    assert max(joined_rows(out)) <= left.count()


def test_pairs_of_copies_are_decided_once_and_dealt_out(sides, want):
    left, right = sides
    assert candidates(left, right, "id", "id").count() <= len(LEFT) * len(RIGHT)
    out = match_pairs(left, right, "id", "id")
    got = [(r.left_id, r.right_id) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2


def test_left_match_makes_only_the_pairs_it_returns(sides, want):
    left, right = sides
    out = match_join(left, right, "id", "id", "left")
    assert out.columns == [*left.columns, "right_id"]
    kept = out.select("id", "right_id")
    got = [(r.id, r.right_id) for r in kept.collect()]
    alone = {(i, None) for i in set(range(len(LEFT) * COPIES)) - {a for a, _ in want}}
    assert len(got) == len(want) + len(alone) and set(got) == want | alone
    made = joined_rows(kept)
    assert max(made) == len(got) and sum(made) <= 1.1 * len(got)


def test_semi_match_makes_no_pairs_of_copies(sides, want):
    left, right = sides
    out = match_join(left, right, "id", "id", "left_semi")
    assert sorted(r.id for r in out.collect()) == sorted({a for a, _ in want}) and out.columns == left.columns
    assert max(joined_rows(out)) <= left.count()


def parsed_rows(df) -> int:
    """The rows that an executed plan sent to Python, for parsing or comparing."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ArrowEvalPythonExec":
                out += node.metrics().apply("pythonNumRowsReceived").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def test_left_match_of_texts_parses_each_once_and_deals_rows_out(sides, want):
    left, right = (df.drop("p") for df in sides)
    out = match_join(left, right, "id", "id", "left", text="raw")
    assert out.columns == [*left.columns, "right_id"]
    got = [(r.id, r.right_id) for r in out.collect()]
    alone = {(i, None) for i in set(range(len(LEFT) * COPIES)) - {a for a, _ in want}}
    assert len(got) == len(want) + len(alone) and set(got) == want | alone
    # records of texts are taken twice, and pairs of records decided once
    assert 0 < parsed_rows(out) <= 2 * (len(LEFT) + len(RIGHT)) + len(LEFT) * len(RIGHT)


@pytest.mark.parametrize("names", [{"p": "p"}, {"text": "raw"}])
def test_left_match_makes_no_rows_in_a_few_tasks(sides, spark, names):
    left, right = sides
    one = left.where("raw = 'J. Doe'")
    out = match_join(one, right, "id", "id", "left", **names).select("id", "right_id")
    parts = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(parts) < 0.8 * sum(parts)


def test_left_match_query_parses_different_texts_alone(spark):
    """Of 1,000 suppliers and 15,000 customers there are 175 and 425 different names."""
    out = QUERIES["left_match"](spark, "/root/testdata/sf0.1")
    out.collect()
    assert 0 < parsed_rows(out) <= 2 * (175 + 425) + 1000


def test_semi_match_of_texts_parses_each_once(sides, want):
    left, right = (df.drop("p") for df in sides)
    matched = {a for a, _ in want}
    for how, ids in (("left_semi", matched), ("left_anti", set(range(len(LEFT) * COPIES)) - matched)):
        out = match_join(left, right, "id", "id", how, text="raw")
        assert sorted(r.id for r in out.collect()) == sorted(ids) and out.columns == left.columns
        assert max(joined_rows(out)) <= left.count()
        assert 0 < parsed_rows(out) <= 2 * len(LEFT) + len(RIGHT) + len(LEFT) * len(RIGHT)


def test_semi_match_query_parses_different_texts_alone(spark):
    """Of 1,000 suppliers and 15,000 customers there are 175 and 425 different names."""
    out = QUERIES["semi_match"](spark, "/root/testdata/sf0.1")
    out.collect()
    assert 0 < parsed_rows(out) <= 2 * 175 + 425 + 1000
