"""Every catalogue query against its SQL, on the smallest test tables."""

import os

import pandas as pd
import pytest

from onomast.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0


def test_junk_lines_are_of_documents_and_conversations(spark, tmp_path):
    spark.createDataFrame([("Jane Doe\nJohn Smith",)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("Ann Lee",)], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert tuple(QUERIES["documents_junk_parse"](spark, str(tmp_path)).first()) == (3, 0, 0, 0)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
