"""Corpus queries against their SQL, on the smallest test tables."""

import pytest

from onomast.llm.queries import ORACLES, QUERIES
from tests.test_queries import DATA, duck, plain, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
