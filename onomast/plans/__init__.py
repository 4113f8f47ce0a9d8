"""Ready-made queries over names made from the test tables, and their SQL."""

from onomast.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
