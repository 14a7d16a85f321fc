"""Queries on nested dump records (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import nested
from lectern.tables import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return nested.dump_lines(table(spark, d, "authors"), table(spark, d, "editions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null array element of the newest readable line of each author and edition."""
    return nested.newest_elements(_lines(spark, d))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The flat child table of the same lines, each row with its parent's path and its position."""
    return nested.flat_nodes(_lines(spark, d))


QUERIES = {"p2_found": p2_found, "p2_nodes": p2_nodes}
SQL: dict[str, str] = {}
