"""Queries that SQL can express, against DuckDB."""

import pytest

from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, same, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])
