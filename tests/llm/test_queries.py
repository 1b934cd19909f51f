"""Registered queries: against SQL where there is some, else for a row a row."""

import pytest

from brindle.llm import queries
from brindle.session import read_table
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small), connect(small), queries.SQL[name])


@pytest.mark.parametrize("name", ["op2_language_id", "op9_quality_classifier", "op7_media_columns"])
def test_a_row_for_each_document(spark, small, name):
    ids = sorted(r[0] for r in queries.QUERIES[name](spark, small).select("doc_id").collect())
    assert ids == sorted(r[0] for r in read_table(spark, small, "documents").select("doc_id").collect())
