"""Queries against the same results as SQL."""

from __future__ import annotations

import pytest
from compare import connect, oracle_rows, spark_rows

from worktempo.llm.queries import queries
from worktempo.llm.sql import oracle_sql

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair", "op13_chat_format"])
def test_sql(spark, name):
    found = spark_rows(queries()[name](spark, DATA))
    assert found[1] and found == oracle_rows(connect(DATA), oracle_sql()[name])
