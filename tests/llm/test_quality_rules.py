"""Base figures against a plain computation, sketches against exact quantiles, and the SQL."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest
from compare import connect, oracle_rows, spark_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worktempo.llm import quality_rules as q
from worktempo.llm import queries, sql

DATA = Path("/root/testdata/sf0.01")
WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered, seen, twice = set(), set(), 0
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab #\n\t\x0b\x1c é|", max_size=60), min_size=1, max_size=20))
def test_figures_equal_a_plain_computation(docs, texts):
    rows = q.measured(docs(*enumerate(texts)), "doc_id").collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_odd_rows(odd, no_docs):
    rows = q.verdicts(odd).collect()
    assert len(rows) == 11 and q.verdicts(no_docs).count() == 0
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert [r.kept for r in rows if r.doc_id == 5] == [True, True]
    kept = q.keep(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 2
    assert kept.count() == sum(r.kept for r in rows)


@pytest.mark.parametrize("value", [0, 1, 31, 32, 33, 63, 64, 100, 1000, 999_999])
def test_buckets(spark, value):
    row = spark.range(1).select(F.expr(q.bucket(f"{value}L")).alias("b")).select(F.expr(q.bucket_top("b")).alias("top")).first()
    assert value <= row.top <= value * 17 / 16 + 1


def test_small_groups_take_the_wider_sketch(docs, words):
    rows = [(n, words(40), "en", "big") for n in range(60)] + [(100 + n, words(40), "en", "small") for n in range(3)]
    found = docs(*rows, (200, " ".join(f"*** {w} ***" for w in words(40).split()), "en", "small"))
    kept = {r.doc_id: r.kept for r in q.verdicts(found).collect()}
    assert not kept[200] and sum(kept.values()) == 63


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_equals_sql(spark):
    name = "op10_quality_rules"
    got = spark_rows(queries.queries()[name](spark, str(DATA)))
    assert got == oracle_rows(connect(str(DATA)), sql.oracle_sql()[name])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op10_quality_rules", "op4_url_filter"])
def test_no_python_in_the_plan(spark, name):
    plan = queries.queries()[name](spark, str(DATA))._jdf.queryExecution().toString()
    for bad in ("EvalPython", "InPandas", "InArrow", "CartesianProduct"):
        assert bad not in plan
