"""The pipeline stage by stage, each stage on what the one before it kept."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from worktempo.llm import decontaminate, simhash

DATA = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_registered():
    names = set(entry_point.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns and docs.exceptAll(before).isEmpty()
        if name == "near_duplicates":
            assert {r.component_id for r in simhash.assigned(before).collect()} == {r.doc_id for r in docs.collect()}
        if name == "decontamination":
            assert decontaminate.find_leaks(docs, benchmark).isEmpty()
            gone = before.join(docs, "doc_id", "left_anti")
            assert {r.doc_id for r in gone.collect()} == {r.doc_id for r in decontaminate.find_leaks(before, benchmark).collect()}
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
    assert sizes[1] > 0.95 * sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]


def test_clean_labelled_documents_stay(spark):
    labels = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.ruled(spark, corpus_pipeline.identified(spark, docs, str(DATA)), str(DATA))
    assert len({r.doc_id for r in kept.collect()} & labels) > 0.95 * len(labels)


def test_run(spark):
    rows = corpus_pipeline.run(spark, str(DATA))
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 500


def chained(spark, docs, tmp_path):
    """Columns and rows of what each stage keeps, written and read again as in `run`."""
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append((docs.columns, docs.count()))
    return docs, sizes


def test_odd_rows_go_through_all_stages(spark, odd, docs, words, tmp_path):
    """NULLs, blanks, very long texts, repeated rows and columns with clashing names beside ordinary documents."""
    rows = odd.unionByName(docs(*[(100 + n, words(60), "en" if n % 2 else "de", "a") for n in range(40)], clash=True))
    packed, sizes = chained(spark, rows, tmp_path)
    assert all(columns == rows.columns for columns, _ in sizes[:4])
    kept = {r.doc_id for r in packed.collect()}
    assert {1, 2, 3}.isdisjoint(kept) and len(kept & set(range(100, 140))) >= 38
    assert spark.read.parquet(f"{tmp_path}/near_duplicates").where("doc_id = 5").count() <= 1


def test_an_empty_table_goes_through_all_stages(spark, no_docs, tmp_path):
    assert [n for _, n in chained(spark, no_docs, tmp_path)[1]] == [0] * 5


def test_without_known_languages_nothing_is_rejected(spark, docs, words):
    rows = docs(*[(n, words(30), None, None) for n in range(10)], (10, "", None, None))
    assert corpus_pipeline.identified(spark, rows, str(DATA)).count() == 11


def test_unlearned_languages_go(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    russian = table.limit(1).selectExpr(
        "CAST(-1 AS BIGINT) AS doc_id", "repeat('широкая электрификация южных губерний ', 20) AS text", "CAST(NULL AS STRING) AS lang",
        "source", "n_chars")
    kept = corpus_pipeline.identified(spark, table.unionByName(russian), str(DATA))
    assert kept.where("doc_id = -1").count() == 0 and kept.count() > 0.98 * table.count()
