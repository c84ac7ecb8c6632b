"""Corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Defined results: rows with a NULL, empty or blank text have no language and go with the first stage, unless no language could
be learned at all (no labelled documents): then nothing is rejected there. Repeated rows and copies are one document after
the third stage. Columns beside those of documents are kept up to the last stage, whatever their names. Each stage gives an
empty table for an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktempo.llm import decontaminate, language, packing, quality_rules, simhash
from worktempo.llm.common import remove_folder, shared_folder, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters go, and those unlike what was learned of the language."""
    model = language.fit(docs)
    if not model.languages:
        return docs
    return language.identify(docs, model).where((F.col("lang_pred") != "und") & F.col("typical")).select("row.*")


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identified), ("quality_rules", ruled), ("near_duplicates", deduplicated),
    ("decontamination", decontaminated), ("packing", packed),
]

#: Learned models and packing are no SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what this stage has read is not needed any more
            remove_folder(spark, before)
        before = path
    return docs
