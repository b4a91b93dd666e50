"""From raw documents to packed windows, in five stages.

Each stage takes the documents that the one before kept and returns those that it keeps, with
the columns of ``documents``; the last returns where each piece of each document goes. Every
stage's result is written as Parquet to the folder that executors share, so a lost executor costs a
part of one stage; it is deleted when the next stage's is written.

Defined cases: a null or empty text, or one without letters, goes in the first stage, as no language can be told; a null label or source is
like any other that says nothing; of rows that share an id and a text, or are like each other, one stays; rows with a null id are nobody's near
duplicates, but repeats are cut from them (they come last in order); texts of any length go through whole; extra columns,
whatever their names, are kept up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bundlewright.durable import checkpoint_dir, remove
from bundlewright.llm import language_id, near_duplicates, packing, quality_rules, repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the model is trained on the stage's own input."""
    return language_id.accepted(docs, language_id.train(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality_rules.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    return near_duplicates.unique(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts have each repeated passage only where it occurs first."""
    return repeats.cut_out(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_windows),
]

#: Language identification, near duplicates, repeats and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table of documents."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
