"""How good the answers are: recall, reciprocal rank, diversity; counts of matching lines; percentiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlewright.durable import cut
from bundlewright.functions.text import lines_of, trigram_jaccard, trigrams

AT = 5
#: Needles that are looked for in one pass.
NEEDLES = 50_000


def relevant_chunks(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks whose lower-cased text has one of the query's needles.

    All needles are looked for in one pass over each text, by an automaton. Up to ``NEEDLES`` of them are sent to the chunks at a time; more take more passes.
    """
    each = golden.select("query_id", F.explode("needles").alias("needle")).where("needle is not null").distinct()
    passes = max(1, -(-each.count() // NEEDLES))
    each = each.withColumn("part", F.pmod(F.xxhash64("needle"), F.lit(passes)))
    lowered = chunks.select("chunk_id", F.lower("text").alias("text")).where("text is not null")
    out = None
    for part in range(passes):
        found = _holding(lowered, each.where(F.col("part") == part).select("query_id", "needle").collect(), each.schema["query_id"].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    return out if passes == 1 else out.distinct()


def _holding(lowered: DataFrame, needles: list, kind: str) -> DataFrame:
    ids: dict[str, list] = {}
    for row in needles:
        ids.setdefault(row["needle"], []).append(row["query_id"])
    shared = lowered.sparkSession.sparkContext.broadcast(ids)  # about NEEDLES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for needle, queries in shared.value.items():
            if needle:
                machine.add_word(needle, queries)
        always = shared.value.get("", [])
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            rows, queries = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = set(always)
                if len(machine):
                    for _, some in machine.iter(text):
                        found.update(some)
                rows += [i] * len(found)
                queries += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(queries, query_type), batch.column("chunk_id").take(pa.array(rows, pa.int64()))], ["query_id", "chunk_id"])

    query_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return lowered.mapInArrow(run, f"query_id {kind}, chunk_id {lowered.schema['chunk_id'].dataType.simpleString()}")


def recall_and_rank(top: DataFrame, relevant: DataFrame, at: int = AT) -> DataFrame:
    """(query_id, n_relevant, hits, recall, reciprocal_rank) of queries with a relevant chunk; ``top`` has (query_id, i, chunk_id)."""
    first = top.where(F.col("i") <= at)
    hits = first.join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("i").alias("first"))
    sizes = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return sizes.join(hits, "query_id", "left").select(
        "query_id",
        "n_relevant",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def mean_metrics(ranks: DataFrame, diverse: DataFrame) -> DataFrame:
    """One row (n_queries, recall, mrr, diversity): means over the queries of ``recall_and_rank`` and ``diversity``; null without any."""
    means = ranks.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    return means.crossJoin(diverse.agg(F.round(F.avg("diversity"), 6).alias("diversity")))  # one row each


def result_summary(top: DataFrame) -> DataFrame:
    """(query_id, n_results, top_score): how many answers each query has, and the best one's score."""
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.round(F.max("score"), 6).alias("top_score"))


def diversity(texts: DataFrame, at: int = AT) -> DataFrame:
    """(query_id, diversity): 1 less the mean Jaccard of trigrams over pairs of the first answers (query_id, i, text); 1 for a single one."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = texts.where(F.col("i") <= at).repartition(parts, "query_id", "i")  # few rows, each with much to do
    first = cut(few.select("query_id", "i", trigrams(F.col("text")).alias("t")))
    a = first.select("query_id", "i", F.col("t").alias("ti"))
    b = first.select("query_id", F.col("i").alias("j"), F.col("t").alias("tj"))
    pairs = a.join(b, "query_id").where("i < j").select("query_id", trigram_jaccard(F.col("ti"), F.col("tj")).alias("sim"))
    means = pairs.groupBy("query_id").agg(F.avg("sim").alias("sim"))
    return first.select("query_id").distinct().join(means, "query_id", "left").select("query_id", F.round(1 - F.coalesce("sim", F.lit(0.0)), 6).alias("diversity"))


def match_counts(files: DataFrame, pattern: str) -> DataFrame:
    """(file, n_lines, n_matches): lines that match a pattern, and matches in all, of files with any."""
    lines = files.select("file", F.explode(lines_of(F.col("content"))).alias("line"))
    counts = lines.groupBy("file").agg(
        F.count_if(F.col("line").rlike(pattern)).alias("n_lines"), F.sum(F.regexp_count("line", F.lit(pattern))).alias("n_matches")
    )
    return counts.where("n_matches > 0")


def percentiles(samples: DataFrame, column: str) -> DataFrame:
    """One row: p50, p95, p99 by nearest rank, and the median."""
    ranked = [f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`) AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)]
    return samples.selectExpr(*ranked, f"median(`{column}`) AS median")
