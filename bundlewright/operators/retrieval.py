"""Scoring many queries at once: terms, candidate files, BM25, top N, cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlewright.durable import cut
from bundlewright.functions.paths import path_parts
from bundlewright.functions.signatures import jaccard_estimate
from bundlewright.functions.text import unique_tokens
from bundlewright.operators.index import Index, signatures, term_bucket

K1, B = 1.5, 0.75
#: A search feeds at least so many chunks to the selection, however few are asked for.
LEAST_TOP = 10
#: Distinct terms whose names are sent to the scan of saved postings; more have no use there.
PUSHED_TERMS = 2_000
#: Query terms that may be broadcast; more are shuffled.
BROADCAST_TERMS = 200_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct tokens of each query (query_id, query)."""
    return queries.select("query_id", F.explode(unique_tokens(F.col("query"))).alias("term"))


def sized(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Marked for broadcast if it has no more rows than the limit; else left to a shuffled join. No more are counted than tell."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def candidate_files(terms: DataFrame, file_terms: DataFrame) -> DataFrame:
    """(query_id, file): files with any term of the query; without a term, a query has none here (see ``prescreen``)."""
    return file_terms.join(sized(terms), "term").select("query_id", "file").distinct()


def prescreen(queries: DataFrame, file_terms: DataFrame) -> DataFrame:
    """(query_id, file) that may hold an answer; a query without any token may be answered by every file."""
    terms = query_terms(queries)
    blank = queries.select("query_id", F.size(unique_tokens(F.col("query"))).alias("n")).where("n = 0").select("query_id")
    every = file_terms.select("file").distinct().crossJoin(blank).select("query_id", "file")
    return candidate_files(terms, file_terms).unionByName(every)


def bm25_weight(tf: Column, dl: Column, df: Column, n_docs: Column, avgdl: Column) -> Column:
    """One term's share of the score; the inverse frequency is always positive."""
    idf = F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_scores(index: Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of each chunk with a term of the query.

    Statistics are those of the whole corpus, even if ``allowed`` (chunk_id) leaves few chunks. The terms of all
    queries are sent to the postings, which are not shuffled if the terms are few; scores are summed before they
    are shuffled. Of saved postings only the folders of those terms are read.
    """
    asked = query_terms(queries)
    posted, stats = index.postings, index.term_stats
    if index.saved:
        names = asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
        if len(names) <= PUSHED_TERMS:  # with more terms than that every folder has some
            names = [r["term"] for r in names]
            buckets = [r["b"] for r in asked.select(term_bucket(F.col("term")).alias("b")).distinct().collect()]
            posted, stats = posted.where(F.col("bucket").isin(buckets) & F.col("term").isin(names)), stats.where(F.col("term").isin(names))
        posted = posted.drop("bucket")
    terms = sized(asked.join(stats, "term"))
    found = posted.join(terms, "term")
    if allowed is not None:
        found = found.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    found = found.crossJoin(F.broadcast(index.corpus_stats))  # one row
    weight = bm25_weight(*(F.col(c) for c in ("tf", "dl", "df", "n_docs", "avgdl")))
    return found.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score")).where("score > 0")


def top_chunks(scores: DataFrame, chunks: DataFrame, topk: int) -> DataFrame:
    """(query_id, i, chunk_id, file, start_line, end_line, token_est, score): the best ``topk``, 10 at least, numbered from 1.

    Equal scores stay in the order of the corpus: by the parts of the path, then by line.
    A first cut by rounded score keeps all ties, so places are looked up for few rows only.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("rounded"))
    few = scores.withColumn("rounded", F.round("score", 6)).withColumn("r", F.rank().over(best)).where(F.col("r") <= max(topk, LEAST_TOP))
    placed = few.join(chunks.select("chunk_id", "file", "start_line", "end_line", "token_est"), "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("rounded"), path_parts(F.col("file")), "start_line", "chunk_id")
    placed = placed.withColumn("i", F.row_number().over(order)).where(F.col("i") <= max(topk, LEAST_TOP))
    return placed.select("query_id", "i", "chunk_id", "file", "start_line", "end_line", "token_est", "score")


def normalised(top: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """With ``rel``, the score over the query's best; those below ``min_ratio`` go, if it is above 0."""
    best = F.greatest(F.lit(1e-6), F.max("score").over(Window.partitionBy("query_id")))
    out = top.withColumn("rel", F.col("score") / best)
    return out.where(F.col("rel") >= min_ratio) if min_ratio > 0 else out


def chunks_of(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The chunks of the given files (file); names are compared as they are, unknown ones have no effect."""
    return chunks.join(files.select("file").distinct(), "file", "left_semi")


def chosen_chunks(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that ``top`` (file, chunk_id) names. It is read twice, and sent to the texts if it is small: those are
    not shuffled, and where chunks are plans, files without any aren't cut."""
    some = chunks.join(sized(top.select("file").distinct()), "file", "left_semi")
    return some.join(sized(top.select("chunk_id").distinct()), "chunk_id", "left_semi").select(chunks.columns)


def with_texts(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """With the ``text`` of each chunk."""
    return top.join(chosen_chunks(top, chunks).select("chunk_id", "text"), "chunk_id")


def similarity_pairs(top: DataFrame, index: Index) -> DataFrame:
    """(query_id, i, j, sim), i < j: the estimated Jaccard of each two of a query's chunks; at most topk squared for each query.

    Where the index isn't saved, signatures are made of those chunks only.
    """
    minhash = index.minhash if index.saved else signatures(chosen_chunks(top, index.chunks), index.slots)
    signed = cut(top.select("query_id", "i", "chunk_id").join(minhash, "chunk_id", "left"))  # read twice
    a = signed.select("query_id", "i", F.col("sig").alias("sig_i"))
    b = signed.select("query_id", F.col("i").alias("j"), F.col("sig").alias("sig_j"))
    pairs = a.join(b, "query_id").where("i < j")
    return pairs.select("query_id", "i", "j", jaccard_estimate(F.col("sig_i"), F.col("sig_j")).alias("sim"))
