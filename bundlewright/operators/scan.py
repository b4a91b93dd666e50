"""Batches of queries answered in one pass over the texts, without postings.

Files that have no saved index would need one for a single batch: a shuffle of every token, to read back those of the
queries. Here each text is cut and split into tokens once, and only the tokens of the queries are kept, in a small table
of one row for each chunk. A row has all that its scores need, so they are summed where it is, and each task passes
on only what can be among the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from bundlewright.durable import written
from bundlewright.functions.paths import path_parts
from bundlewright.functions.text import tokens, unique_tokens
from bundlewright.operators import retrieval

#: Distinct terms that are looked up within the rows, and pairs of query and term that tasks get; queries with more are joined with postings.
TERMS, PAIRS = 10_000, 200_000
#: Postings times queries that are added up at a time.
CELLS = 1 << 20
PLACE = ("chunk_id", "file", "start_line", "end_line", "token_est")


@dataclass
class Asked:
    """Queries by their terms: those of term ``k`` are ``owners[first[k] : first[k + 1]]``, places in ``ids``."""

    ids: pa.Array
    kind: str
    terms: list[str]
    first: np.ndarray
    owners: np.ndarray

    def matches(self, hits: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of each distinct term of each row."""
        sizes = hits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(hits.flatten(), value_set=pa.array(self.terms, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(self.terms) + found, return_counts=True)
        return *np.divmod(keys, max(1, len(self.terms))), times

    def sums(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, sum of weights) of each of ``n`` rows and each query that have a term in common."""
        each = np.diff(self.first)[terms]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each - self.first[terms], each)
        keys, weights = np.repeat(rows, each) * len(self.ids) + self.owners[at], np.repeat(weights, each)
        if n * len(self.ids) <= 4 * CELLS:
            whole = np.bincount(keys, weights, n * len(self.ids))
            keys = np.flatnonzero(whole)
            return *np.divmod(keys, max(1, len(self.ids))), whole[keys]
        keys, same = np.unique(keys, return_inverse=True)
        return *np.divmod(keys, len(self.ids)), np.bincount(same, weights)

    def parts(self, hits: pa.Array) -> Iterator[tuple[int, int]]:
        """From, to: rows whose sums fit in memory."""
        sizes = np.cumsum(hits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * max(1, -(-len(self.owners) // max(1, len(self.terms))))
        at = 0
        while at < len(sizes):
            to = max(at + 1, min(at + max(1, 4 * CELLS // max(1, len(self.ids))), int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CELLS, side="right"))))
            yield at, to
            at = to


def asked(queries: DataFrame) -> Asked | None:
    """The queries (query_id, query) in a form that tasks get; none if they are too many for that."""
    pairs = retrieval.query_terms(queries).distinct().limit(PAIRS + 1).collect()
    by: dict[str, list] = {}
    for row in pairs:
        by.setdefault(row["term"], []).append(row["query_id"])
    if len(pairs) > PAIRS or len(by) > TERMS:
        return None
    terms = sorted(by)
    places = {q: k for k, q in enumerate(dict.fromkeys(q for t in terms for q in by[t]))}
    kind = queries.schema["query_id"].dataType
    first = np.cumsum([0, *(len(by[t]) for t in terms)])
    return Asked(pa.array(list(places), to_arrow_type(kind)), kind.simpleString(), terms, first, np.array([places[q] for t in terms for q in by[t]], dtype=np.int64))


def _those(words: str, terms: list[str]) -> Column:
    """Of an array of tokens those that are terms, a set of literals. Written as SQL, as each is a call to the JVM else; tokens have no quotes."""
    quoted = ", ".join(f"'{t}'" for t in terms)
    return F.expr(f"filter({words}, t -> t IN ({quoted}))") if terms else F.slice(words, 1, 0)


def hits(chunks: DataFrame, some: Asked) -> DataFrame:
    """The place of each chunk with a token, its number of tokens ``dl``, and those of the queries, repeats kept, in ``hits``; written once."""
    words = chunks.select(*PLACE, tokens(F.col("text")).alias("all"))
    return written(words.select(*PLACE, F.size("all").alias("dl"), _those("all", some.terms).alias("hits"))).where("dl > 0")


@dataclass
class Weights:
    """Of each term the inverse frequency; the mean length."""

    idf: np.ndarray
    avgdl: float

    def of(self, terms: np.ndarray, times: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """As ``retrieval.bm25_weight``."""
        return self.idf[terms] * (times * (retrieval.K1 + 1)) / (times + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl / self.avgdl))


def weights(table: DataFrame, some: Asked) -> Weights:
    """From the whole table of ``hits``."""
    n, total = table.agg(F.count(F.lit(1)), F.sum("dl")).first()
    found = table.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").count().collect()  # no more than the queries' terms
    in_chunks = {r["term"]: r["count"] for r in found}
    df = np.array([in_chunks.get(t, 0) for t in some.terms], dtype=float)
    return Weights(np.log((n - df + 0.5) / (df + 0.5) + 1), max(1.0, (total or 0) / max(1, n)))


class Best:
    """The least score that can still be among each query's best ``k``, of the rows so far."""

    #: Scores are compared rounded, to six digits.
    NEAR = 2e-6

    def __init__(self, k: int, queries: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.queries, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0)

    def keep(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Places of the rows that may be among them."""
        own, given = queries, scores
        kept = np.flatnonzero(scores >= self.least[queries] - self.NEAR)
        queries, scores = np.concatenate([self.queries, queries[kept]]), np.concatenate([self.scores, scores[kept]])
        order = np.lexsort((-scores, queries))
        queries, scores = queries[order], scores[order]
        place = np.arange(len(queries)) - np.searchsorted(queries, queries)
        last = place == self.k - 1
        self.least[queries[last]] = scores[last]
        self.queries, self.scores = queries[place < self.k], scores[place < self.k]
        return kept[given[kept] >= self.least[own[kept]] - self.NEAR]


def scores(chunks: DataFrame, queries: DataFrame, topk: int | None = None, files: DataFrame | None = None) -> DataFrame | None:
    """(query_id, place of the chunk, score) of each chunk with a term of the query; none if the queries are too many.

    With ``topk``, of each task only those that can be among a query's best. Statistics are those of all chunks, even if ``files`` (file) leaves few.
    """
    some = asked(queries)
    if some is None:
        return None
    table = hits(chunks, some)
    weight = weights(table, some)
    if files is not None:
        table = table.join(retrieval.sized(files.select("file").distinct()), "file", "left_semi").select(table.columns)
    names = ["query_id", *PLACE, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None if topk is None else Best(topk, len(some.ids))
        for batch in batches:
            for at, to in some.parts(batch.column("hits")):
                part = batch.slice(at, to - at)
                rows, terms, times = some.matches(part.column("hits"))
                each = weight.of(terms, times, part.column("dl").to_numpy()[rows])
                rows, of, score = some.sums(rows, terms, each, len(part))
                if best is not None:
                    kept = best.keep(of, score)
                    rows, of, score = rows[kept], of[kept], score[kept]
                places = pa.array(rows)
                yield pa.RecordBatch.from_arrays([some.ids.take(pa.array(of)), *(part.column(c).take(places) for c in PLACE), pa.array(score)], names)

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in PLACE)
    return table.mapInArrow(run, f"query_id {some.kind}, {kinds}, score double")


def top_chunks(chunks: DataFrame, queries: DataFrame, topk: int, files: DataFrame | None = None) -> DataFrame | None:
    """As ``retrieval.top_chunks``; none if the queries are too many."""
    k = max(topk, retrieval.LEAST_TOP)
    found = scores(chunks, queries, k, files)
    if found is None:
        return None
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), path_parts(F.col("file")), "start_line", "chunk_id")
    return found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).select("query_id", "i", *PLACE, "score")


def prescreen(files: DataFrame, queries: DataFrame) -> DataFrame | None:
    """As ``retrieval.prescreen``, from files (file, content); none if the queries are too many.

    The tokens of a name that several files have are put together.
    """
    some = asked(queries)
    if some is None:
        return None
    words = files.select("file", tokens(F.col("content")).alias("all"))
    few = words.select("file", (F.size("all") > 0).alias("full"), F.array_distinct(_those("all", some.terms)).alias("hits"))
    table = written(few.groupBy("file").agg(F.max("full").alias("full"), F.flatten(F.collect_list("hits")).alias("hits"))).where("full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in some.parts(batch.column("hits")):
                part = batch.slice(at, to - at)
                rows, terms, times = some.matches(part.column("hits"))
                rows, of, _ = some.sums(rows, terms, times.astype(float), len(part))
                yield pa.RecordBatch.from_arrays([some.ids.take(pa.array(of)), part.column("file").take(pa.array(rows))], ["query_id", "file"])

    found = table.select("file", "hits").mapInArrow(run, f"query_id {some.kind}, file string")
    blank = queries.select("query_id", F.size(unique_tokens(F.col("query"))).alias("n")).where("n = 0").select("query_id").distinct()
    return found.unionByName(table.select("file").crossJoin(blank).select("query_id", "file"))
