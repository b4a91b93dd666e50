import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bundlewright.operators import retrieval, scan
from bundlewright.operators.index import Index, build_index
from bundlewright.plans import catalogue
from bundlewright.plans.engine import Engine

WORDS = [f"w{i:03}" for i in range(60)]


def text(rng, n):
    return "\n".join(" ".join(rng.choices(WORDS, k=6)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Files of one to three windows, many of them copies, so that ties are more than the best; a query without tokens, one asked twice, one of unknown words."""
    rng = random.Random(3)
    kinds = [text(rng, rng.randint(1, 90)) for _ in range(12)]
    files = [(f"d{i % 3}/f{i}", kinds[i % 12] if i < 150 else text(rng, 9)) for i in range(190)] + [("blank", "a b"), ("none", None)]
    queries = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(20)] + [(20, "a b"), (21, "unknown words"), (22, "w001 W001"), (22, "w001")]
    return spark.createDataFrame(files, "file string, content string"), spark.createDataFrame(queries, "query_id long, query string")


def test_scores_and_order_are_those_of_postings(corpus):
    files, queries = corpus
    index, once = build_index(files, syntax=False), queries.dropDuplicates(["query_id"])
    some = files.where("file like 'd1/%'")
    for own, allowed in ((None, None), (some, retrieval.chunks_of(index.chunks, some))):
        want = retrieval.bm25_scores(index, once, allowed)
        rows = lambda df: {(r.query_id, r.chunk_id): round(r.score, 9) for r in df.collect()}
        assert rows(scan.scores(index.chunks, queries, files=own)) == rows(want)
        for k in (10, 25):
            places = lambda df: sorted(map(tuple, df.select("query_id", "i", "chunk_id", "file", "start_line", "end_line", "token_est").collect()))
            assert places(scan.top_chunks(index.chunks, queries, k, own)) == places(retrieval.top_chunks(want, index.chunks, k))


def test_files_that_may_answer(corpus):
    files, queries = corpus
    files = files.unionByName(files.where("file = 'd0/f0'").withColumn("content", F.lit("w001 only")))
    want = {tuple(r) for r in retrieval.prescreen(queries, build_index(files, syntax=False).file_terms).collect()}
    got = [tuple(r) for r in scan.prescreen(files, queries).collect()]
    assert set(got) == want and len(got) == len(want)


def test_too_many_queries_are_left_to_postings(corpus, monkeypatch):
    files, queries = corpus
    engine = Engine(build_index(files, syntax=False))
    want = sorted(map(str, engine.ranked(queries.where("query_id < 22")).select("query_id", "i", "chunk_id").collect()))
    monkeypatch.setattr(scan, "TERMS", 3)
    assert scan.asked(queries) is None
    assert sorted(map(str, engine.ranked(queries.where("query_id < 22")).select("query_id", "i", "chunk_id").collect())) == want


def test_sums_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    terms, owners = [f"t{i}" for i in range(9)], [sorted(rng.choice(7, size=rng.integers(0, 5), replace=False)) for _ in range(9)]
    some = scan.Asked(pa.array(range(7), pa.int64()), "bigint", terms, np.cumsum([0, *map(len, owners)]), np.array([q for o in owners for q in o], dtype=np.int64))
    lists = [[f"t{k}" for k in rng.integers(0, 9, rng.integers(0, 30))] for _ in range(50)]
    want = Counter()
    for r, words in enumerate(lists):
        for w in words:
            want.update({(r, int(q)): 1 for q in owners[int(w[1:])]})
    for cells in (1, 20, 1 << 20):
        monkeypatch.setattr(scan, "CELLS", cells)
        got, hits = {}, pa.array(lists, pa.list_(pa.string()))
        for at, to in some.parts(hits):
            rows, found, times = some.matches(hits.slice(at, to - at))
            got |= {(at + int(r), int(q)): s for r, q, s in zip(*some.sums(rows, found, times.astype(float), to - at))}
        assert got == want


def test_the_best_are_kept_of_every_part():
    rng = np.random.default_rng(2)
    of, scores = rng.integers(0, 4, 3000), np.round(rng.random(3000), 2)
    best, kept = scan.Best(5, 4), []
    for at in range(0, 3000, 100):
        kept += [at + k for k in best.keep(of[at : at + 100], scores[at : at + 100])]
    for q in range(4):
        least = np.sort(scores[of == q])[-5]
        assert set(np.flatnonzero((of == q) & (scores >= least))) <= set(kept)
    assert len(kept) < 1000


def same_rows(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    result = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = Counter(result.fetchall())
    assert Counter(map(tuple, catalogue.QUERIES[name](spark, small).select(*columns).collect())) == want


#: Each is a batch of queries over files without an index.
BATCHES = ["mean_metrics", "jaccard_est", "qubo_exact", "result_summary", "recall_mrr", "bm25_topn", "score_cutoff", "qubo_energy", "similarity_pairs", "search_bundle", "prescreen_candidates", "diversity", "jaccard_exact", "bm25_score", "greedy_select", "select_files", "serve_json", "result_lines"]


@pytest.mark.parametrize("name", BATCHES)
def test_a_batch_builds_no_index(spark, small, name, monkeypatch):
    def never(*_):
        raise AssertionError("all tokens are shuffled for one batch")

    monkeypatch.setattr(Index, "save", never)
    monkeypatch.setattr(retrieval, "bm25_scores", never)
    same_rows(spark, small, name)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["tokenize_tf", "doc_len"])
def test_terms_are_counted_without_a_shuffle(spark, small, name):
    assert exchanges(catalogue.QUERIES[name](spark, small)) == 0
    same_rows(spark, small, name)


def test_stats_take_one_pass(spark, small, corpus):
    plan = catalogue.index_stats(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    same_rows(spark, small, "index_stats")
    same_rows(spark, small, "term_df")
    assert tuple(build_index(corpus[0].limit(0), syntax=False).stats().first()) == (0, 0, 0, 1.0, 0, 0)


def test_signatures_are_made_once_without_a_shuffle(spark, small):
    made = catalogue.minhash_sig(spark, small)
    assert exchanges(made) == 0 and made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    same_rows(spark, small, "minhash_sig")
