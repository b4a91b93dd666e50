import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlewright.errors import IndexFormatError, SourceError
from bundlewright.operators import retrieval, selection
from bundlewright.operators.index import Index, build_index
from bundlewright.plans.engine import Engine, as_text
from bundlewright.sources import files as sources
from bundlewright.streaming.watch import watch

CORPUS = [
    ("auth.rs", "fn authenticate(session) {\n    verify(token)\n}\n"),
    ("render.rs", "fn draw(frame) {\n    blit(pixels)\n}\n"),
    ("session.rs", "fn open_session() {\n    token session\n}\n"),
    ("blank.rs", "a b\n"),
    ("copy/auth.rs", "fn authenticate(session) {\n    verify(token)\n}\n"),
]


def build(spark, rows=CORPUS, **how):
    return build_index(spark.createDataFrame(rows, "file string, content string"), **how)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(build(spark))


def test_scores_are_those_of_the_formula(spark, engine):
    tokens = {f: [w for w in __import__("re").split(r"\W+", t.lower()) if len(w) >= 3] for f, t in CORPUS}
    tokens = {f: t for f, t in tokens.items() if t}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    want = {}
    for f, t in tokens.items():
        for w in {"session", "token", "draw"}:
            if tf := t.count(w):
                idf = math.log((len(tokens) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                want[f] = want.get(f, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    scores = retrieval.bm25_scores(engine.index, ask(spark, "Session TOKEN draw session xy"))
    got = {r.file: r.score for r in scores.join(engine.index.chunks, "chunk_id").collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)
    assert engine.index.stats().first().asDict() == {"n_files": 4, "n_chunks": 5, "n_docs": 4, "avgdl": round(mean, 6), "vocabulary": len(df), "n_signatures": 4}


def test_order_cutoff_and_limits(spark, engine):
    top = engine.ranked(ask(spark, "authenticate session token")).orderBy("i").collect()
    assert [r.file for r in top] == ["auth.rs", "copy/auth.rs", "session.rs"] and top[0].rel == 1.0  # a tie by path
    assert [r.file for r in engine.ranked(ask(spark, "authenticate session token"), min_ratio=0.9).orderBy("i").collect()] == ["auth.rs", "copy/auth.rs"]
    assert engine.ranked(ask(spark, "authenticate session token"), min_ratio=1.5).count() == 0
    many = Engine(build(spark, [(f"f{i:02}", "same words here") for i in range(20)]))
    assert many.ranked(ask(spark, "words"), topk=5).count() == 10 and many.ranked(ask(spark, "words"), topk=12).count() == 12


def test_no_token_no_result_but_every_file(spark, engine):
    assert engine.search(ask(spark, "a b c", "")).count() == 0
    assert retrieval.prescreen(ask(spark, "a b", "draw"), engine.index.file_terms).groupBy("query_id").count().collect().__len__() == 2
    assert retrieval.prescreen(ask(spark, "a b"), engine.index.file_terms).count() == 4


def test_select_only_within_files(spark, engine):
    files = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    query = ask(spark, "authenticate session token")
    assert {r.file for r in engine.select(query, files("auth.rs")).collect()} == {"auth.rs"}
    assert engine.select(query, files()).count() == 0 and engine.select(query, files("./auth.rs")).count() == 0
    whole = {r.file: r.score for r in engine.ranked(query).collect()}
    assert all(abs(r.score - whole[r.file]) < 1e-12 for r in engine.ranked(query, files=files("auth.rs", "session.rs")).collect())


def test_prescreen_never_changes_a_search(spark, engine):
    for text in ("session", "draw pixels", "nothing matches"):
        query = ask(spark, text)
        some = retrieval.prescreen(query, engine.index.file_terms).select("file")
        assert sorted(map(tuple, engine.ranked(query).select("i", "chunk_id").collect())) == sorted(map(tuple, engine.ranked(query, files=some).select("i", "chunk_id").collect()))


def test_save_load_and_checks(spark, engine, tmp_path):
    path = str(tmp_path / "index")
    engine.index.save(path)
    query = ask(spark, "session token")
    want = sorted(map(tuple, engine.search(query).collect()))
    assert sorted(map(tuple, Engine.load(spark, path).search(query).collect())) == want
    engine.index.save(path)
    assert Engine.load(spark, path).search(query).count() == len(want)
    engine.index.save(path)
    versions = lambda: sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith(("v-", "manifest")))
    assert len(versions()) == 4 and versions()[:2] == ["manifest-00000002.json", "manifest-00000003.json"]
    plan = retrieval.bm25_scores(Index.load(spark, path), query)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    for broken in ("{", '{"format": "other"}', "[]"):
        (tmp_path / "index" / "manifest-00000009.json").write_text(broken)
        with pytest.raises(IndexFormatError):
            Index.load(spark, path)
    with pytest.raises(IndexFormatError):
        Index.load(spark, str(tmp_path / "nowhere"))


def test_saved_tables_are_those_of_the_plans(spark, engine, tmp_path):
    for syntax in (True, False):
        made = build(spark, [*CORPUS, ("u.py", "import os\n\ndef one():\n    return outside_of_units\n\nloose_words = 1\n")], syntax=syntax, slots=16)
        made.save(str(tmp_path / str(syntax)))
        saved = Index.load(spark, str(tmp_path / str(syntax)))
        for name in ("chunks", "postings", "term_stats", "doc_stats", "corpus_stats", "file_terms", "minhash"):
            want = getattr(made, name)
            assert sorted(map(str, getattr(saved, name).select(*want.columns).collect())) == sorted(map(str, want.collect())), name


def test_relevant_chunks(spark, monkeypatch):
    from bundlewright.operators import evaluation

    monkeypatch.setattr(evaluation, "NEEDLES", 2)
    chunks = spark.createDataFrame([(1, "Some TEXT here"), (2, "other"), (3, None), (4, "")], "chunk_id long, text string")
    golden = spark.createDataFrame([(1, ["text", "her"]), (2, ["zzz"]), (3, [""]), (4, ["the", "ther", "text"]), (5, None)], "query_id long, needles array<string>")
    assert sorted(map(tuple, evaluation.relevant_chunks(golden, chunks).collect())) == [(1, 1), (1, 2), (3, 1), (3, 2), (3, 4), (4, 1), (4, 2)]
    ranks = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.0, 0.25)], "query_id long, recall double, reciprocal_rank double")
    assert tuple(evaluation.mean_metrics(ranks, spark.createDataFrame([(1, 0.9)], "query_id long, diversity double")).first()) == (2, 0.25, 0.625, 0.9)


def test_serve(spark, engine):
    lines = ['{"query": "session token", "topk": 20}', "not json", "", '{"budget": 5}', '{"query": "zzz"}']
    got = {r.request_id: json.loads(r.response) for r in engine.serve(spark.createDataFrame(list(enumerate(lines)), "request_id long, line string")).collect()}
    assert set(got) == {0, 1, 3, 4} and "error" in got[1] and "error" in got[3] and got[4] == {"results": []}
    assert list(got[0]["results"][0]) == ["file", "start_line", "end_line", "score", "text"]


def test_text_sink(spark, engine):
    lines = [r.line for r in as_text(engine.search(ask(spark, "draw pixels"))).collect()]
    assert lines == ["render.rs:1-3  score=1.000"]


CASES = [
    ([1.0, 0.8, 0.6, 0.9, 0.5], [100, 200, 150, 250, 100], {}, 400, 1.0, 0.01),
    ([0.9, 0.85, 0.7], [100] * 3, {(0, 1): 0.95}, 250, 2.0, 0.01),
    ([1.0, 0.6], [100, 50], {}, 100, 1.0, 0.0001),
]


def matrix(n, pairs):
    sim = np.zeros((n, n))
    for (i, j), s in pairs.items():
        sim[i, j] = sim[j, i] = s
    return sim


def test_annealing_on_known_problems():
    chosen = [selection.anneal(np.array(r), matrix(len(r), p), np.array(t), b, lam, mu) for r, t, p, b, lam, mu in CASES]
    assert np.array(CASES[0][1])[chosen[0]].sum() <= 450
    assert not (chosen[1][0] and chosen[1][1]) and chosen[1].sum() == 2
    assert chosen[2].all()


def test_annealing_against_all_choices():
    rng, gaps = random.Random(1), []
    for _ in range(25):
        n = rng.randint(1, 10)
        rel, tok = np.array([rng.random() for _ in range(n)]), np.array([rng.randint(50, 900) for _ in range(n)])
        sim = matrix(n, {(i, j): rng.random() for i in range(n) for j in range(i + 1, n)})
        x = selection.anneal(rel, sim, tok, 1000)
        assert (x == selection.anneal(rel, sim, tok, 1000)).all()
        e = selection.value(rel, sim, tok, x, 1000)
        assert e <= selection.value(rel, sim, tok, selection.first_fit(rel, tok, 1000), 1000)
        gaps.append(e - min(selection.value(rel, sim, tok, np.array([m >> k & 1 for k in range(n)], dtype=bool), 1000) for m in range(1 << n)))
    assert max(gaps) < 0.15 and np.mean(gaps) < 0.01


def test_greedy_energy_and_exact_in_sql(spark):
    items = spark.createDataFrame([(7, 1, 1.0, 600), (7, 2, 0.8, 500), (7, 3, 0.5, 300), (8, 1, 1.0, 2000)], "query_id long, i int, rel double, tok int")
    pairs = spark.createDataFrame([(7, 1, 2, 0.5), (7, 1, 3, 0.2), (7, 2, 3, 0.0)], "query_id long, i int, j int, sim double")
    chosen = selection.greedy(items, 1000)
    assert {(r.query_id, r.i) for r in chosen.where("chosen").collect()} == {(7, 1), (7, 3)}
    got = {r.query_id: r.energy for r in selection.energy(chosen, pairs, 1000).collect()}
    assert abs(got[7] - (-1.5 + 0.5 * 0.2)) < 1e-9 and got[8] == 0.0
    best = {r.query_id: (r.mask, r.energy) for r in selection.exact(items, pairs, 3, 1000).collect()}
    assert best[7] == (5, -1.4) and best[8] == (0, 0.0)


def test_tree(spark, tmp_path):
    for name, data in {
        "src/auth/Login.ts": b"x", "node_modules/react/index.js": b"x", "dist/bundle.js": b"x", "target/debug/x.rs": b"x",
        "src/bad.rs": b"\xff\xfe", "src/empty.rs": b"", "src/gen_a.rs": b"x", "src/B.RS": b"y", "README": b"z",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = lambda *a: sorted(r.file for r in sources.read_tree(spark, str(tmp_path), *a).collect())
    assert read(["ts", "js", "rs"]) == ["src/B.RS", "src/auth/Login.ts", "src/gen_a.rs"]
    assert read([""], ["gen_*", "README"]) == ["src/B.RS", "src/auth/Login.ts"]
    with pytest.raises(SourceError):
        sources.read_tree(spark, str(tmp_path / "README"))


def test_lists_and_golden(spark, tmp_path):
    (tmp_path / "paths").write_text(" a.rs \n\nb.rs\na.rs\n")
    assert sorted(r.file for r in sources.read_path_list(spark, str(tmp_path / "paths")).collect()) == ["a.rs", "b.rs"]
    (tmp_path / "golden.tsv").write_text("# note\n\nfind tokens\tTokenize, split\ta.rs,b.rs\nother\tx\n")
    rows = {r["query"]: (r.needles, r.files) for r in sources.read_golden(spark, str(tmp_path / "golden.tsv")).collect()}
    assert rows == {"find tokens": (["tokenize", "split"], ["a.rs", "b.rs"]), "other": (["x"], [])}


def test_synthetic(spark):
    rows = sources.synthetic_chunks(spark, 105).collect()
    assert len({r.chunk_id for r in rows}) == 105 and Counter(r.file for r in rows)["synth/file_000001.rs"] == 65
    index = Index(*(None,) * 7)
    assert index.chunks is None


def test_watch_builds_and_follows(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    root.mkdir()
    (root / "a.rs").write_text("fn first_one() {}\n")
    for name in ("b", "c"):
        watch(spark, str(root), str(out), str(tmp_path / "state"), once=True).awaitTermination()
        (root / f"{name}.rs").write_text(f"fn later_{name}() {{}}\n")
    watch(spark, str(root), str(out), str(tmp_path / "state"), once=True).awaitTermination()
    found = Engine.load(spark, str(out)).search(ask(spark, "later_c"))
    assert [r.file for r in found.select(F.col("file")).collect()] == ["c.rs"]


def test_served_scores_have_the_digits_of_sql(spark, tmp_path, monkeypatch):
    from bundlewright.plans import catalogue

    spark.createDataFrame([(1, "any")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    results = [{"file": "a", "start_line": 1, "end_line": 2, "score": x, "text": "four"} for x in (0.8125, 0.1235, 0.0625, 1.0)]
    monkeypatch.setattr(catalogue, "plan", lambda *_: Index(*(None,) * 7))
    monkeypatch.setattr(Engine, "serve", lambda *_: spark.createDataFrame([(1, json.dumps({"results": results}))], "request_id long, response string"))
    row = catalogue.serve_json(spark, str(tmp_path)).first()
    assert row.results == "; ".join(f"a:1-2 {r['score']:.3f}" for r in results) and (row.n_results, row.n_chars) == (4, 16)
