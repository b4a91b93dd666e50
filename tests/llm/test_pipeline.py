import corpus_pipeline
from bundlewright.llm import language_id, near_duplicates, packing, quality_rules, repeats


def test_run_is_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    told = language_id.accepted(docs, language_id.train(docs))
    good = quality_rules.accepted(told)
    one = near_duplicates.unique(good)
    short = repeats.cut_out(one)
    assert short.columns == one.columns == docs.columns
    assert docs.count() >= told.count() > good.count() > one.count() > 0
    want = packing.pack_documents(short)
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_good_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and toxic = 0")
    good = docs.join(labels, "doc_id", "left_semi")
    kept = quality_rules.accepted(language_id.accepted(docs, language_id.train(docs)))
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_any_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, names that operators use themselves, and no rows at all."""
    texts = ["the quick brown fox jumps over the lazy dog number {} and goes on to the river", "der schnelle braune fuchs nummer {} springt über den faulen hund am fluss"]
    rows = [(i, texts[i % 2].format(i * 7919), ("en", "de")[i % 2], f"src{i % 3}", 80, "k", 1, True) for i in range(60)]
    long = " ".join(f"word{i * 7919 % 99991} and then" for i in range(90_000))  # over 2 MB
    passage = " ".join(f"p{i * 31 % 997}" for i in range(60))
    rows += [(100, long, "en", "src0", len(long), "k", 1, True), (101, None, None, None, None, None, None, None), (102, "", "en", "src1", 0, "k", 2, False), (103, "123 !!", "en", "src1", 6, "k", 2, False)]
    own = [" ".join(f"the{k}fox{i * 37 % 101}" for i in range(90)) for k in range(2)]
    rows += [(104, own[0] + " " + passage, None, None, None, None, None, None), (105, passage + " " + own[1], "en", "src2", None, None, 3, None)]
    rows += [rows[0], rows[0], (None, rows[1][1], "de", "src1", 80, "k", 1, True), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _cut_key string, _near_gone long, _q_keep boolean"
    df = spark.createDataFrame(rows, schema)
    for name, data in (("some", df), ("none", df.limit(0))):
        data.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = data
        for stage, run in corpus_pipeline.STAGES[:-1]:
            docs = run(spark, docs, str(tmp_path / name))
            docs.write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
            assert docs.columns == df.columns
            if name == "some" and stage != "repeats":
                assert set(map(tuple, docs.collect())) <= set(rows)
        got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert (len(got) > 0) == (name == "some") and sum(r.n_tokens for r in got if r.doc_id == 100) > 100_000 * (name == "some")
        ids = [r.doc_id for r in docs.collect()]
        assert name == "none" or (ids.count(0) == 1 and not {101, 102, 103} & set(ids) and {104, 105, 100} <= set(ids))
