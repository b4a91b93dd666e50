import random

import duckdb
import numpy as np

from bundlewright.llm import language_id, quality_rules


def test_quality_rules_against_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        kind = i % 6
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "it"]) + str(rng.randrange(60)) for _ in range(rng.randint(1, 60))]
        text = [" ".join(words), " | ".join(words), "!! ".join(words).upper(), "same line\n" * 9, "", " ".join(["word"] * 30)][kind] if i % 5 else " ".join(words) + "."
        rows.append((i, text, [f"h{i % 7}", f"https://www.Site{i % 3}.org:80/p?{i}"][i % 2] if kind != 4 else None, "x", i, i % 2 == 0))
    rows += [(900, None, "h1", "x", 0, True), (1, rows[1][1], rows[1][2], "x", 0, None), (None, "a b c d", "h1", None, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, _q_host long, _Q_keep boolean")
    got = sorted((r.doc_id or -1, r.host, r.n_words, r.failed_rules, round(r.host_worst_rate, 6), r.host_bad, r.keep) for r in quality_rules.assess(df).collect())
    df.write.parquet(str(tmp_path / "d"))
    found = duckdb.connect()
    found.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted((a or -1, b, c, d, round(e, 6), f, g) for a, b, c, d, e, f, g in found.execute(quality_rules.sql()).fetchall())
    assert got == want
    left = quality_rules.accepted(df)
    kept = left.collect()
    assert left.columns == df.columns and sorted(r.doc_id or -1 for r in kept) == sorted(r[0] for r in got if r[6]) and set(kept) <= set(df.collect())
    assert {r[1] for r in got} == {f"h{k}" for k in range(7)} | {f"site{k}.org" for k in range(3)} | {"(none)"}
    assert quality_rules.assess(df.limit(0)).count() == 0 and quality_rules.accepted(df.limit(0)).count() == 0


def test_few_documents_of_a_host_say_little(spark):
    rows = [(i, "x y", "one") for i in range(1)] + [(i + 10, "x y", "bad") for i in range(200)] + [(i + 500, "a clean text of many words", f"h{i % 20}") for i in range(800)]
    rates = {(r.host, r.rule): r.rate for r in quality_rules.host_rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert rates["bad", "short"] > 0.9 > rates["one", "short"] and rates["h1", "short"] < 0.2


def test_clean_texts_of_any_length_pass(spark):
    """Words drawn as in natural text (by the inverse of their rank), from 50 words to half a million, of over 2 MB."""
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 200_001) ** 1.1
    words = np.array([f"{'abcdefghij'[k % 10]}{k:x}" for k in range(200_000)])
    rows = [(n, " ".join(rng.choice(words, n, p=share / share.sum())), "h") for n in (50, 500, 5_000, 100_000, 500_000)]
    rows += [(-n, " ".join(["same few words here again"] * n), "h") for n in (10, 1_000, 100_000)]
    got = {r.doc_id: r for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(("repeated_words" in r.failed_rules) == (k < 0) for k, r in got.items()) and got[500_000].n_words == 500_000


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit = docs.where("doc_id % 2 = 0")
    model = language_id.train(fit)
    held = docs.where("doc_id % 2 = 1 and n_chars > 40").select("doc_id", "text", "lang")
    got = language_id.identify(held, model).withColumnRenamed("lang", "told").join(held, "doc_id").collect()
    assert np.mean([r.told == r.lang for r in got]) > 0.98
    sure = np.mean([r.confidence for r in got])
    assert abs(sure - np.mean([r.told == r.lang for r in got])) < 0.05
    assert len(model.features) < (model.idf < model.idf.max()).sum()  # some features that were met have no weight


def test_language_cases(spark):
    schema = "doc_id long, text string, lang string, confidence string"
    rows = [(i, f"the quick brown fox {i} jumps over", "en", "x") for i in range(60)] + [(100 + i, f"der schnelle braune fuchs {i} springt über", "de", "x") for i in range(60)]
    rows += [(900, None, "en", "x"), (901, "", None, "x"), (902, "123 !!", "de", "x"), (1, rows[1][1], "en", "x"), (None, rows[0][1], "en", "x"), (903, "kurz", None, "x"), (904, "the quick fox " * 200_000, None, "x")]
    df = spark.createDataFrame(rows, schema)
    model = language_id.train(df)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert got[0].lang == "en" and got[100].lang == "de" and got[0].keep and got[100].keep
    assert all((got[k].lang, got[k].confidence, got[k].keep) == ("und", 0.0, False) for k in (900, 901, 902))
    assert got[903].keep and got[904].keep and got[904].lang == "en"
    left = language_id.accepted(df, model)
    assert left.columns == df.columns and left.count() == len(rows) - 3
    empty = spark.createDataFrame([], schema)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None, "x")], schema)
    assert language_id.accepted(unlabelled, language_id.train(unlabelled)).count() == 1


def brute_grams(text):
    """Counts of letter 1-, 2- and 3-grams as strings, a gap as a blank."""
    import re
    import unicodedata
    from collections import Counter

    t = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    t = re.sub(" +", " ", f" {t} ")
    return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n].strip())


def test_features_are_the_grams_of_the_text():
    texts = ["The quick, quick FOX", "", None, "a", "éa  日本語 b2b", "?!", "мир и ток", "हिन्दी भाषा", "x" * 50]
    feature, count, first = language_id.grams(texts)
    known = {}
    for i, t in enumerate(texts):
        want = brute_grams(t or "")
        assert sorted(count[first[i] : first[i + 1]]) == sorted(want.values())
        for g in want:
            own, n, _ = language_id.grams([g]) if len(g) == 3 and " " not in g else (None, None, None)
            if own is not None:
                known[g] = set(own)
                assert known[g] <= set(feature[first[i] : first[i + 1]]) | set(language_id.grams([f" {g}"])[0])
    a, b = (set(language_id.grams([t])[0]) for t in ("мир", "ток"))
    assert not a & b


def test_fit_is_that_of_the_formulas():
    """FTRL with elastic net over dictionaries, one coordinate at a time, and a search of temperatures."""
    import math
    from collections import Counter, defaultdict

    texts = [f"{w} some text" for w in ("alpha one", "beta two", "alpha six", "gamma ten", "beta one", "alpha two", "gamma six", "beta ten", "alpha ten", "gamma two")]
    labels = [t[0] for t in texts]
    df = Counter(f for t in texts for f in set(language_id.grams([t])[0].tolist()))
    idf = np.ones(1 << language_id.BITS, dtype=np.float32)
    for f, n in df.items():
        idf[f] = math.log(11 / (1 + n)) + 1
    vectors = []
    for t in texts:
        f, c, _ = language_id.grams([t])
        x = {a: (1 + math.log(b)) * float(idf[a]) for a, b in zip(f.tolist(), c.tolist())}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors.append({a: v / norm for a, v in x.items()} | {"bias": 1.0})
    z, n = defaultdict(float), defaultdict(float)
    classes = sorted(set(labels))

    def weight(f, k):
        l1, l2 = (0, 0) if f == "bias" else (language_id.L1, language_id.L2)
        v = z[f, k]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((language_id.BETA + math.sqrt(n[f, k])) / language_id.ALPHA + l2)

    for _ in range(language_id.EPOCHS):
        for i, x in enumerate(vectors):
            if i % 5 == 4:
                continue
            w = {(f, k): weight(f, k) for f in x for k in classes}
            score = {k: sum(v * w[f, k] for f, v in x.items()) for k in classes}
            total = sum(math.exp(s) for s in score.values())
            for k in classes:
                for f, v in x.items():
                    g = v * (math.exp(score[k]) / total - (labels[i] == k))
                    sigma = (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / language_id.ALPHA
                    z[f, k] += g - sigma * w[f, k]
                    n[f, k] += g * g
    model = language_id.fit(language_id.Model(idf), texts, labels)
    got = {(f, k): model.weights[i, j] for i, f in enumerate(model.features.tolist()) for j, k in enumerate(classes)}
    for f in {f for f, _ in z} - {"bias"}:
        assert all(abs(got.get((f, k), 0.0) - weight(f, k)) < 1e-6 for k in classes)
    assert all(abs(model.bias[j] - weight("bias", k)) < 1e-6 for j, k in enumerate(classes))
    held = [4, 9]
    feature, x, first = model.vectors(texts)
    loss = language_id.cross_entropy(model.logits(feature, x, first)[held], np.array([classes.index(labels[i]) for i in held]))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 2_001))
    assert abs(np.log(model.temperature) - np.log(min(grid, key=lambda t: loss(np.log(t))))) < 0.01


def test_two_languages_of_one_script(spark):
    """Words of one length in Cyrillic, told apart by their letters."""
    rng = random.Random(7)
    words = {"ru": ["это", "что", "был", "она", "они", "ещё", "где", "мой", "эти", "ыло"], "uk": ["цей", "той", "був", "вже", "які", "їхн", "ґед", "моє", "між", "інш"]}
    rows = [(i, " ".join(rng.choices(words[k], k=12)), k) for i in range(400) for k in [("ru", "uk")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).collect()
    assert np.mean([r.lang == rows[r.doc_id][2] for r in got]) > 0.99 and all(r.keep for r in got)
