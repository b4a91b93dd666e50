from pyspark.sql import functions as F

from bundlewright import functions as fn
from bundlewright.functions import paths


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_tokens_by_bytes_before_lower_case(spark):
    text = "né ab日c _x_ snake_case CamelCase a1 ABC don't 日 é"
    assert one(spark, fn.tokens(F.col("t")), t=text) == ["né", "ab日c", "_x_", "snake_case", "camelcase", "abc", "don", "日"]
    assert one(spark, fn.tokens(F.col("t")), t="ab ab cde cde") == ["cde", "cde"] and one(spark, fn.unique_tokens(F.col("t")), t="cde cde") == ["cde"]
    assert one(spark, fn.tokens(F.col("t")), t=None) == []


def test_lines(spark):
    assert one(spark, fn.lines_of(F.col("t")), t="a\r\nb\r\r\n\nc\n") == ["a", "b\r", "", "c"]
    assert one(spark, fn.lines_of(F.col("t")), t="\n") == [""] and one(spark, fn.lines_of(F.col("t")), t="") == []


def test_sizes_and_trigrams(spark):
    assert one(spark, fn.token_estimate(F.col("t")), t="") == 1 and one(spark, fn.token_estimate(F.col("t")), t="é" * 10) == 5
    assert len(one(spark, fn.trigrams(F.col("t")), t="aaaab")) == 2 and one(spark, fn.trigrams(F.col("t")), t="ab") == []
    same = fn.trigram_jaccard(fn.trigrams(F.col("a")), fn.trigrams(F.col("b")))
    assert one(spark, same, a="abcd", b="bcde") == 1 / 3 and one(spark, same, a="a", b="") == 0.0
    assert one(spark, fn.truncate(F.col("t"), 3), t="héllo") == "hél"


def test_three_digits_are_those_of_c(spark):
    numbers = [k * 1000 / 1e6 + 0.0005 for k in range(1000)] + [k / 16 for k in range(40)] + [0.0005, 0.8125, 0.1235, 1.0, 0.0]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", fn.text.three_digits(F.col("x")).alias("s")).collect()
    assert all(r.s == f"{r.x:.3f}" for r in got)


def test_relevance_and_kinds(spark):
    assert one(spark, fn.is_relevant(F.col("t"), F.col("n")), t="Some TEXT here", n=["no", "text"]) and not one(spark, fn.is_relevant(F.col("t"), F.col("n")), t="x", n=["y"])
    kinds = {"fn main": "ast", "foo.*bar": "regex", "how are files read in": "semantic", "two words": "lexical"}
    assert {q: one(spark, fn.classify_query(F.col("q")), q=q) for q in kinds} == kinds


def test_paths(spark):
    ext = {"a/b.RS": "RS", "a.b/c": "", ".hidden": "", "x.tar.gz": "gz", "a/.x.py": "py"}
    assert {p: one(spark, fn.extension(F.col("p")), p=p) for p in ext} == ext
    assert one(spark, fn.language_of(F.col("p")), p="x/Y.TSX") == "tsx" and one(spark, fn.language_of(F.col("p")), p="x") is None
    globs = [("src/a_b.rs", "*.rs", True), ("src/a_b.rs", "a%b*", False), ("src/a_b.rs", "a_b.rs", True), ("src/axb.rs", "a_b.rs", False), ("src/x/y.rs", "src/*.rs", True), ("src/x.rs", "rc/*", False), ("a", "", False)]
    for path, pattern, want in globs:
        assert one(spark, fn.glob_match(F.col("p"), pattern), p=path) is want, (path, pattern)
    assert one(spark, fn.is_denied(F.col("p")), p="a/node_modules/b.js") and not one(spark, fn.is_denied(F.col("p")), p="a/build") and not one(spark, fn.is_denied(F.col("p")), p="builder/x.rs")
    assert one(spark, paths.has_extension(F.col("p"), ("rs", ".TS")), p="x.ts") and one(spark, paths.has_extension(F.col("p"), ("",)), p="x")


def test_path_order(spark):
    df = spark.createDataFrame([("a-b/x",), ("a/x",), ("a/b/c",)], "p string")
    assert [r.p for r in df.orderBy(fn.path_parts(F.col("p"))).collect()] == ["a/b/c", "a/x", "a-b/x"]


def test_minhash(spark):
    terms = [[f"t{i}" for i in range(10)], [f"t{i}" for i in range(5, 15)], [f"u{i}" for i in range(10)], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t array<string>").select("i", fn.minhash(F.col("t")).alias("s"))
    pairs = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), fn.jaccard_estimate(F.col("a.s"), F.col("b.s")).alias("e"))
    got = {(r.i, r.j): r.e for r in pairs.collect()}
    assert got[0, 0] == 1.0 and abs(got[0, 1] - 1 / 3) < 0.15 and got[0, 2] < 0.05 and got[3, 3] == got[0, 3] == 0.0


def test_counted_within_the_row(spark):
    words = ["b", "é", "a", "b", "日", "a", "b"]
    assert [tuple(x) for x in one(spark, fn.text.counted(F.col("t")), t=words)] == [("a", 2), ("b", 3), ("é", 1), ("日", 1)]
    assert [tuple(x) for x in one(spark, fn.text.counted(F.col("t")), t=["x"])] == [("x", 1)]
    assert one(spark, fn.text.counted(F.filter("t", lambda w: w == "none")), t=words) is None


def test_six_digits_are_those_of_sql(spark):
    import duckdb

    some = [(a / b,) for b in (640, 128, 320, 1600, 997) for a in range(b)]
    want = [x for (x,) in duckdb.sql("SELECT round(x, 6) FROM (SELECT unnest($1) AS x)", params=[[x for (x,) in some]]).fetchall()]
    got = [r.x for r in spark.createDataFrame(some, "x double").select(fn.text.six_digits(F.col("x")).alias("x")).collect()]
    assert got == want and got[41] == 0.064062
