import random

import numpy as np
import pyarrow as pa

from bundlewright.llm import near_duplicates as nd
from bundlewright.llm import words

SCHEMA = "doc_id long, text string, head string, _near_gone string"


def vectors(texts):
    out = []
    for _, data, offsets in words.slices(pa.array([t or "" for t in texts])):
        s, w, f = nd.weighted(data, offsets)
        g = nd.registers(s, w, f)
        out += [(s[f[i] : f[i + 1]], w[f[i] : f[i + 1]], g[i]) for i in range(len(f) - 1)]
    return out


def brute_jaccard(u, v):
    total = 0.0
    for d in set(u) & set(v):
        total += 1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in set(u) | set(v))
    return total


def made(seed=1, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        docs.append([rng.choice(vocab) for _ in range(rng.randint(20, 120))])
    for i in range(n):
        copy = list(docs[rng.randrange(len(docs))])
        for _ in range(rng.randint(0, max(1, len(copy) // 12))):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        docs.append(copy)
    return [" ".join(d) for d in docs]


def test_exact_jaccard_is_that_of_the_definition():
    rng = random.Random(2)
    for _ in range(50):
        u, v = ({rng.randrange(12): rng.randint(1, 4) for _ in range(rng.randint(1, 9))} for _ in range(2))
        arrays = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (u, v)]
        assert abs(nd.probability_jaccard(*arrays[0], *arrays[1]) - brute_jaccard(u, v)) < 1e-9


def test_registers_estimate_it_without_bias():
    v = vectors(made(3, 60))
    errors = [(v[i][2] == v[j][2]).mean() - nd.probability_jaccard(*v[i][:2], *v[j][:2]) for i in range(60, 120) for j in range(i)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_groups_are_those_of_all_pairs(spark):
    texts = made()
    docs = [(i, t, "h", "k") for i, t in enumerate(texts)]
    docs += [(1000, texts[0], "h", "k"), (1001, None, "h", "k"), (1002, "", "h", "k"), (1003, "... !", "h", "k"), (None, texts[0], "h", "k"), (0, texts[0], "h", "k")]
    docs += [(2000 + i, "lone", "h", "k") for i in range(3)]
    v = vectors([t for _, t, _, _ in docs])
    parent = {d[0]: d[0] for d in docs if d[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if None not in (docs[i][0], docs[j][0]) and nd.probability_jaccard(*v[i][:2], *v[j][:2]) >= nd.THRESHOLD:
                a, b = sorted((root(docs[i][0]), root(docs[j][0])))
                parent[b] = a
    want = {}
    for d in parent:
        want.setdefault(root(d), set()).add(d)
    want = {k: x for k, x in want.items() if len(x) > 1}
    df = spark.createDataFrame(docs, SCHEMA)
    got = {}
    for r in nd.groups(df).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    pairs = lambda g: {(a, b) for x in g.values() for a in x for b in x if a < b}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.9 * len(pairs(want))
    left = nd.unique(df)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.collect()]
    gone = {d for k, x in got.items() for d in x if d != k}
    assert sorted(i for i in ids if i is not None) == sorted(set(parent) - gone) and ids.count(None) == 1


def test_groups_around_an_original_that_is_not_the_least_id(spark):
    rng = random.Random(4)
    texts = []
    for star in range(3):
        original = [f"s{star}w{i}" for i in range(200)]
        for copy in range(40):
            changed = list(original)
            for k in rng.sample(range(0, 200, 2), 20):
                changed[k] = f"s{star}c{copy}x{k}"
            texts.append((star * 100 + copy, " ".join(changed)))
        texts.append((star * 100 + 99, " ".join(original)))
    v = vectors([t for _, t in texts])
    originals = [i for i, (d, _) in enumerate(texts) if d % 100 == 99]
    band = lambda i: v[i][2].reshape(nd.BANDS, nd.ROWS)
    want = {d for i, (d, _) in enumerate(texts) for o in originals if (band(i) == band(o)).all(axis=1).any()}
    got = {r.doc_id: r.group_id for r in nd.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(want) > 110 and got == {d: d // 100 * 100 for d in want}


def components_of_bucket_pairs(texts):
    """Groups by verifying every pair of every bucket."""
    v = vectors([t for _, t in texts])
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for band in range(nd.BANDS):
        buckets = {}
        for i, (s, _, g) in enumerate(v):
            if len(s):
                buckets.setdefault(tuple(g[band * nd.ROWS : (band + 1) * nd.ROWS].tolist()), []).append(i)
        for held in buckets.values():
            for k, i in enumerate(held):
                for j in held[:k]:
                    if root(i) != root(j) and nd.probability_jaccard(*v[i][:2], *v[j][:2]) >= nd.THRESHOLD:
                        parent[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(texts):
        out.setdefault(root(i), set()).add(d)
    return {min(x): x for x in out.values() if len(x) > 1}


def test_every_pair_of_a_bucket_counts_whatever_else_there_is(spark):
    """A chain and a crowd of loosely like documents, alone (all rounds) and among many others (one round)."""
    rng = random.Random(21)
    vocab = [f"c{i}" for i in range(4_000)]
    chain = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for i in range(150):
        texts.append((i, " ".join(chain)))
        for _ in range(4):
            chain[rng.randrange(60)] = rng.choice(vocab)
    base = [rng.choice(vocab) for _ in range(80)]
    for i in range(200, 320):
        copy = list(base)
        for k in rng.sample(range(80), 9):
            copy[k] = rng.choice(vocab)
        texts.append((i, " ".join(copy)))
    want = components_of_bucket_pairs(texts)
    others = [(10_000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(20))) for i in range(6_000)]
    for more in ([], others):
        got = {}
        for r in nd.groups(spark.createDataFrame(texts + more, "doc_id long, text string")).collect():
            got.setdefault(r.group_id, set()).add(r.doc_id)
        assert got == want


def test_scripts_without_blanks_and_long_texts(spark):
    rng = random.Random(22)
    some = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(300))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(300))
    long = " ".join(f"n{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, some), (2, some[:150] + "新" + some[150:] + "。"), (3, thai), (4, thai + "ก"), (5, some[::-1]), (6, long), (7, long + " end"), (8, "«a» b—c"), (9, "a b c")]
    got = {r.doc_id: r.group_id for r in nd.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 6: 6, 7: 6, 8: 8, 9: 8}


def test_words_of_scripts():
    def split(text, solid):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        start, end, _ = words.find(data, np.array([0, len(data)]), solid)
        return [data[a:b].tobytes().decode() for a, b in zip(start, end)]

    assert split("née 日本語x ab、c “q” d\u00a0e\u3000f", words.ALNUM) == ["née", "日", "本", "語", "x", "ab", "c", "q", "d", "e", "f"]
    assert split("née 日本x, “q” d\u00a0e\u3000f\u2003g", words.SOLID) == ["née", "日", "本", "x,", "“q”", "d", "e", "f", "g"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nd.groups(empty).count() == 0 and nd.unique(empty).count() == 0
