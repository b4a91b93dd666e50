import ctypes
import random
import resource
from collections import defaultdict

import pyarrow as pa
import pytest

from bundlewright.llm import repeats as R
from bundlewright.llm import words


def brute(docs, least):
    """Every maximal repeat, by growing groups of equal words."""
    texts = [(d, (t or "").split()) for d, t in docs]
    out = set()

    def grow(group, depth):
        while True:
            after = defaultdict(list)
            for i, p in group:
                w = texts[i][1]
                after[w[p + depth] if p + depth < len(w) else ("end", i)].append((i, p))
            if len(after) > 1 or isinstance(next(iter(after)), tuple):
                break
            depth += 1
        before = {texts[i][1][p - 1] if p else ("start", i) for i, p in group}
        if len(group) > 1 and len(before) > 1:
            out.add((depth, tuple(sorted((texts[i][0], p) for i, p in group))))
        for g in after.values():
            if len(g) > 1:
                grow(g, depth + 1)

    first = defaultdict(list)
    for i, (_, w) in enumerate(texts):
        for p in range(len(w) - least + 1):
            first[tuple(w[p : p + least])].append((i, p))
    for g in first.values():
        if len(g) > 1:
            grow(g, least)
    return out


def made():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [some(60), some(150), some(52), some(400)]
    base = some(300)
    docs = []
    for i in range(40):
        words = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(shared) + some(rng.choice([0, 1, 2, 30]))
        docs.append((i, " ".join(words)))
    for i in range(40, 60):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(300)] = rng.choice(vocab)
        docs.append((i, " \n".join(words)))
    return [*docs, (60, " ".join(base)), (61, " ".join(base)), (62, ""), (63, None), (64, "short text")]


def listed(df):
    """(repeat_id, doc_id, start, n_words, n_occurrences, period, phase) of each entry."""
    out = []
    for r in R.repeats(df).collect():
        assert r.n_repeats == len(r.repeats) > 0
        out += [(x.repeat_id, r.doc_id, x.start, x.n_words, x.n_occurrences, x.period, x.phase) for x in r.repeats]
    return out


def found(spark, docs):
    """The repeats that are given, those within runs written out and those of equal texts for all of them."""
    rows = listed(spark.createDataFrame(docs, "doc_id long, text string"))
    texts = {d: (t or "").split() for d, t in docs}
    same = defaultdict(list)
    for d, t in docs:
        same[t].append(d)
    like = {d: same[t] for d, t in docs}
    single, runs, counts = defaultdict(set), defaultdict(set), {}
    for repeat, d, start, n, count, period, phase in rows:
        counts[repeat, n if period is None else 0] = count
        for x in like[d]:
            if period is None:
                single[repeat, n].add((x, start))
            else:
                runs[repeat].add((x, start, n, period, phase))
    assert all(counts[k] == len(v) for k, v in single.items()) and all(counts[k, 0] == len(v) for k, v in runs.items())
    out = [(n, tuple(sorted(at))) for (_, n), at in single.items()]
    for held in runs.values():
        out += [(n, tuple(at)) for n, at in R.expanded(sorted(held), texts)]
    assert len(out) == len(set(out)) and len({k for k, _ in single}) == len(single)
    assert {d for d in texts if len(texts[d]) >= R.LEAST and len(like[d]) > 1} <= {r[1] for r in rows}
    return set(out)


def test_all_maximal_repeats_with_all_occurrences(spark):
    docs = made()
    assert found(spark, docs) == brute(docs, R.LEAST)


def test_copies_of_texts(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    one, two, three = text(70), text(120), text(49)
    docs = [(i, one) for i in range(5)] + [(10 + i, two) for i in range(3)] + [(20, f"x {two} y"), (21, three), (22, three), (23, f"{text(30)} {two.rsplit(None, 5)[0]}")]
    docs += [(30 + i, "tick tock " * 40) for i in range(3)]
    want = brute(docs, R.LEAST)
    assert (70, tuple((i, 0) for i in range(5))) in want and found(spark, docs) == want


def test_runs(spark):
    """Runs by themselves, of several lengths, and followed by passages that others share."""
    turn = [f"t{i}" for i in range(20)]
    first = [(i, " ".join(turn * k)) for i, k in enumerate((6, 3, 5))]
    assert found(spark, first) == brute(first, R.LEAST)
    same = [(1, "a " * 200)]
    assert len(brute(same, R.LEAST)) == 150 and found(spark, same) == brute(same, R.LEAST)
    passage, turn = [f"p{i}" for i in range(80)], [f"t{i}" for i in range(7)]
    docs = [(1, ["x"] + ["-"] * 300 + passage), (2, ["y"] + ["-"] * 120 + passage + ["z"]), (3, ["-"] * 70 + passage[:30])]
    docs += [(4, ["q"] + turn * 40 + passage[:60]), (5, ["r"] + turn[3:] + turn * 12 + passage[:60] + ["s"]), (6, turn * 20)]
    docs = [(i, " ".join(w)) for i, w in docs]
    assert found(spark, docs) == brute(docs, R.LEAST)


def test_any_runs(spark):
    rng = random.Random(11)
    vocab, passages = [f"w{i}" for i in range(30)], [[f"p{k}.{i}" for i in range(60)] for k in range(2)]
    turns = [[rng.choice(vocab) for _ in range(p)] for p in (1, 2, 3, 12, 24, 25, 26, 31, 40)]
    docs = []
    for i in range(36):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(turns)
            n = rng.choice([40, 51, 60, 74, 75, 90, 130, 200])
            at = rng.randrange(len(t))
            words += [t[(at + k) % len(t)] for k in range(n)]
            words += rng.choice([[], ["z"], *passages, [rng.choice(vocab) for _ in range(5)]])
        docs.append((i, " ".join(words)))
    assert found(spark, docs) == brute(docs, R.LEAST)


def cut_by_definition(docs, least):
    """Texts less each word that is in ``least`` words that came before, by id and place."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        w = (t or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                gone[i : i + least] = [True] * least
            seen.add(key)
        if not w or not all(gone):
            out[d] = [x for x, g in zip(w, gone) if not g]
    return out


def test_cutting_is_that_of_the_definition(spark):
    rng = random.Random(12)
    turn = [f"t{i}" for i in range(9)]
    docs = made()[:50] + [(100 + i, " ".join([rng.choice("xyz")] + [turn[(i + k) % 9] for k in range(rng.choice([52, 55, 58, 90]))] + ["end"])) for i in range(20)]
    docs += [(200, docs[0][1]), (201, " ".join(turn * 30)), (202, " ".join(turn * 30))]
    got = {r.doc_id: r.text.split() if r.text else [] for r in R.cut_out(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == cut_by_definition(docs, R.LEAST)


def test_runs_and_cutting(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [
        (1, "a " * 2000, 4000, "x", 7),
        (2, f"before {passage} after", None, "x", 7),
        (3, f"other {passage}\nend é", None, "x", 7),
        (4, passage, None, "x", 7),
        (5, "clean  text\nstays as it is", 26, "x", 7),
        (5, None, 0, "x", 7),
        (5, None, 0, "x", 7),
        (None, f"start {passage} stop", None, "x", 7),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, keys string, _cut_key int")
    rows = listed(df)
    assert [r[1:4] + r[5:] for r in rows if r[5]] == [(1, 0, 2000, 1, 0)]
    assert sorted((-1 if r[1] is None else r[1], r[2]) for r in rows if r[3] == 60) == [(-1, 1), (2, 1), (3, 1), (4, 0)]
    left = R.cut_out(df)
    assert left.columns == df.columns
    text = sorted(left.collect(), key=str)
    assert text == sorted([(1, "a ", 2, "x", 7), docs[1], (3, "other end é", 11, "x", 7), docs[4], docs[5], docs[6], (None, "start stop", 10, "x", 7)], key=str)


def test_a_long_text(spark):
    rng = random.Random(13)
    long = [f"n{rng.randrange(10**6)}" for _ in range(300_000)]  # over 2 MB
    part = long[200_000:200_100]
    docs = [(1, " ".join(long)), (2, " ".join(["x", *part, "y"])), (3, " ".join(long)), (4, "-" * 3_000_000)]
    got = {r[1:5] for r in listed(spark.createDataFrame(docs, "doc_id long, text string"))}
    assert got == {(1, 200_000, 100, 3), (2, 1, 100, 3), (1, 0, 300_000, 2), (3, 0, 300_000, 2)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.repeats(empty).count() == 0 and R.cut_out(empty).count() == 0


def test_one_python_node_cuts(spark, small):
    """A filter on the cut text must not call the function again: each node of a task holds a worker of its own."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = R.cut_out(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [less") == 1


def test_slices_give_memory_back():
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("only glibc keeps freed memory")

    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * resource.getpagesize() / 1e6

    blocks = [b"x" * 100_000 for _ in range(1001)]
    last = blocks.pop()  # above the others, so that they can't go by themselves
    del blocks
    before = held()
    assert sum(len(data) for _, data, _ in words.slices(pa.array(["a", None, "b"]), 1)) == 2 and len(last) == 100_000
    assert held() < before - 80


def test_small_columns_give_nothing_back(monkeypatch):
    """A column of one slice isn't worth a call: groups of occurrences have many such columns."""
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    assert [len(data) for _, data, _ in words.slices(pa.array(["a", None, "b"]))] == [2] and not calls
