import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from bundlewright.llm import packing, sharding

TIERS = (8, 32, 128)


def made(n=400):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 1, 3, 7, 8, 9, 20, 31, 33, 60, 128, 129, 300, 1000]), "x") for i in range(n)]
    return [*rows, (0, 20, "x"), *[(None, 5, "x")] * 9]


def test_packing_holds_every_token_once(spark):
    rows = made()
    lengths = spark.createDataFrame(rows, "doc_id long, n_tokens long, tier string")
    got = packing.pack(lengths, tiers=TIERS, step_tokens=256, part_pieces=7).collect()
    assert len(got) == packing.pack(lengths, tiers=TIERS, step_tokens=256).count()
    want, have = Counter(), Counter()
    for d, n, _ in rows:
        if n:
            want[d] += n
    windows = defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_tokens
        windows[r.tier, r.window].append((r.offset, r.n_tokens))
        assert r.n_tokens <= r.tier
    assert have == want
    for (tier, _), held in windows.items():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and held[0][0] == 0 and sum(n for _, n in held) <= tier
    numbers = defaultdict(set)
    for tier, w in windows:
        numbers[tier].add(w)
    assert all(n == set(range(len(n))) for n in numbers.values())
    assert sum(want.values()) > 0.9 * sum(t for t, _ in windows)
    steps = defaultdict(set)
    for r in got:
        steps[r.tier, r.step].add(r.window)
    for tier in TIERS:
        sizes = [len(w) for (t, _), w in steps.items() if t == tier]
        assert not sizes or max(sizes) - min(sizes) <= 1


def test_plan_equals_packing_piece_by_piece():
    rng = random.Random(7)
    for _ in range(30):
        lengths = [rng.randint(1, 128) for _ in range(rng.randint(1, 60))]
        _, windows = packing.plan(Counter(lengths), TIERS)
        left, count = sorted(lengths, reverse=True), []
        for t in range(2, -1, -1):
            gaps, rest = [], []
            for n in left:
                least = TIERS[t - 1] if t else 0
                fit = min((g for g in gaps if g >= n), default=None)
                if fit is not None:
                    gaps[gaps.index(fit)] -= n
                elif n > least:
                    gaps.append(TIERS[t] - n)
                else:
                    rest.append(n)
            left = rest
            count.append(len(gaps))
        assert windows == count[::-1]


def test_steps_cost_about_the_same(spark):
    rng = random.Random(8)
    rows = [(i, min(32_768, int(rng.lognormvariate(6, 1.5)) + 1)) for i in range(6_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    cost = defaultdict(Counter)
    for r in got:
        cost[r.tier][r.step] += r.n_tokens**2
    for tier, steps in cost.items():
        full = sorted(steps.values())[1:]  # one step may lack windows
        assert len(full) < 4 or max(full) < 1.25 * min(full), (tier, full)


def test_a_text_of_over_two_megabytes_is_packed_whole(spark):
    rows = [(1, "word " * 500_000, 3), (2, None, 3), (3, "", 3), (2, "short", 3), (2, "short", 3)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int")).collect()
    assert Counter(r.doc_id for r in got) == {1: 16, 2: 2} and sum(r.n_tokens for r in got if r.doc_id == 1) == 500_001


def test_packing_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_shards_hold_all_records_in_a_seeded_order(spark):
    rows = [(i, f"text {i}" * 20 if i % 9 else None, {"a": i}) for i in range(2000)] + [(5, "same", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard map<string,long>")
    runs = [sharding.shuffled(df, seed, 20_000).collect() for seed in (1, 1, 2)]
    assert Counter(sharding.shuffled(df, 1, 20_000, fanout=3).select("doc_id", "shard_", "position").collect()) == Counter((r["doc_id"], r["shard_"], r["position"]) for r in runs[0])
    key = lambda r: (r["shard_"], r["position"], r["doc_id"])
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1])) != sorted(map(key, runs[2]))
    assert Counter((r.doc_id, r.text) for r in runs[0]) == Counter((a, b) for a, b, _ in rows)
    by = defaultdict(list)
    for r in runs[0]:
        by[r["shard_"]].append(r["position"])
    assert len(by) > 3 and all(sorted(p) == list(range(len(p))) for p in by.values())
    assert sharding.shuffled(df.limit(0)).count() == 0


def test_equal_records_are_scattered(spark):
    df = spark.createDataFrame([("x" * 100,)] * 3_000 + [(f"y{i}" * 20,) for i in range(1_000)], "text string")
    found = sharding.shuffled(df, 3, 20_000)
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert found.count() == 4_000 and len(sizes) > 15 and max(sizes) < 2 * min(sizes)


def test_any_columns(spark):
    schema = "a array<map<string,int>>, b struct<m:map<int,string>,s:string>, c array<int>, shard int, Position int, d map<string,int>"
    rows = [([{"k": i}], ({i: "v"}, "s"), list(range(500)), i, i, None) for i in range(300)] + [(None, None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, schema)
    assert sharding.bucket_count(df, 20_000) > 15
    got = sharding.shuffled(df, 1, 20_000)
    assert got.columns == [*df.columns, "shard_", "position_"]
    assert Counter(str(r[:6]) for r in got.collect()) == Counter(str(tuple(r)) for r in df.collect())


def test_a_record_longer_than_a_bucket(spark):
    rows = [(1, "z" * 3_000_000), *((i, "short") for i in range(2, 50))]
    assert sorted(r.doc_id for r in sharding.shuffled(spark.createDataFrame(rows, "doc_id long, text string"), 1, 1 << 20).collect()) == list(range(1, 50))


def test_written_shards_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(2_000)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4, 10_000)
    files, rows = sorted((tmp_path / "out").glob("*.parquet")), 0
    for file in files:
        one = pq.read_table(file).to_pydict()
        assert len(set(one["shard"])) == 1 and one["position"] == list(range(len(one["position"])))
        rows += len(one["position"])
    assert rows == 2_000 and len(files) == sharding.bucket_count(df, 10_000)


def test_permutations_are_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s, 0)) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
