"""Choosing a bundle: relevant, not redundant, within a budget of tokens.

A choice's energy is ``-sum(rel) + LAMBDA * sum(sim of chosen pairs) + MU * max(0, tokens - budget)^2``;
the lower, the better.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDA, MU, BUDGET = 0.5, 0.001, 4000
HOTTEST, COLDEST, FLIPS, SEED = 5.0, 0.01, 5_000, 0xC0DEF00D
#: Energies are whole numbers of this part while the annealer runs, so that any engine meets the same ones.
UNIT = 256_000_000
#: Items of which all choices are tried.
EXACT_ITEMS = 12


def energy(items: DataFrame, pairs: DataFrame, budget: int = BUDGET, lam: float = LAMBDA, mu: float = MU) -> DataFrame:
    """(query_id, energy) of the chosen ones of items (query_id, i, rel, tok, chosen) with pairs (query_id, i, j, sim)."""
    chosen = items.where("chosen").select("query_id", "i", "rel", "tok")
    own = chosen.groupBy("query_id").agg(F.sum("rel").alias("gain"), F.sum("tok").alias("used"))
    both = pairs.join(chosen.select("query_id", "i"), ["query_id", "i"]).join(chosen.select("query_id", F.col("i").alias("j")), ["query_id", "j"])
    alike = both.groupBy("query_id").agg(F.sum("sim").alias("alike"))
    every = items.select("query_id").distinct().join(own, "query_id", "left").join(alike, "query_id", "left")
    over = F.greatest(F.lit(0), F.coalesce("used", F.lit(0)) - budget)
    value = -F.coalesce("gain", F.lit(0.0)) + lam * F.coalesce("alike", F.lit(0.0)) + mu * over * over
    return every.select("query_id", value.alias("energy"))


def greedy(items: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The items with ``chosen``: by falling relevance (rounded, so that ties go by number) each that still fits; one that doesn't is passed over.

    A fold over a query's sorted items, at most topk of them, in the JVM.
    """
    one = F.struct((-F.round("rel", 6)).alias("worse"), "i", "tok", "rel")
    lists = items.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("sorted"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(state, x):
        fits = state["used"] + x["tok"] <= budget
        return F.struct(
            F.when(fits, state["used"] + x["tok"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["taken"], F.array(x["i"]))).otherwise(state["taken"]).alias("taken"),
        )

    taken = lists.select("query_id", "sorted", F.aggregate("sorted", start, step)["taken"].alias("taken"))
    each = taken.select("query_id", "taken", F.explode("sorted").alias("x"))
    return each.select("query_id", F.col("x.i").alias("i"), F.col("x.rel").alias("rel"), F.col("x.tok").alias("tok"), F.array_contains("taken", F.col("x.i")).alias("chosen"))


def exact(items: DataFrame, pairs: DataFrame, n: int = EXACT_ITEMS, budget: int = BUDGET, lam: float = LAMBDA, mu: float = MU) -> DataFrame:
    """(query_id, mask, energy) of the best choice of each query's items 1 to ``n``; bit i - 1 of the mask is item i.

    Tries 2^n choices of each query, for checking the annealer; ``n`` up to 16.
    """
    if n > 16:
        raise ValueError("too many items to try all choices")
    few = items.where(F.col("i") <= n)
    masks = few.sparkSession.range(1 << n).select(F.col("id").cast("int").alias("mask"))

    def bit(name: str):
        return F.expr(f"(mask >> ({name} - 1)) & 1")

    by = few.groupBy("query_id").agg(F.collect_list(F.struct("i", "rel", "tok")).alias("items"))
    near = pairs.where(F.col("j") <= n).groupBy("query_id").agg(F.collect_list(F.struct("i", "j", "sim")).alias("pairs"))
    tried = by.join(near, "query_id", "left").withColumn("free", F.expr("aggregate(items, 0, (a, x) -> a | (1 << (x.i - 1)))"))
    tried = tried.crossJoin(F.broadcast(masks)).where("mask & free = mask")  # 2^n rows of one number
    gain = F.expr("aggregate(items, 0D, (a, x) -> a + IF((mask >> (x.i - 1)) & 1 = 1, x.rel, 0D))")
    used = F.expr("aggregate(items, 0L, (a, x) -> a + IF((mask >> (x.i - 1)) & 1 = 1, x.tok, 0))")
    alike = F.expr("coalesce(aggregate(pairs, 0D, (a, x) -> a + IF((mask >> (x.i - 1)) & (mask >> (x.j - 1)) & 1 = 1, x.sim, 0D)), 0D)")
    over = F.greatest(F.lit(0), used - budget)
    valued = tried.select("query_id", "mask", F.round(-gain + lam * alike + mu * over * over, 6).alias("energy"))
    return valued.groupBy("query_id").agg(F.min(F.struct("energy", "mask")).alias("best")).select("query_id", "best.mask", "best.energy")


def value(rel: np.ndarray, sim: np.ndarray, tok: np.ndarray, x: np.ndarray, budget: int, lam: float = LAMBDA, mu: float = MU) -> float:
    over = max(0, int(tok[x].sum()) - budget)
    return float(-rel[x].sum() + lam * np.triu(sim, 1)[np.ix_(x, x)].sum() + mu * over * over)


def units(rel: np.ndarray, sim: np.ndarray, lam: float = LAMBDA) -> tuple[np.ndarray, np.ndarray]:
    """Gains (of six digits) and costs of pairs in whole units."""
    return np.rint(np.round(rel, 6) * UNIT).astype(np.int64), np.rint(lam * np.asarray(sim, dtype=float) * UNIT).astype(np.int64)


def first_fit(rel: np.ndarray, tok: np.ndarray, budget: int) -> np.ndarray:
    x, used = np.zeros(len(rel), dtype=bool), 0
    for i in np.argsort(-np.round(rel, 6), kind="stable"):
        if used + tok[i] <= budget:
            x[i], used = True, used + tok[i]
    return x


@lru_cache(8)
def draws(flips: int = FLIPS, seed: int = SEED) -> tuple[list[int], list[int]]:
    """(which, most) of each step: a number whose remainder is the item to flip, and the most units that a flip may cost there.

    Both come from the digits of the MD5 of seed and step, which SQL has too; the second is ``-T ln u`` at a temperature that falls by the same factor at each step.
    """
    which, most = [], []
    for k in range(flips):
        digits = hashlib.md5(f"{seed}/{k}".encode()).hexdigest()
        heat = HOTTEST * (COLDEST / HOTTEST) ** (k / max(1, flips - 1))
        which.append(int(digits[:7], 16))
        most.append(math.floor(-heat * math.log((int(digits[7:14], 16) + 0.5) / (1 << 28)) * UNIT))
    return which, most


def anneal(
    rel: np.ndarray, sim: np.ndarray, tok: np.ndarray, budget: int = BUDGET, lam: float = LAMBDA, mu: float = MU, flips: int = FLIPS, seed: int = SEED
) -> np.ndarray:
    """The best choice met while cooling down from the greedy one, which it is never worse than; the same for the same input.

    What a flip would change is kept for each item, so a flip costs its row of similarities, not all pairs.
    """
    n = len(rel)
    x = first_fit(rel, tok, budget)
    if not n:
        return x
    gain, cost = units(rel, sim, lam)
    np.fill_diagonal(cost, 0)
    field = cost @ x - gain  # what an item adds while it isn't chosen, but for the budget
    dear, sizes, on, used = round(mu * UNIT), tok.tolist(), x.tolist(), int(tok[x].sum())
    now = best = 0
    kept = on[:]

    def over(t: int) -> int:
        return dear * max(0, t - budget) ** 2

    for number, most in zip(*draws(flips, seed)):
        i = number % n
        sign = -1 if on[i] else 1
        then = used + sign * sizes[i]
        delta = sign * int(field[i]) + over(then) - over(used)
        if delta <= most:
            on[i], used, now = not on[i], then, now + delta
            field += sign * cost[i]
            if now < best:
                best, kept = now, on[:]
    return np.array(kept, dtype=bool)


def annealed(items: DataFrame, pairs: DataFrame, budget: int = BUDGET, lam: float = LAMBDA, mu: float = MU, seed: int = SEED) -> DataFrame:
    """(query_id, i) of the chosen items; each query, at most topk items, is solved by itself in a batch of rows.

    Items may have a ``budget`` of their query's own.
    """
    limit = F.max("budget") if "budget" in items.columns else F.max(F.lit(budget))
    own = items.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "rel", "tok"))).alias("items"), limit.cast("long").alias("budget"))
    near = pairs.groupBy("query_id").agg(F.collect_list(F.struct("i", "j", "sim")).alias("pairs"))
    problems = own.join(near, "query_id", "left")
    kind = problems.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chosen = [], []
            for k, (item, pair, most) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("items", "pairs", "budget")))):
                place = {x["i"]: p for p, x in enumerate(item)}
                sim = np.zeros((len(item), len(item)))
                for p in pair or ():
                    a, b = place[p["i"]], place[p["j"]]
                    sim[a, b] = sim[b, a] = p["sim"]
                x = anneal(np.array([v["rel"] for v in item]), sim, np.array([v["tok"] for v in item], dtype=np.int64), most, lam, mu, seed=seed)
                for p in np.flatnonzero(x):
                    rows.append(k)
                    chosen.append(item[p]["i"])
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows, pa.int64())), pa.array(chosen, pa.int32())], ["query_id", "i"])

    return problems.mapInArrow(run, f"query_id {kind}, i int")
