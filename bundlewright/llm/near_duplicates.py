"""Operator 10: near duplicates by ProbMinHash.

A document's weighted shingles are its pairs of neighbouring words, lower-cased and
without punctuation, each with its number of occurrences; a document of one word
has that word. Each shingle is a Poisson process whose rate is its weight, drawn
from the shingle's hash: every arrival falls on one of ``REGISTERS`` registers, and
a register keeps the shingle that arrives first. Processes run side by side, and
one ends as soon as its next arrival is later than the latest register's. Two
documents agree in a register with the probability Jaccard of their weights, a
measure that doesn't change if a document is written twice over.

Documents with equal shingles are taken together first. Of the rest, those that
agree in all registers of a band are one bucket, and any two documents of a bucket are a pair. Groups are the connected
components of the pairs whose exact probability Jaccard, of the whole texts, reaches the threshold.

Not every pair must be verified for that: two documents that verified pairs already connect are in one group, whatever
their own pair gives. That is the one rule by which a pair is left out. Pairs are verified in rounds, and it has no effect on the groups which
come first. In each bucket some leading documents are verified against every other that isn't connected to them, and have then
no pair left there; all others stay, linked or not. The leaders are four times as many in each round, those of the bucket's smallest components and those with the
most links, and in the last round, once all pairs that are left are fewer than documents, all of a bucket's documents lead. So a
bucket of many copies never needs all its pairs, and one of unlike documents takes few rounds.

Defined cases: a null or empty text, or one without words, has no shingles and is
in no group; nor is a row with a null id. Rows that share an id are one document,
which is like another if any of its rows is. Texts of any length are taken whole. Ties have no effect: groups don't
depend on the order of rows, nor on documents outside them. An empty table gives no rows; other columns, of whatever name, are
ignored by :func:`groups` and kept by :func:`unique`. In scripts without blanks each character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlewright.durable import cut
from bundlewright.llm import words
from bundlewright.llm.common import free_name, small_enough, sole, table

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
THRESHOLD = 0.6
#: Members that are verified by one task against its copy of a leading document.
MEMBERS = 2_000
_SHINGLE = (1 << 44) - 1
_SEED = np.uint64(0x5DEECE66D1234567)


def weighted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, first): distinct shingles sorted within each row, and each row's first place, with the total at the end."""
    start, end, first = words.find(data, offsets, words.ALNUM)
    h = words.hashes(data, start, end)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    two = words.pairs_of(h, 1)
    same = row[1:] == row[:-1]
    lone = first[:-1][np.diff(first) == 1]
    shingle = np.concatenate([two[same], words.mix(h[lone])]) >> np.uint64(20)
    key = np.sort((np.concatenate([row[1:][same], row[lone]]).astype(np.uint64) << np.uint64(44)) | shingle)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    weight = np.diff(np.append(new, len(key)))
    key = key[new]
    first = np.searchsorted(key >> np.uint64(44), np.arange(rows + 1, dtype=np.uint64))
    return key & np.uint64(_SHINGLE), weight, first


def registers(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The winning shingle of each row's registers; those of a row without shingles are 0."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    arrival = np.full(rows * m, np.inf)
    winner = np.zeros(rows * m, dtype=np.uint64)
    latest = np.full(rows, np.inf)
    time, scale, nth = np.zeros(len(shingle)), 1.0 / weight, 0
    while len(shingle):
        nth += 1
        u = words.mix(words.mix(shingle + _SEED) + np.uint64(nth * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale
        on = time < latest[row]
        shingle, time, scale, row, u = shingle[on], time[on], scale[on], row[on], u[on]
        place = row * m + (u % np.uint64(m)).astype(np.int64)
        np.minimum.at(arrival, place, time)
        won = arrival[place] == time
        winner[place[won]] = shingle[won]
        if len(row):
            touched = row[np.concatenate([[True], row[1:] != row[:-1]])]
            latest[touched] = arrival.reshape(rows, m)[touched].max(axis=1)
    return winner.reshape(rows, m)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The exact probability Jaccard of two sorted sets of weighted shingles."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    if not both.any():
        return 0.0
    u, v = wa[both].astype(float), wb[at[both]].astype(float)
    only_u, only_v = wa.sum() - u.sum(), wb.sum() - v.sum()
    total = 0.0
    ratio, which = np.unique(u / v, return_inverse=True)
    for k, t in enumerate(ratio):
        total += u[which == k].sum() / (np.maximum(u, v * t).sum() + only_u + only_v * t)
    return float(total)


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, same, like, bands) of each row with shingles: two hashes of all its shingles, and one of each band."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.lower(F.col(f"`{text}`")).alias("text")).where("doc_id is not null")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = words.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for at, data, offsets in words.slices(batch.column(1)):
                shingle, weight, first = weighted(data, offsets)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                each = shingle * np.uint64(0xD6E8FEB86659FD93) + weight.astype(np.uint64)
                same, like = (np.add.reduceat(words.mix(each ^ s), first[full]) for s in (np.uint64(0), _SEED))
                won = registers(shingle, weight, first)[full].reshape(len(full), BANDS, ROWS)
                key = np.broadcast_to(salt, (len(full), BANDS)).copy()
                for k in range(ROWS):
                    key = words.mix(key * np.uint64(3) + won[:, :, k])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(words.numbers(key).reshape(-1)))
                ids = batch.column(0).take(pa.array(full + at))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(words.numbers(same)), pa.array(words.numbers(like)), bands], ["doc_id", "same", "like", "bands"]
                )

    return narrow.mapInArrow(run, f"doc_id {kind}, same long, like long, bands array<long>")


def verified(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(head, doc_id, jaccard) for each of ``pairs`` (head, doc_id), from the whole texts.

    Texts are sent to a part of a head's pairs, whose number follows their count, so that
    no task gets all the pairs of a head that has many.
    """
    parts = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(parts, "head").select(
        F.col("doc_id").alias("want"), "head", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member")
    )
    heads = parts.select(
        F.col("head").alias("want"), "head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member")
    )
    wanted = cut(members.unionByName(heads))
    wanted = F.broadcast(wanted) if small_enough(wanted.count()) else wanted
    narrow = docs.select(F.col(f"`{id_col}`").alias("want"), F.lower(F.col(f"`{text}`")).alias("text"))
    sent = narrow.join(wanted, "want").repartition("head", "part").sortWithinPartitions("head", "part", "member")
    kind = pairs.schema["head"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            want, heads, parts, member = (batch.column(n) for n in ("want", "head", "part", "member"))
            head_list, part_list, members = heads.to_pylist(), parts.to_pylist(), member.to_pylist()
            rows, found = [], []
            for at, data, offsets in words.slices(batch.column("text")):
                shingle, weight, first = weighted(data, offsets)
                for i in range(len(first) - 1):
                    own = slice(first[i], first[i + 1])
                    key = (head_list[at + i], part_list[at + i])
                    if key != now:
                        now, held = key, []
                    if not members[at + i]:
                        held.append((shingle[own].copy(), weight[own].copy()))
                    else:
                        rows.append(at + i)
                        found.append(max((probability_jaccard(*h, shingle[own], weight[own]) for h in held), default=0.0))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([heads.take(take), want.take(take), pa.array(found, pa.float64())], ["head", "doc_id", "jaccard"])

    return sent.select("want", "head", "part", "member", "text").mapInArrow(run, f"head {kind}, doc_id {kind}, jaccard double")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, label): each end of the edges (a, b) with the least id of its component, by alternating large and small stars."""

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        near = both.select("u", "v", least.alias("m"))
        if large:
            return near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        ends = near.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return ends.unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while before[0]:
        edges = cut(star(star(edges, True), False))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("doc_id"), F.col("b").alias("label")).distinct()
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of each document that has a near duplicate; the least id of a group is its id and is kept."""
    docs = sole(docs, id_col, text)
    each = cut(sketches(docs, id_col, text))
    # Equal shingles: the least id stands for all.
    heads = each.groupBy("same", "like").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("head"))
    heads = cut(heads)
    equal = each.select("doc_id", "same", "like").join(heads.select("same", "like", "head"), ["same", "like"]).where("doc_id <> head")
    edges = equal.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    by_key = Window.partitionBy("key")
    buckets = heads.select(F.col("head").alias("doc_id"), F.explode("bands").alias("key"))
    buckets = cut(buckets.withColumn("n", F.count(F.lit(1)).over(by_key)).where("n > 1").select("key", "doc_id"))
    total, first, links, tried = each.count(), 1, None, None
    while True:
        known = buckets.withColumn("label", F.col("doc_id")).withColumn("links", F.lit(0))
        if links is not None:
            known = buckets.join(links, "doc_id", "left").select(
                "key", "doc_id", F.coalesce("label", "doc_id").alias("label"), F.coalesce("links", F.lit(0)).alias("links")
            )
        counted = known.withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy("key", "label")))
        counted = counted.withColumn("n", F.count(F.lit(1)).over(by_key)).where("n > alike")
        counted = counted.withColumn("nth", F.row_number().over(by_key.orderBy("alike", F.desc("links"), "doc_id")))
        counted = cut(counted.withColumn("by_links", F.row_number().over(by_key.orderBy(F.desc("links"), "doc_id"))))
        size = counted.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("n") - F.col("alike")) / 2).alias("pairs")).first()
        if not size["rows"]:
            break
        last = size["pairs"] <= total
        leads = F.lit(True) if last else F.least("nth", "by_links") <= first
        leading = counted.where(leads).select("key", F.col("doc_id").alias("head"), F.col("label").alias("head_label"))
        pairs = counted.join(leading, "key").where("label <> head_label")
        pairs = pairs.groupBy(F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b")).agg(F.min("head").alias("head"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(pairs.select("head", F.when(F.col("head") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc_id")))
        found = cut(verified(docs, pairs, id_col, text).groupBy("head", "doc_id").agg(F.max("jaccard").alias("jaccard")))
        like = found.where(F.col("jaccard") >= threshold).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
        edges = edges.unionByName(like)
        if last:
            break
        unlike = found.where(F.col("jaccard") < threshold).select(F.least("head", "doc_id").alias("a"), F.greatest("head", "doc_id").alias("b"))
        tried = unlike if tried is None else tried.unionByName(unlike)
        ends = like.select(F.col("a").alias("doc_id")).unionByName(like.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("links"))
        if links is not None:
            like = like.unionByName(links.where("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b")))
            ends = ends.unionByName(links.select("doc_id", "links")).groupBy("doc_id").agg(F.sum("links").alias("links"))
        links = cut(components(like).join(ends, "doc_id"))
        buckets = cut(counted.where(~leads).select("key", "doc_id"))
        first *= 4
    labels = components(edges)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("group_size"))
    return labels.join(sizes, "label").select(
        "doc_id", F.col("label").alias("group_id"), "group_size", (F.col("doc_id") == F.col("label")).alias("keep")
    )


def unique(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents less all but one of each group, with all their columns; of rows that share an id and a text one stays."""
    gone_name, again_name, text_key = (free_name(docs, n) for n in ("_near_gone", "_near_again", "_near_text"))
    found = cut(groups(docs, id_col, text, threshold))
    gone = found.where("not keep").select(F.col("doc_id").alias(gone_name))
    gone = F.broadcast(gone) if small_enough(gone.count()) else gone
    left = docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{gone_name}`"), "left_anti")
    repeated = sole(left, id_col).where(F.col(f"`{id_col}`").isNotNull()).groupBy(f"`{id_col}`").agg(F.count(F.lit(1)).alias(again_name + "n"))
    repeated = cut(repeated.where(F.col(again_name + "n") > 1).select(F.col(f"`{id_col}`").alias(again_name)))
    n = repeated.count()
    if not n:
        return left
    again = F.broadcast(repeated) if small_enough(n) else repeated
    on = F.col(f"`{id_col}`") == F.col(f"`{again_name}`")
    once = left.join(again, on, "left_semi").withColumn(text_key, F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([id_col, text_key]).drop(text_key)
    return left.join(again, on, "left_anti").unionByName(once)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLES: dict[str, str] = {}
