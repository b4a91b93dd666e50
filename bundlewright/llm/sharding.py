"""Operator 5: a shuffle of the whole table in two passes.

The first pass scatters the records over buckets, each the size of a task's
memory, by a seeded hash. The second sorts a bucket by that
hash (so that the order in which the blocks of a shuffle arrive has no effect),
permutes it by Fisher and Yates with a generator seeded by (seed, bucket), and
gives it out as one shard. Every order of the table is as likely as any other,
up to the seed. The hash takes in the whole record, the partition it is read from and, of equal records in
that partition, a number; so equal records are scattered like any others, and it doesn't matter in which order a partition is read. The same
seed gives the same order again for a table that is read in the same partitions, whatever the number of executors.

More than ``FANOUT`` buckets are scattered in two levels: first to groups of ``FANOUT`` of them, which are written to
the shared folder, then each group to its buckets. So no task writes to more buckets than that, and blocks stay large.

Defined cases: null values are hashed as such; columns that hold maps, at any depth, are hashed as JSON; a single record is never
divided, so a text longer than a bucket makes that bucket longer; an empty table
gives no rows; if the table has a column ``shard`` or ``position``, the
operator's own column gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bundlewright.durable import written
from bundlewright.llm.common import free_name, table

SEED = 20240611
#: Bytes of a bucket's records; a task holds a bucket twice while it permutes it.
BUCKET_BYTES = 48 << 20
#: Buckets that one task writes to.
FANOUT = 2_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): from the last place down, each is swapped with one drawn from those up to it."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    draws = (rng.random(max(0, n - 1)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draws):
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def _bytes(field: T.StructField) -> Column:
    """About how many bytes a value takes: the length of strings, of JSON for nested values, 8 for others."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(value)))
    return F.lit(8)


def bucket_count(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the table's size."""
    row = F.lit(8).cast("long")
    for field in df.schema:
        row = row + _bytes(field)
    total = df.agg(F.sum(row).alias("b")).first()["b"] or 0
    return max(1, -(-total // bucket_bytes))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def _hashable(df: DataFrame) -> list[Column]:
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]


@F.arrow_udf(T.LongType())
def _nth(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """How many equal hashes the partition had before each."""
    seen: dict[int, int] = {}
    for batch in hashes:
        h = batch.to_numpy()
        order = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(new, len(h)))
        before = []
        for k, n in zip(h[order[new]].tolist(), count.tolist()):
            before.append(seen.get(k, 0))
            seen[k] = before[-1] + n
        out = np.empty(len(h), dtype=np.int64)
        out[order] = np.arange(len(h)) + np.repeat(np.array(before, dtype=np.int64) - new, count)
        yield pa.array(out)


def shuffled(df: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The table with each record's shard and its position there; a partition is a shard, in its order."""
    shard, position, key = free_name(df, "shard"), free_name(df, "position"), free_name(df, "_sharding_key")
    n = bucket_count(df, bucket_bytes)
    hashed = df.withColumn(key, F.xxhash64(F.lit(seed), *_hashable(df)))
    hashed = hashed.withColumn(key, F.xxhash64(F.col(f"`{key}`"), F.spark_partition_id(), _nth.asNondeterministic()(F.col(f"`{key}`"))))
    # The key is mixed again: its own remainder would leave the keys of a bucket alike.
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)), F.lit(n)).cast("int")
    scattered = hashed.withColumn(shard, bucket)
    if n > fanout:
        group = F.floor(F.col(f"`{shard}`") / fanout).cast("int")
        scattered = written(scattered.repartitionById(-(-n // fanout), group))
    scattered = scattered.repartitionById(n, F.col(f"`{shard}`"))
    out = T.StructType([*df.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(position, T.LongType())])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held)
        held.clear()
        number = whole.column(shard)[0].as_py()
        by_key = pc.sort_indices(whole.column(key)).to_numpy()
        take = by_key[fisher_yates(len(by_key), seed, number)]
        whole = whole.drop_columns([key])
        for at in range(0, len(take), 2_000):
            part = whole.take(pa.array(take[at : at + 2_000])).combine_chunks()
            place = pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))
            yield from part.append_column(position, place).to_batches()

    return scattered.mapInArrow(permute, out)


def write_shards(df: DataFrame, path: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, fanout: int = FANOUT) -> None:
    """Write each shard as one Parquet file under ``path``, its records in their order."""
    shuffled(df, seed, bucket_bytes, fanout).write.mode("overwrite").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
