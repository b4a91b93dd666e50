"""MinHash signatures that any SQL engine can compute again."""

from __future__ import annotations

import ctypes
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 128
PRIME = (1 << 31) - 1


def coefficients(k: int = SLOTS, seed: int = 0x5EED) -> list[tuple[int, int]]:
    """(a, b) of each slot's function h -> (a h + b) mod PRIME."""
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(k)]


def term_hash(term: Column) -> Column:
    """28 bits of a term's MD5: small enough for the products to fit a long."""
    return F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("long")


def give_back() -> None:
    """Return freed memory to the system: a worker is kept between tasks, and else keeps what its largest batch freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def _least(k: int):
    """An Arrow function from arrays of term hashes to their signatures; whole batches at once."""
    a, b = (np.array(x, dtype=np.int64)[:, None] for x in zip(*coefficients(k)))

    @F.arrow_udf("array<bigint>")
    def least(hashes: pa.Array) -> pa.Array:
        lists = hashes.cast(pa.large_list(pa.int64()))
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten().to_numpy()
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)
        out = np.zeros((len(full), k), dtype=np.int64)
        at = 0
        while at < len(full):  # about 10,000 terms at a time, whose products stay in the processor's cache
            to = max(at + 1, int(np.searchsorted(ends[full], ends[full[at]] - sizes[full[at]] + 10_000, side="right")))
            low = ends[full[at]] - sizes[full[at]]
            slots = (a * flat[low : ends[full[to - 1]]] + b) % PRIME
            out[at:to] = np.minimum.reduceat(slots, ends[full[at:to]] - sizes[full[at:to]] - low, axis=1).T
            at = to
        del flat, lists, hashes
        give_back()
        places = np.concatenate([[0], np.cumsum(sizes > 0) * k]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(out.reshape(-1)), mask=pa.array(sizes == 0))

    return least


def minhash(terms: Column, k: int = SLOTS) -> Column:
    """The signature of an array of distinct terms; null if it is empty. No shuffle: each row has all it needs.

    Terms are hashed in the JVM; the slots' products, some tens of thousands for a row, take numpy a
    fiftieth of the time that nested array functions take.
    """
    return _least(k)(F.transform(terms, term_hash))


def jaccard_estimate(a: Column, b: Column) -> Column:
    """The share of slots that agree; 0 if a signature is missing."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNotNull() & b.isNotNull(), same / F.size(a)).otherwise(F.lit(0.0))
