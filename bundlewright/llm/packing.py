"""Operator 4: hierarchical packing into windows of several lengths.

A document goes to the shortest tier that holds it; one longer than the longest
tier is cut into pieces of that length, and its rest is routed like a document.
From the longest tier down, the tier's own pieces are packed best fit, longest
first, and the gaps left in its windows are filled, longest first, with pieces of
the shorter tiers, which then need no window of their own. Each tier's windows
are dealt to step groups of the same number of tokens, in order of their attention cost
(the sum of squared lengths) and turning at each end, so that the groups cost
about the same.

What goes where depends on lengths alone, so the packing is made for the
histogram of lengths: windows filled alike are one group with a count. It has
at most as many rows as the longest tier has tokens, whatever the size of the
corpus, and gives the same windows as packing piece by piece. A piece finds its
window by its length and its rank among the pieces of that length; ranks are
counted in parts of about ``PART_PIECES`` pieces, so a length that many have, such as that of the pieces of long documents, is no hot key.

Defined cases: documents of null or no tokens take no room and have no row; those of any length are cut and packed whole; a null id is
an id like others, whose rows are spread by themselves;
repeated rows are packed each; ties of length are ordered by a hash of the id,
the id and the piece; an empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bundlewright.durable import cut
from bundlewright.llm.common import TOKENIZERS, sole, table, tokenizers
from bundlewright.llm.token_counts import count_tokens

TIERS = (512, 2048, 8192, 32768)
STEP_TOKENS = 262_144
#: Pieces of one length whose ranks are counted together.
PART_PIECES = 100_000
_WIDE = 1 << 44


class _Tier:
    """Groups of windows by the room left in them."""

    def __init__(self, size: int):
        self.size, self.by_gap, self.gaps, self.full = size, defaultdict(list), [], []

    def add(self, gap: int, count: int, items) -> None:
        if not gap:
            self.full.append((count, items))
            return
        if not self.by_gap[gap]:
            insort(self.gaps, gap)
        self.by_gap[gap].append((count, items))

    def place(self, length: int, rank: int, count: int, new: bool) -> int:
        """Put pieces ``rank`` to ``rank + count`` into the tightest gaps, then into new windows if allowed; how many were put."""
        put = 0
        while put < count:
            at = bisect_left(self.gaps, length)
            if at < len(self.gaps):
                gap = self.gaps[at]
                held, items = self.by_gap[gap].pop()
                if not self.by_gap[gap]:
                    del self.gaps[at]
            elif new:
                gap, held, items = self.size, count, None
            else:
                break
            # What is left of the tightest gap is tighter still: a window is filled before the next is begun.
            each = min(gap // length, count - put)
            n = min(held, (count - put) // each)
            if n < held and items is not None:
                self.add(gap, held - n, ("shift", n, items))
            for k in range(each):
                items = ("item", length, rank + put + k * n, self.size - gap + k * length, items)
            self.add(gap - each * length, n, items)
            put += each * n
        return put

    def groups(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(windows, their items as (length, first rank, offset)), costliest first."""
        out = []
        for count, items in [*self.full, *(g for gap in self.gaps for g in self.by_gap[gap])]:
            found, shift = [], 0
            while items is not None:
                if items[0] == "shift":
                    shift += items[1]
                    items = items[2]
                else:
                    _, length, rank, offset, items = items
                    found.append((length, rank + shift, offset))
            out.append((count, found[::-1]))
        return sorted(out, key=lambda g: (-sum(x[0] ** 2 for x in g[1]), -len(g[1]), g[1]))


def plan(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, list[int]]:
    """Slots (length, first rank, tier, first window, offset), sorted by length and rank, and each tier's windows.

    A slot serves the pieces of its length from its first rank to the next slot's; each piece has one window more.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots, windows = [], [0] * len(tiers)
    for t in range(len(tiers) - 1, -1, -1):
        tier, least = _Tier(tiers[t]), tiers[t - 1] if t else 0
        for length in sorted((n for n in left if n <= tiers[t]), reverse=True):
            if left[length]:
                n = tier.place(length, used[length], left[length], length > least)
                left[length] -= n
                used[length] += n
        for count, items in tier.groups():
            slots += ((length, rank, t, windows[t], offset) for length, rank, offset in items)
            windows[t] += count
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 5), windows


def _steps(window: np.ndarray, n_steps: np.ndarray) -> np.ndarray:
    row, column = window // n_steps, window % n_steps
    return np.where(row % 2 == 0, column, n_steps - 1 - column)


def pack(
    lengths: DataFrame,
    id_col: str = "doc_id",
    length: str = "n_tokens",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    part_pieces: int = PART_PIECES,
) -> DataFrame:
    """Where each piece of each document goes.

    (doc_id, piece, start, n_tokens, tier, window, offset, step): ``tier`` is the
    window's size, ``window`` its number in the tier, ``offset`` the piece's place in
    it, ``step`` the tier's step group that the window belongs to.
    """
    tiers = tuple(sorted(tiers))
    longest = tiers[-1]
    narrow = sole(lengths, id_col, length).toDF("doc_id", "total").where("total > 0")
    pieces = narrow.select(
        "doc_id",
        F.col("total").cast("long").alias("total"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / longest).cast("int"))).alias("piece"),
    ).select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * longest).alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("total") - F.col("piece").cast("long") * longest).cast("int").alias("size"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("piece", F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id", "piece")).alias("drawn"),
    )
    pieces = cut(pieces)
    lengths_of = pieces.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / part_pieces).cast("int").alias("parts"))  # at most as many rows as the longest tier has tokens
    pieces = pieces.join(F.broadcast(lengths_of), "size").withColumn("bucket", F.pmod(F.xxhash64("drawn"), F.col("parts")).cast("int"))
    counts = pieces.groupBy("size", "bucket").count().collect()  # and one more for each part
    counts = np.array(sorted((r["size"], r["bucket"], r["count"]) for r in counts), dtype=np.int64).reshape(-1, 3)
    total = np.bincount(counts[:, 0], weights=counts[:, 2], minlength=longest + 1).astype(np.int64)
    # Places of (size, bucket) and the pieces of that size before each.
    part = counts[:, 0] * _WIDE + counts[:, 1]
    before = np.cumsum(counts[:, 2]) - counts[:, 2] - (np.cumsum(total) - total)[counts[:, 0]]
    slots, windows = plan({n: int(c) for n, c in enumerate(total) if c}, tiers)
    sizes = np.array(tiers, dtype=np.int64)
    per_step = np.maximum(1, step_tokens // sizes)
    n_steps = np.maximum(1, -(-np.array(windows, dtype=np.int64) // per_step))
    shared = lengths.sparkSession.sparkContext.broadcast((part, before, slots, sizes, n_steps))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, slots, sizes, n_steps = shared.value
        starts = slots[:, 0] * _WIDE + slots[:, 1]
        for batch in batches:
            size = batch.column("size").to_numpy().astype(np.int64)
            rank = before[np.searchsorted(part, size * _WIDE + batch.column("bucket").to_numpy())] + batch.column("nth").to_numpy() - 1
            slot = slots[np.searchsorted(starts, size * _WIDE + rank, side="right") - 1]
            window = slot[:, 3] + rank - slot[:, 1]
            step = _steps(window, n_steps[slot[:, 2]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("piece"),
                    batch.column("start"),
                    *map(pa.array, (size, sizes[slot[:, 2]], window, slot[:, 4], step)),
                ],
                out.fieldNames(),
            )

    kind = pieces.schema["doc_id"].dataType
    longs = ("start", "n_tokens", "tier", "window", "offset", "step")
    out = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in longs)]
    )
    by = Window.partitionBy("size", "bucket").orderBy("drawn", "doc_id", "piece")
    ranked = pieces.withColumn("nth", F.row_number().over(by).cast("long"))
    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Pack documents by their exact numbers of tokens."""
    return pack(count_tokens(docs, id_col, text, folder).select("doc_id", "n_tokens"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), folder=tokenizers(spark))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
