"""Operator 1: chat formatting with offset-aligned masks.

The turns of a conversation are rendered to one text by a template, and where
each turn's own words start and end in it is noted in bytes. The text is encoded
once; the ids' lengths give each token's place. Both lists of spans are sorted
and don't overlap, so a binary search of the turns' ends among the tokens' gives the
tokens of each turn. The loss mask is 1 for the tokens that lie wholly in what a trained
role wrote, or in the mark that ends it: a token that reaches over
the edge of a turn is not trained.

The template's marks are ids of their own, beyond the vocabulary's: ``OPEN_ID`` and ``CLOSE_ID``. The same characters
typed by a user are plain text and give other ids, so nobody can end a turn from within it. All conversations of a
slice are rendered to one array of bytes, encoded together, and intersected by one search.

Defined cases: rows with a null conversation are left out; a null text is
empty, a null role ``unknown``; turns of equal number (or without one, which come first)
are ordered by role and text; repeated rows are turns of their own; texts of any length are encoded whole; an empty table gives no rows;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.llm import transducer
from bundlewright.llm.common import TOKENIZERS, sole, table, tokenizers

OPENS, BETWEEN, CLOSES, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"
#: The vocabulary has 50,257 ids; these are the next.
OPEN_ID, CLOSE_ID = 50_257, 50_258
TRAINED = ("assistant",)
#: Bytes of conversations that are rendered and encoded together; a longer one is taken alone.
SLICE_BYTES = 1 << 20


def tokens_within(spans: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): for each span the tokens first to before last lie wholly in it; ``ends`` has the end of each token."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(starts, spans[:, 0], side="left")
    last = np.searchsorted(ends, spans[:, 1], side="right")
    return first, np.maximum(first, last)


_KNOWN: dict[str, np.ndarray] = {}


def _lengths(folder: str) -> np.ndarray:
    """Bytes of each id, those of the marks with them."""
    if folder not in _KNOWN:
        sizes = np.zeros(CLOSE_ID + 1, dtype=np.int64)
        known = transducer._bytes_of(folder)
        sizes[: len(known)] = [len(t) for t in known]
        sizes[OPEN_ID], sizes[CLOSE_ID] = len(OPENS), len(CLOSES)
        _KNOWN[folder] = sizes
    return _KNOWN[folder]


def format_turns(roles: list[str], texts: list[str], n_turns: np.ndarray, folder: str = TOKENIZERS, trained: tuple[str, ...] = TRAINED) -> tuple[np.ndarray, ...]:
    """(ids, mask, place, first, last) of some conversations, one after another: ``n_turns`` of the turns belong to each.

    ``place`` has each conversation's first id, with the total at the end; ``first`` and ``last`` the tokens of each turn, counted
    within its conversation.
    """
    heads = [(r + BETWEEN).encode("utf-8", "replace") for r in roles]
    bodies = [t.encode("utf-8", "replace") for t in texts]
    after = AFTER.encode()
    # Between the marks stand two stretches of plain text for each turn: role and text, and what follows the closing mark.
    plain = [x for h, b in zip(heads, bodies) for x in (h + b, after)]
    size = np.array([len(x) for x in plain], dtype=np.int64)
    data = np.frombuffer(b"".join(plain), dtype=np.uint8)
    ids, where = transducer.encode_texts(data, np.concatenate([[0], np.cumsum(size)]), folder)
    count = np.diff(where)
    ids = np.insert(ids, where[:-1], np.tile(np.array([OPEN_ID, CLOSE_ID], dtype=np.int32), len(roles)))
    tokens = np.concatenate([[0], np.cumsum(count + 1)])  # first token of each mark with the stretch after it
    turns = np.concatenate([[0], np.cumsum(n_turns)])
    place = tokens[2 * turns]
    whole = np.concatenate([[0], np.cumsum(size.reshape(-1, 2).sum(axis=1) + len(OPENS) + len(CLOSES))])  # bytes before each turn
    head = np.array([len(h) for h in heads], dtype=np.int64)
    start = whole[:-1] + len(OPENS) + head
    spans = np.stack([start, start + np.array([len(b) for b in bodies], dtype=np.int64) + len(CLOSES)], axis=1)
    first, last = tokens_within(spans, np.cumsum(_lengths(folder)[ids]))
    edges = np.zeros(len(ids) + 1, dtype=np.int32)
    on = np.isin(np.array(roles, dtype=object), trained) if roles else np.zeros(0, dtype=bool)
    np.add.at(edges, first[on], 1)
    np.add.at(edges, last[on], -1)
    base = np.repeat(place[:-1], n_turns)
    return ids, np.cumsum(edges[:-1], dtype=np.int32), place, first - base, last - base


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, one past the last) of runs of conversations of about ``SLICE_BYTES``."""
    flat = texts.flatten()
    size = np.concatenate([[0], np.cumsum(np.array([len(t) for t in flat.to_pylist()], dtype=np.int64))])
    size = size[np.concatenate([[0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)]
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE_BYTES, side="right")) - 1)
        yield at, min(to, n)
        at = to


def format_chats(
    chats: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    folder: str = TOKENIZERS,
    trained: tuple[str, ...] = TRAINED,
) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_trained, token_ids, loss_mask, turn_first, turn_last), one row for each conversation."""
    narrow = sole(chats, conv, turn, role, text).toDF("conv_id", "turn", "role", "text").where("conv_id is not null")
    narrow = narrow.withColumns({"role": F.coalesce("role", F.lit("unknown")), "text": F.coalesce("text", F.lit(""))})
    whole = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = whole.schema["conv_id"].dataType.simpleString()

    def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a, b in _slices(big.column("texts")):
                batch = big.slice(a, b - a)
                roles, texts = (batch.column(n) for n in ("roles", "texts"))
                n_turns = roles.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ids, mask, place, first, last = format_turns(roles.flatten().to_pylist(), texts.flatten().to_pylist(), n_turns, folder, trained)
                done = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[place]
                turns = np.concatenate([[0], np.cumsum(n_turns)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), *(pa.array(x) for x in (n_turns, np.diff(place), np.diff(done))), lists(ids, place), lists(mask, place), lists(first, turns), lists(last, turns)],
                    ["conv_id", "n_turns", "n_tokens", "n_trained", "token_ids", "loss_mask", "turn_first", "turn_last"],
                )

    columns = ", ".join(f"{n} array<int>" for n in ("token_ids", "loss_mask", "turn_first", "turn_last"))
    return whole.mapInArrow(run, f"conv_id {kind}, n_turns long, n_tokens long, n_trained long, {columns}")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"), folder=tokenizers(spark))


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
ORACLES: dict[str, str] = {}
