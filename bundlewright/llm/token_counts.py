"""Operator 8: exact token counts by the whole-token shortcut.

Offline, every string of the vocabulary is merged once: those that come out as
one token are proved to encode alone as one, and since merging never crosses a
pre-token's ends, a pre-token equal to such a string is one token wherever it
stands. Such pre-tokens are counted by lookup; only the rest are merged, and
their lengths are remembered in a table of bounded size. The proof is made once, by the driver, and sent to the workers.

Defined cases: a null text has null counts; an empty one has zeros; texts of any
length are counted whole; repeated rows each give a row; an empty table gives
no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.llm import pretokens, words
from bundlewright.llm.common import TOKENIZERS, sole, table, tokenizers

#: Merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 300_000


def _merger(folder: str) -> Callable[[bytes], int]:
    """Tokens of one pre-token, by the library's merge loop."""
    import tiktoken

    core = tiktoken.Encoding(
        "byte-bpe", pat_str=pretokens.PATTERN, mergeable_ranks=pretokens.ranks(folder), special_tokens={}
    )._core_bpe
    return lambda piece: len(core.encode_single_piece(piece))


@lru_cache(4)
def proved_whole(folder: str = TOKENIZERS) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token: each is merged, and only those that end as one count.

    Strings that are not text by themselves can't be a pre-token and are left out.
    """
    _, pair_rank = pretokens.merges(folder)
    whole = set()
    for token in pretokens.ranks(folder):
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(token) == 1 or pretokens.merge(token, pair_rank) == [token]:
            whole.add(text)
    pretokens.merges.cache_clear()  # large, and needed no more
    return frozenset(whole)


class Lengths:
    """Numbers of tokens of many pre-tokens at once: proved strings are 1, others are merged when first met."""

    def __init__(self, folder: str, proved: frozenset[str] | None = None):
        self.proved, self.merge = proved_whole(folder) if proved is None else proved, _merger(folder)
        self._anew()

    def _anew(self) -> None:
        """Remember the proved strings only."""
        self.memory = pretokens.Memory(REMEMBERED + len(self.proved))
        each = [t.encode() for t in self.proved]
        data = np.frombuffer(b"".join(each), dtype=np.uint8)
        end = np.cumsum([len(t) for t in each])
        h = np.unique(pretokens.hashed(data, end - np.array([len(t) for t in each]), end))
        self.memory.put(h, np.ones(len(h), dtype=np.int64))

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = pretokens.hashed(data, start, end)
        out, missing = self.memory.get(h)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            counts = np.array([self.merge(data[a:b].tobytes()) for a, b in zip(start[at].tolist(), end[at].tolist())], dtype=np.int64)
            out[missing] = counts[back]
            if self.memory.held + len(new) > self.memory.most:
                self._anew()  # then what was just merged is met again like any other
            else:
                self.memory.put(new, counts)
        return out


_LENGTHS: dict[str, Lengths] = {}


def lengths(folder: str, proved: frozenset[str] | None = None) -> Lengths:
    """Those of this process."""
    if folder not in _LENGTHS:
        _LENGTHS[folder] = Lengths(folder, proved)
    return _LENGTHS[folder]


def count_texts(data: np.ndarray, offsets: np.ndarray, folder: str = TOKENIZERS, proved: frozenset[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, pre-tokens, pre-tokens that are one token) of each text."""
    start, end, first = pretokens.find(data, offsets)
    each = lengths(folder, proved).of(data, start, end)
    tokens, whole = (np.concatenate([[0], np.cumsum(x)])[first] for x in (each, each == 1))
    return np.diff(tokens), np.diff(first), np.diff(whole)


def count_text(text: str, folder: str = TOKENIZERS) -> tuple[int, int, int]:
    """(tokens, pre-tokens, pre-tokens that are one token)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    return tuple(int(x[0]) for x in count_texts(data, np.array([0, len(data)]), folder))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """One row for each document with its exact number of tokens; the documents aren't shuffled."""
    narrow = sole(docs, id_col, text).toDF("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(proved_whole(folder))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_texts(data, offsets, folder, shared.value) for _, data, offsets in words.slices(batch.column(1))]
            missing = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            columns = [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64), mask=missing) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    counted = narrow.mapInArrow(count, f"doc_id {kind}, n_tokens long, n_pretokens long, n_whole long")
    return counted.withColumn("n_merged", F.col("n_pretokens") - F.col("n_whole"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), folder=tokenizers(spark))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
