"""Operator 9: BPE encoding and decoding as streams of bounded memory.

**Lookahead.** Merges are applied in order of rank. Suppose two continuations of
a known text, and let q be the end of the part that both segment alike so far; at
first q is the end of the known text. The merge (u, v) can move q only if u ends
at q, and then by the length of u. Whichever continuation goes on, the token that
now starts at the new q starts with u, so a later merge (u', v') can move q again
only if u is a prefix of v'. Hence q moves by at most
``max f`` with ``f(u', v') = |u'| + max f(u, v)`` over earlier merges whose u is a
prefix of v'. That many bytes of lookahead are sufficient: a token that ends
further than this before the end of the known text is never changed by what
follows. And what follows a final token is segmented as if it stood alone.

**Encoder.** The bytes of texts come in blocks of ``BLOCK``, wherever those cut a text, so a text of any length is
taken in by parts and never held whole. Of a text that goes on in the next block, all
pre-tokens but the last two are final and go out at once; the last may grow, and with the one before
it may be split anew at white space or an apostrophe, so these are held. Once the last is longer than ``LONG`` it is a run
of one class, whose end is certain, and its bytes are passed on to a transducer for pre-tokens as they come, which gives out
tokens once they are stable. Every pre-token goes through that transducer; what it gave for short ones is
remembered, for whole blocks at a time.

**Decoder.** A state machine over bytes holds at most the three of an unfinished
character and gives out text for each group of tokens.

Defined cases: a null text gives null tokens; an empty one no tokens; texts of any length are encoded whole; lone
surrogates are encoded as ``?``; bytes that aren't UTF-8 are decoded as U+FFFD for
each ill-formed part, and so is an id that is null or unknown; null ids give a null text; repeated rows each give a row; an
empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from bundlewright.llm import pretokens, words
from bundlewright.llm.common import TOKENIZERS, sole, table, tokenizers

#: Bytes of text that the encoder takes in at a time.
BLOCK = 1 << 19
#: Pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Longer pre-tokens aren't remembered.
LONGEST_REMEMBERED = 64


def sufficient_lookahead(pair_rank: dict[tuple[bytes, bytes], int]) -> int:
    """Bytes of lookahead after which tokens are stable (see above)."""
    best: dict[bytes, int] = {}
    most = 0
    for (u, v), _ in sorted(pair_rank.items(), key=lambda x: x[1]):
        f = len(u) + max((best.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        if f > best.get(u, 0):
            best[u] = f
        most = max(most, f)
    return most


class PieceTransducer:
    """Tokens of one pre-token whose bytes come in parts."""

    def __init__(self, pair_rank: dict[tuple[bytes, bytes], int], lookahead: int):
        self.pair_rank, self.lookahead, self.held = pair_rank, lookahead, b""
        self.room = 4 * lookahead + 64

    def feed(self, data: bytes) -> Iterator[bytes]:
        for at in range(0, len(data), self.room):
            self.held += data[at : at + self.room]
            if len(self.held) > 2 * self.lookahead:
                yield from self._stable()

    def _stable(self) -> Iterator[bytes]:
        limit, end, out = len(self.held) - self.lookahead, 0, []
        for token in pretokens.merge(self.held, self.pair_rank):
            if end + len(token) > limit:
                break
            end += len(token)
            out.append(token)
        self.held = self.held[end:]
        yield from out

    def finish(self) -> Iterator[bytes]:
        rest, self.held = self.held, b""
        yield from pretokens.merge(rest, self.pair_rank)


class Vocabulary:
    """Ids by token, merges and their lookahead."""

    def __init__(self, folder: str):
        self.ids, self.pair_rank = pretokens.merges(folder)
        self.lookahead = sufficient_lookahead(self.pair_rank)

    def machine(self) -> PieceTransducer:
        return PieceTransducer(self.pair_rank, self.lookahead)

    def numbers(self, tokens: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int32)

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of one whole pre-token."""
        machine = self.machine()
        return self.numbers([*machine.feed(data), *machine.finish()])


@lru_cache(4)
def vocabulary(folder: str) -> Vocabulary:
    return Vocabulary(folder)


class Pieces:
    """Ids of many whole pre-tokens at once; those met before are looked up, others go through the transducer."""

    def __init__(self, folder: str):
        self.vocabulary = vocabulary(folder)
        self._anew()

    def _anew(self) -> None:
        self.memory, self.pool = pretokens.Memory(REMEMBERED), np.zeros(0, dtype=np.int32)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): all ids, and each pre-token's first place among them, with the total at the end."""
        h = pretokens.hashed(data, start, end)
        where, missing = self.memory.get(h)
        pool = self.pool
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[one]
            each = [self.vocabulary.encode(data[a:b].tobytes()) for a, b in zip(start[at].tolist(), end[at].tolist())]
            count = np.array([len(e) for e in each], dtype=np.int64)
            pool = np.concatenate([pool, *each])
            spot = (len(self.pool) + np.cumsum(count) - count) << 24 | count
            where[missing] = spot[back]
            short = (end - start)[at] <= LONGEST_REMEMBERED
            if self.memory.held + int(short.sum()) > REMEMBERED:
                self._anew()
            else:
                self.memory.put(new[short], spot[short])
                self.pool = pool
        count = where & ((1 << 24) - 1)  # a block has fewer bytes
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat((where >> 24) - total[:-1], count) + np.arange(total[-1])
        return pool[take], total


@lru_cache(4)
def pieces_of(folder: str) -> Pieces:
    return Pieces(folder)


def blocks(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(row, bytes, offsets, goes_on): a column in blocks, each with its first row's number; ``goes_on`` if the next goes on in its last row."""
    at, n, most = 0, int(offsets[-1]), most or BLOCK
    row = 0
    while True:
        to = min(at + most, n)
        while to < n and to > at and (data[to] & 0xC0) == 0x80:
            to -= 1
        last = int(np.searchsorted(offsets, to, side="left")) if to < n else len(offsets) - 1
        edges = np.concatenate([[at], offsets[row + 1 : last], [to]])
        goes_on = to < int(offsets[last])
        yield row, data[at:to], edges - at, goes_on
        if to >= n:
            return
        row, at = last - 1 if goes_on else last, to


class Encoder:
    """The transducer of texts: bytes go in block by block, ids come out once they are final."""

    LONG = 2048
    KINDS = {"space": regex.compile(r"\s+"), "letters": regex.compile(r"\p{L}+"), "digits": regex.compile(r"\p{N}+"), "other": regex.compile(r"[^\s\p{L}\p{N}]+")}

    def __init__(self, folder: str = TOKENIZERS):
        self.vocabulary, self.pieces = vocabulary(folder), pieces_of(folder)
        self.held, self.run, self.kind = np.zeros(0, dtype=np.uint8), None, ""

    def _through_run(self, data: np.ndarray, ended: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """(ids, the bytes that are left, whether the run may go on): the part of a text that still belongs to the open run goes to its machine."""
        text = data.tobytes().decode("utf-8", "surrogatepass")
        found = self.KINDS[self.kind].match(text)
        end = found.end() if found else 0
        open_end = end == len(text) and not ended
        if self.kind == "space" and (end < len(text) or not ended):
            end = max(0, end - 1)  # the last blank goes to what follows
        head = text[:end].encode("utf-8", "surrogatepass")
        tokens = list(self.run.feed(head))
        if not open_end:
            tokens += self.run.finish()
            self.run = None
        return self.vocabulary.numbers(tokens), data[len(head) :], open_end

    def feed(self, data: np.ndarray, offsets: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids that are final by now, and each row's first place among them, with the total at the end.

        The first row goes on where the last one stopped, if that wasn't ended; ``goes_on`` says whether the last row does.
        """
        if len(self.held):
            data = np.concatenate([self.held, data])
            offsets = np.concatenate([[0], offsets[1:] + len(self.held)])
        self.held = data[:0]
        lead, rows = np.zeros(0, dtype=np.int32), len(offsets) - 1
        if self.run is not None:
            lead, rest, open_end = self._through_run(data[: offsets[1]], rows > 1 or not goes_on)
            if open_end:
                self.held = rest.copy()
                return lead, np.array([0, len(lead)])
            gone = int(offsets[1]) - len(rest)
            data, offsets = data[gone:], np.concatenate([[0], offsets[1:] - gone])
        start, end, first = pretokens.find(data, offsets)
        stop = len(start)
        if goes_on and first[-1] > first[-2]:
            last = stop - 1
            if end[last] - start[last] > self.LONG:
                stop, text = last, data[start[last] :].tobytes().decode("utf-8", "surrogatepass")
                self.kind = next(k for k, p in self.KINDS.items() if p.match(text[-1]))
                self.run = self.vocabulary.machine()
                head = text[: len(text) - (self.kind == "space")].encode("utf-8", "surrogatepass")
                begun = self.vocabulary.numbers(self.run.feed(head))
                self.held = data[start[last] + len(head) :].copy()
            else:
                stop = max(int(first[-2]), stop - 2)
                self.held, begun = data[start[stop] :].copy(), lead[:0]
            first = np.minimum(first, stop)
        else:
            begun = lead[:0]
        ids, places = self.pieces.encode(data, start[:stop], end[:stop])
        first = places[first] + len(lead)
        first[0] = 0
        first[-1] += len(begun)
        return np.concatenate([lead, ids, begun]), first


def encode_texts(data: np.ndarray, offsets: np.ndarray, folder: str = TOKENIZERS, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): all ids of some texts, and each text's first place among them, with the total at the end."""
    encoder, parts, count = Encoder(folder), [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for row, part, edges, goes_on in blocks(data, offsets, block):
        ids, first = encoder.feed(part, edges, goes_on)
        parts.append(ids)
        count[row : row + len(first) - 1] += np.diff(first)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])


def encode(text: str, folder: str = TOKENIZERS, block: int | None = None) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    return encode_texts(data, np.array([0, len(data)]), folder, block)[0]


class Utf8Machine:
    """Bytes in parts to text. The state is what an unfinished character has so far: its bytes and what may follow."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(tail: bytes) -> int:
        """How many bytes at the end of ``tail`` start a character that needs more."""
        for back in range(1, min(3, len(tail)) + 1):
            b = tail[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
                if back >= need:
                    return 0
                if back > 1:
                    second = tail[-back + 1]
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                    if not low <= second <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.unfinished(data[-3:])
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@lru_cache(4)
def _bytes_of(folder: str) -> list[bytes]:
    ids, _ = pretokens.merges(folder)
    out = [b""] * (max(ids.values()) + 1)
    for token, number in ids.items():
        out[number] = token
    return out


def decode(ids: Iterable[int | None] | np.ndarray, folder: str = TOKENIZERS, group: int = 1 << 14) -> str:
    """Text of the ids, a group at a time."""
    known, machine, out = _bytes_of(folder), Utf8Machine(), []
    ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
    for at in range(0, len(ids), group):
        part = ids[at : at + group]
        if None in part or min(part) < 0 or max(part) >= len(known):
            part = [known[i] if i is not None and 0 <= i < len(known) else b"\xff" for i in part]
            out.append(machine.feed(b"".join(part)))
        else:
            out.append(machine.feed(b"".join(map(known.__getitem__, part))))
    return "".join([*out, machine.finish()])


def encode_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens, token_ids, restored): restored says whether decoding the ids gives the text again."""
    narrow = sole(docs, id_col, text).toDF("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in words.slices(batch.column(1)):
                part = batch.slice(at, len(offsets) - 1)
                missing = part.column(1).is_null().to_numpy(zero_copy_only=False)
                ids, first = encode_texts(data, offsets, folder)
                same = [None if t is None else decode(ids[a:b], folder) == t for t, a, b in zip(part.column(1).to_pylist(), first, first[1:])]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first), mask=missing), lists, pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "token_ids", "restored"],
                )

    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>, restored boolean")


def decode_table(encoded: DataFrame, id_col: str = "doc_id", ids: str = "token_ids", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of encoded documents."""
    narrow = sole(encoded, id_col, ids).toDF("doc_id", "token_ids")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, folder) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return narrow.mapInArrow(run, f"doc_id {kind}, text string")


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), folder=tokenizers(spark))


QUERIES = {"op9_bpe_transducer": op9_bpe_transducer}
ORACLES: dict[str, str] = {}
