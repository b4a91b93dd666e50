"""Words of whole Arrow columns as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken at a time; a longer text is taken alone. Results don't depend on it, but arrays of many times this size are made.
SLICE_BYTES = 1 << 19
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # only glibc has it
    _trim = None
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that belong to a word: letters, digits and all that isn't ASCII, but for blanks and signs beyond it (see ``find``).
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: Bytes that belong to a word: all but white space.
SOLID = np.array([b not in b" \t\n\r\f\v" for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system. A worker is kept between tasks, and else keeps what its largest task freed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets): the column's rows in runs of about ``most`` bytes; null is empty. After several runs memory is given back."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    if offsets[n] - offsets[0] > most:
        give_back()


def _scripts(data: np.ndarray, solid: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Marks blanks and signs beyond ASCII as outside words; the places where a character starts or ends that is a word by itself.

    ``inside`` is ``solid`` of each byte, with one more before and after. Scripts without blanks (Chinese, Japanese, Thai and its neighbours)
    have a word for each character.
    """
    signs = not solid[ord("!")]  # else only white space divides
    wide = np.flatnonzero((data >= 0xE0) & (data <= 0xE9))
    wide = wide[wide + 2 < len(data)]
    lead, second, third = data[wide], data[wide + 1], data[wide + 2]
    blank = ((lead == 0xE2) & (((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F)))) | (
        (lead == 0xE3) & (second == 0x80) & (third == 0x80)
    )
    if signs:
        blank |= ((lead == 0xE2) & (second <= 0x81)) | ((lead == 0xE3) & (second == 0x80) & (third < 0xA0))
    gone = wide[blank]
    for k in range(3):
        inside[gone + 1 + k] = False
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], [0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF] if signs else [0xA0, 0x85])]
    inside[two + 1] = inside[two + 2] = False
    lone = wide[~blank & (((lead >= 0xE3) | ((lead == 0xE0) & ((second == 0xB8) | (second == 0xB9) | (second == 0xBA) | (second == 0xBB))) | ((lead == 0xE1) & ((second == 0x80) | (second == 0x81) | (second == 0x82) | (second == 0x9E) | (second == 0x9F)))))]
    return np.concatenate([lone, lone + 3])


def find(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): each word's bytes, and for each row the number of words before it, with the total at the end."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = solid[data]
    lone = _scripts(data, solid, inside)
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    edge = np.concatenate([edge, lone[(lone > 0) & (lone < len(data))]])
    across = edge[inside[edge] & inside[edge + 1]]
    starts[across] = ends[across] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    h = mix((eight[start] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * _GOLD)
    at, done = np.flatnonzero(length > 8), 8
    while len(at):
        more = eight[start[at] + done] & _MASKS[np.minimum(length[at] - done, 8)]
        h[at] = mix(h[at] * np.uint64(3) + more)
        done += 8
        at = at[length[at] > done]
    return h


def pairs_of(h: np.ndarray, step: int) -> np.ndarray:
    """From the hashes of n-grams those of the 2n-grams; ``step`` is n."""
    return mix(h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]) if len(h) > step else h[:0]


def numbers(h: np.ndarray) -> np.ndarray:
    """Unsigned as signed, for Spark."""
    return h.view(np.int64)
