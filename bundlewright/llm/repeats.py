"""Operator 6: maximal repeats over all documents, from the interval trees of an enhanced suffix array.

A word is a run of anything but white space. A repeat is a sequence of at least
``LEAST`` words with two occurrences or more, in one document or several; it is
maximal if its occurrences are neither all preceded nor all followed by the same
word (a document's ends count as words of their own). Every maximal repeat is given with all
its occurrences, which are listed by document.

The suffix array of a corpus fits no machine, and most of it has no repeat, so
it is split into the subtrees that do.

1. Anchors: of every ``WINDOW`` neighbouring runs of ``GRAM`` words the one of least hash
   is an anchor. A repeat has a whole such window, so all its occurrences
   have the same anchor in their first window: to that anchor's subtree the repeat belongs,
   and to no other.
2. Anchors of equal words are a subtree. It is dropped if the words to their left,
   as far back as a first window could start, are all the same: then nothing starts here
   that could not be extended to the left.
3. The contexts of the rest are sent to the subtree. It has two suffix arrays,
   of the words from the anchor on and of those before it read backwards, with their
   common prefixes. A stack scan of the second gives the places where occurrences branch to the
   left; for those below each, a stack scan of the first gives the
   intervals of the common-prefix tree, and those that take in several branches are
   maximal repeats.
4. Right contexts are sent as far as ``REACH`` words. Occurrences that are alike
   all the way form a subtree of their own, which is treated again with
   eight times the reach, until none is left. So lengths have no bound.

**Equal texts.** A text that several documents have goes through these steps once. Each of its occurrences
counts for all its documents, but is listed for one of them; the whole text is a repeat too, and is listed for each.

**Runs.** A text that repeats itself after at most ``PERIOD`` words, for ``LEAST`` words or more, is a run: one of m words
has some m repeats with some m occurrences each, too many to write out. A repeat that lies in runs alone repeats
itself in that way too, and each of its occurrences lies in one run. So the runs stand for them: runs of the same turn, from whichever of its words,
are one class, with a row for each run, its ``period`` and its ``phase`` (how many words of the turn, in the rotation that its class
names, come before the run's first). All repeats within runs, with all occurrences, follow from
these rows and the words around the runs (:func:`expanded` writes them out). Repeats that are not in
runs alone, such as those that go on after a run's end, are given by themselves like any other.
For them, anchors whose first windows all lie in a run's third or a later turn are left out unless the repeat goes beyond the run: it
has then in all its occurrences as many words from the anchor to the run's end and the same word after it; of
anchors alike in both, those of later turns stay unless the words to their left are all the same (as in 2.).

Defined cases: a null or empty text has no words; texts of fewer than ``LEAST``
words have no repeats; texts of any length are taken whole; rows with the same id and text are one document; rows with the same id
and another text are others with that id; a null id is given as null and comes last in order; an empty table gives no
rows; other columns, of whatever name, are ignored by :func:`repeats` and kept by :func:`cut_out`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bundlewright.durable import cut
from bundlewright.llm import words
from bundlewright.llm.common import free_name, small_enough, sole, table

LEAST, GRAM = 50, 16
WINDOW = LEAST - GRAM + 1
REACH, WIDER = 96, 8
#: Words after which a run repeats itself, at most; so one of ``LEAST`` words has two turns.
PERIOD = LEAST // 2
_LOW = np.uint64((1 << 24) - 1)
_MOST = np.uint64((1 << 64) - 1)


def _window_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:]) if len(v) > have else v[:0]
        have *= 2
    rest = width - have
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest and len(v) > rest else v if not rest else v[:0]


def _turned(gram, sums, down, chosen, before, back, least, last) -> np.ndarray:
    """Which anchors belong only to the third or a later turn of a run of at most ``PERIOD`` words."""
    turned = np.zeros(len(chosen), dtype=bool)
    at = np.flatnonzero(back <= PERIOD)
    at = at[gram[chosen[at] - back[at]] == gram[chosen[at]]]
    turn, a, b = back[at], chosen[at] - back[at] + 1, np.minimum(chosen[at] + np.maximum(LEAST - least[at], back[at] + GRAM), last[at])
    fits = a - 2 * turn >= chosen[at] - before[at]
    at, turn, a, b = at[fits], turn[fits], a[fits], b[fits]
    stretch = [(sums[b - k * turn] - sums[a - k * turn]) * down[a - k * turn] for k in range(3)]
    turned[at] = (stretch[0] == stretch[1]) & (stretch[1] == stretch[2])
    return turned


def _tails(h, gram, sums, down, chosen, ahead, last) -> np.ndarray:
    """A hash of the number of words to the end of the run an anchor is in and the word after it; 0 without a run, or if the row ends with it.

    ``ahead`` is the distance of the next equal anchor, 0 without one, and ``last`` the end of each anchor's row.
    """
    tails = np.zeros(len(chosen), dtype=np.uint64)
    at = np.flatnonzero(ahead)
    at = at[gram[chosen[at]] == gram[chosen[at] + ahead[at]]]
    a, b = chosen[at], chosen[at] + ahead[at]
    low, high = np.zeros(len(at), dtype=np.int64), last[at] - b
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (sums[a + middle] - sums[a]) * down[a] == (sums[b + middle] - sums[b]) * down[b]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    goes_on = b + low < last[at]
    at, length, after = at[goes_on], (ahead[at] + low)[goes_on], (b + low)[goes_on]
    tails[at] = words.mix(h[after] + words.mix(length.astype(np.uint64))) | np.uint64(1)
    return tails


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            factors = np.full(max(n, 1 << 16), b, dtype=np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def anchors(data: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position, gram, left, back, least, turned, tail) of the anchors of some texts.

    ``back`` is how many words before the anchor count, ``least`` the fewest words before it
    at which it is the first window's anchor, ``left`` a hash of those before it; ``own``
    has a number for each row, which takes the place of ``left`` where the row starts in them.
    ``turned`` are those of a run's third or a later turn, given only if they have a ``tail``.
    """
    start, end, first = words.find(data, offsets, words.SOLID)
    h = words.hashes(data, start, end)
    n = len(h)
    gram, step = h, 1
    while step < GRAM:
        gram = words.pairs_of(gram, step)
        step *= 2
    if n < LEAST:
        return (np.zeros(0, np.int64),) * 8
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = np.arange(len(gram), dtype=np.int64)
    v = (gram & ~_LOW) | (place.astype(np.uint64) & _LOW)  # of equal grams the first is least
    v[row[: len(gram)] != row[GRAM - 1 :]] = _MOST
    least = _window_least(v, WINDOW)
    at = np.flatnonzero(row[: n - LEAST + 1] == row[LEAST - 1 :])
    low = (least[at] & _LOW).astype(np.int64)
    chosen = np.unique(at + ((low - at) & int(_LOW)))
    if not len(chosen):
        return (np.zeros(0, np.int64),) * 8
    which = row[chosen]
    before = chosen - first[which]
    around = np.concatenate([np.full(WINDOW, _MOST), v, np.full(WINDOW, _MOST)])
    value = v[chosen]
    back, ahead = np.full(len(chosen), WINDOW), np.full(len(chosen), WINDOW)
    again, high = np.zeros(len(chosen), dtype=np.int64), value | _LOW
    for t in range(WINDOW - 1, 0, -1):
        back[(around[chosen + WINDOW - t] < value) & (t <= before)] = t
        later = around[chosen + WINDOW + t]
        ahead[later < value] = t
        again[(later | _LOW) == high] = t
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    fewest = np.maximum(np.maximum(0, WINDOW - ahead), chosen + LEAST - first[which + 1])
    last = first[which + 1]
    turned = _turned(gram, sums, down, chosen, before, back, fewest, last)
    tail = _tails(h, gram, sums, down, chosen, again, last)
    on = ~turned | (tail != 0)
    chosen, which, before, back, fewest, turned, tail = (x[on] for x in (chosen, which, before, back, fewest, turned, tail))
    since = chosen - np.minimum(back, before)
    left = words.mix((sums[chosen] - sums[since]) * down[since] + back.astype(np.uint64))
    opens = back > before
    left[opens] = own[which[opens]]
    return which, chosen - first[which], gram[chosen], left, back, fewest, turned, tail


def runs(h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, start, n_words, period, phase, class) of each run: the longest stretches of at least ``LEAST`` words that repeat after at most ``PERIOD``.

    The class is the least hash of the turn's rotations, and the phase tells where in that rotation the run starts.
    """
    n, step = len(h), LEAST - PERIOD - 8 + 1
    if n < LEAST:
        return []
    eight = words.pairs_of(words.pairs_of(words.pairs_of(h, 1), 2), 4)
    row, found = None, {}
    for period in range(1, PERIOD + 1):
        # A run of this period has at least LEAST - PERIOD - 7 places in a row whose eight words recur; one of them is looked at.
        at = np.arange(0, len(eight) - period, step)
        if not (eight[at] == eight[at + period]).any():
            continue
        row = np.repeat(np.arange(len(first) - 1), np.diff(first)) if row is None else row
        same = np.zeros(n - period + 2, dtype=bool)
        same[1:-1] = (h[:-period] == h[period:]) & (row[:-period] == row[period:])
        edges = np.flatnonzero(same[1:] != same[:-1])
        begins, ends = edges[::2], edges[1::2] + period
        for a, b in zip(begins.tolist(), ends.tolist()):
            if b - a >= LEAST:
                found.setdefault((a, b), period)  # the smallest period comes first
    out = []
    for (a, b), period in found.items():
        turns = h[a + (np.arange(period)[:, None] + np.arange(period)) % period]
        key = np.full(period, period, dtype=np.uint64)
        for k in range(period):
            key = words.mix(key * np.uint64(3) + turns[:, k])
        least = int(key.argmin())
        out.append((int(row[a]), a - int(first[row[a]]), b - a, period, (period - least) % period, int(key[least : least + 1].view(np.int64)[0])))
    return out


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key, doc_id, text); rows of the same text have the same key."""
    return sole(docs, id_col, text).select(F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def _once(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, copies): (key, doc_id, text, copies) with each text once, under its least id, and (key, doc_id) of texts that several documents have."""
    members = keyed.where("text is not null").select("key", "doc_id").distinct()
    several = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("lead")).where("copies > 1"))
    few = F.broadcast(several) if small_enough(several.count()) else several
    texts = keyed.where("text is not null").join(few, "key", "left").where("copies is null or doc_id <=> lead")
    texts = texts.select("key", "doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    return texts, members.join(few, "key").select("key", "doc_id", "lead")


def _run_table(texts: DataFrame) -> DataFrame:
    """(class, key, doc_id, start, n_words, period, phase, copies) of each run of each text."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in words.slices(batch.column("text")):
                start, end, first = words.find(data, offsets, words.SOLID)
                found = runs(words.hashes(data, start, end), first)
                if found:
                    row, begin, n, period, phase, klass = zip(*found)
                    source = pa.array(np.array(row) + at)
                    key, doc, copies = (batch.column(c).take(source) for c in ("key", "doc_id", "copies"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(klass, pa.int64()), key, doc, *(pa.array(x, pa.int32()) for x in (begin, n, period, phase)), copies],
                        ["class", "key", "doc_id", "start", "n_words", "period", "phase", "copies"],
                    )

    found = texts.mapInArrow(run, f"class long, key long, doc_id {kind}, start int, n_words int, period int, phase int, copies long")
    found = cut(found.distinct())  # rows with the same id and text are one document
    classes = found.groupBy("class").agg(F.sum("copies").alias("n_occurrences"), F.max(F.col("n_words") - F.col("period")).alias("again"))
    classes = cut(classes.where(f"n_occurrences > 1 or again >= {LEAST}").select("class", "n_occurrences"))
    return found.join(F.broadcast(classes) if small_enough(classes.count()) else classes, "class")


def _anchor_table(keyed: DataFrame) -> DataFrame:
    """(gram, left, key, pos, span, turned, tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for at, data, offsets in words.slices(batch.column(1)):
                own = keys[at : at + len(offsets) - 1]
                row, pos, gram, left, back, least, turned, tail = anchors(data, offsets, words.mix(own))
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (gram.view(np.int64), left.view(np.int64), own[row].view(np.int64), pos.astype(np.int32), (back * 64 + least).astype(np.int32), turned, tail.view(np.int64)))],
                        ["gram", "left", "key", "pos", "span", "turned", "tail"],
                    )

    return keyed.select("key", "text").mapInArrow(run, "gram long, left long, key long, pos int, span int, turned boolean, tail long")


_CONTEXT = ("gram", "class", "key", "doc_id", "copies", "pos", "span", "before", "ends", "context")


def _contexts(keyed: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """For each of ``wanted`` (gram, class, key, pos, span) the words before it that count and ``reach`` words from it on."""
    by_key = cut(wanted.groupBy("key").agg(F.collect_set(F.struct("gram", "class", "pos", "span")).alias("at")))
    keys = by_key.select("key")
    if small_enough(keys.count()):
        keyed = keyed.join(F.broadcast(keys), "key", "left_semi")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("at")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends_at = np.cumsum(counts)
            flat = lists.flatten()
            gram, kind_of, pos, span = (flat.field(k).to_numpy() for k in range(4))
            for at, data, offsets in words.slices(batch.column("text")):
                start, end, first = words.find(data, offsets, words.SOLID)
                rows = len(offsets) - 1
                low, high = (ends_at[at - 1] if at else 0), ends_at[at + rows - 1]
                row_of = np.repeat(np.arange(rows), counts[at : at + rows])
                place = first[row_of] + pos[low:high]
                fits = place < first[row_of + 1]
                row_of, place, item = row_of[fits], place[fits], np.arange(low, high)[fits]
                before = np.minimum(span[item] // 64, place - first[row_of])
                last = np.minimum(place + reach, first[row_of + 1])
                ends = last < place + reach
                a, b = start[place - before], end[last - 1]
                for part in _runs(b - a, 2 << 20):
                    length = (b - a)[part]
                    shift = np.concatenate([[0], np.cumsum(length)])
                    take = np.arange(shift[-1]) + np.repeat(a[part] - shift[:-1], length)
                    context = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(shift.astype(np.int64)), pa.py_buffer(data[take])]).cast(pa.binary())
                    source = pa.array(row_of[part] + at)
                    i = item[part]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *map(pa.array, (gram[i], kind_of[i])),
                            batch.column("key").take(source),
                            batch.column("doc_id").take(source),
                            batch.column("copies").take(source),
                            *map(pa.array, (pos[i], span[i], before[part].astype(np.int32), ends[part])),
                            context,
                        ],
                        _CONTEXT,
                    )

    schema = f"gram long, class long, key long, doc_id {kind}, copies long, pos int, span int, before int, ends boolean, context binary"
    return keyed.join(by_key, "key").mapInArrow(run, schema)


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield slice(at, to)
        at = to


def _lexical(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows sorted, and how many words each shares with the next; the last has 0."""
    data, width = matrix.tobytes(), matrix.shape[1] * 8
    rows = [data[i * width : (i + 1) * width] for i in range(len(matrix))]
    order = np.array(sorted(range(len(rows)), key=rows.__getitem__))
    common = np.zeros(len(rows), dtype=np.int64)
    for at in range(0, len(rows) - 1, 4096):
        block = matrix[order[at : at + 4097]]
        unlike = block[1:] != block[:-1]
        common[at : at + len(unlike)] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), matrix.shape[1])
    return order, common


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each node of at least ``least`` of a common-prefix interval tree, by a scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            yield deep, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _periodic(s: np.ndarray) -> bool:
    """Whether words repeat themselves after at most ``PERIOD``, so that they lie in runs alone."""
    likely = np.flatnonzero((s[1 : PERIOD + 1] == s[0]) & (s[2 : PERIOD + 2] == s[1])) + 1
    return any((s[p:] == s[:-p]).all() for p in likely.tolist())


def subtree(left: np.ndarray, right: np.ndarray, back: np.ndarray, fewest: np.ndarray, known: int, reach: int) -> tuple[list, list]:
    """(repeats, again) of one anchor's occurrences.

    ``left`` has the words before each, nearest first, ``right`` those from the anchor on, a row each. A repeat is
    (words before the anchor, words from it on, its rows). ``again`` has the rows that are alike for
    the whole reach, a list for each such set. Repeats of up to ``known`` words from the anchor on were given before; those that
    lie in runs alone are left to the runs.
    """
    order, common = _lexical(right)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    again = [order[i : j + 1] for _, i, j in intervals(common, reach)]
    again = [s for s in again if (left[s[1:]] != left[s[0]]).any()]
    before, shared = _lexical(left)
    found = []
    deepest = int(back.max()) - 1
    for depth, i, j in intervals(shared, 0):
        if depth > deepest:
            continue
        least = max(LEAST - depth, known)
        rows = before[i : j + 1]
        branch = np.cumsum(np.concatenate([[0], shared[i:j] == depth]))
        sort = np.argsort(rank[rows])
        rows, branch = rows[sort], branch[sort]
        along = np.minimum.reduceat(common, rank[rows])
        along[-1] = 0
        changes = np.concatenate([[0], np.cumsum(branch[1:] != branch[:-1])])
        for length, a, b in intervals(along, least):
            if length < reach and changes[b] > changes[a]:
                some = rows[a]
                if fewest[some] <= depth < back[some] and not _periodic(np.concatenate([left[some, :depth][::-1], right[some, :length]])):
                    found.append((depth, length, rows[a : b + 1]))
    return found, again


def _matrices(context: pa.Array, before: np.ndarray, ends: np.ndarray, back: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before each anchor, nearest first, and those from it on; past a document's end stands a word of its own."""
    n = len(before)
    left = np.zeros((n, WINDOW), dtype=np.uint64)
    lone = np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    widest, parts = 0, []
    for at, data, offsets in words.slices(context):
        start, end, first = words.find(data, offsets, words.SOLID)
        h = words.hashes(data, start, end)
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        column = np.arange(len(h)) - first[row] - before[at + row]
        to_left = column < 0
        left[at + row[to_left], -column[to_left] - 1] = h[to_left]
        parts.append((at + row[~to_left], column[~to_left], h[~to_left]))
        widest = max(widest, int(column.max(initial=0)) + 1)
    right = np.zeros((n, min(reach, widest + 1)), dtype=np.uint64)
    length = np.zeros(n, dtype=np.int64)
    for row, column, h in parts:
        right[row, column] = h
        np.maximum.at(length, row, column + 1)
    opens = np.flatnonzero(before < back)
    left[opens, before[opens]] = lone[opens]
    closes = np.flatnonzero(ends & (length < right.shape[1]))
    right[closes, length[closes]] = lone[closes]
    return left, right


def _found(contexts: DataFrame, known: int, reach: int) -> DataFrame:
    """(repeat, n_words, n, key, doc_id, start, leads, copies) of each occurrence of each repeat; without n_words, an occurrence to treat again."""
    fields = [("repeat", T.LongType()), ("n_words", T.IntegerType()), ("n", T.LongType()), ("key", T.LongType()), ("doc_id", contexts.schema["doc_id"].dataType)]
    fields += [("start", T.IntegerType()), ("leads", T.BooleanType()), ("copies", T.LongType()), ("gram", T.LongType()), ("class", T.LongType()), ("span", T.IntegerType())]
    out = T.StructType([T.StructField(n, t) for n, t in fields])

    def treat(group: pa.Table, sink: _Sink) -> None:
        key, pos, span, before = (group.column(n).to_numpy() for n in ("key", "pos", "span", "before"))
        _, one = np.unique(np.stack([key, pos]), axis=1, return_index=True)
        if len(one) < len(key):
            group = group.take(pa.array(one))
            key, pos, span, before = key[one], pos[one], span[one], before[one]
        if len(key) < 2:
            return
        back = span // 64
        left, right = _matrices(group.column("context").combine_chunks(), before, group.column("ends").to_numpy(), back, reach)
        found, again = subtree(left, right, back, span % 64, known, reach)
        if not found and not again:
            return
        doc, copies = group.column("doc_id").combine_chunks(), group.column("copies").to_numpy()
        place = np.empty(len(key), dtype=np.int64)
        ids = doc.to_pylist()
        by = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, key[i], pos[i]))
        place[by] = np.arange(len(ids))
        for depth, length, rows in found:
            rows = rows[np.argsort(place[rows])]
            sink.repeat(depth + length, doc, key, pos - depth, copies, rows)
        gram = int(group.column("gram")[0].as_py())
        for rows in again:
            kind = int(words.mix(np.bitwise_xor.reduce(words.mix(right[rows[0]] + np.arange(right.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).reshape(1)).view(np.int64)[0])
            sink.again(gram, kind, doc, key, pos, span, copies, rows)

    class _Sink:
        def __init__(self):
            self.repeats, self.agains, self.held = [], [], 0

        def repeat(self, n, doc, key, start, copies, rows):
            first = rows[0]
            one = words.mix(words.mix(key[first : first + 1].view(np.uint64) + np.uint64(n)) + start[first : first + 1].astype(np.uint64)).view(np.int64)
            self.repeats.append((len(rows), one[0], n, copies[rows].sum(), key[rows], start[rows], copies[rows], doc.take(pa.array(rows))))
            self.held += len(rows)

        def again(self, gram, kind, doc, key, pos, span, copies, rows):
            self.agains.append((len(rows), gram, kind, key[rows], pos[rows], copies[rows], span[rows], doc.take(pa.array(rows))))
            self.held += len(rows)

        def batches(self) -> Iterator[pa.RecordBatch]:
            for found, names in ((self.repeats, ("repeat", "n_words", "n", "key", "start", "copies", "doc_id")), (self.agains, ("gram", "class", "key", "start", "copies", "span", "doc_id"))):
                if not found:
                    continue
                size, *columns = zip(*found)
                size = np.array(size)
                columns = dict(zip(names, columns))
                doc = pa.concat_arrays(columns.pop("doc_id"))
                arrays = {n: pa.array(np.repeat(np.array(c), size) if np.isscalar(c[0]) or np.ndim(c[0]) == 0 else np.concatenate(c), kinds[n]) for n, c in columns.items()} | {"doc_id": doc}
                if found is self.repeats:
                    leads = np.zeros(size.sum(), dtype=bool)
                    leads[np.cumsum(size) - size] = True
                    arrays["leads"] = pa.array(leads)
                yield pa.RecordBatch.from_arrays([arrays[n] if n in arrays else pa.nulls(len(doc), kinds[n]) for n in out.fieldNames()], out.fieldNames())
            self.repeats, self.agains, self.held = [], [], 0

    kinds = {"repeat": pa.int64(), "n_words": pa.int32(), "n": pa.int64(), "key": pa.int64(), "start": pa.int32(), "leads": pa.bool_(), "copies": pa.int64(), "gram": pa.int64(), "class": pa.int64(), "span": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held, now = _Sink(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, kind = batch.column("gram").to_numpy(), batch.column("class").to_numpy()
            edges = np.flatnonzero((gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                key = (gram[a], kind[a])
                if key != now:
                    if held:
                        treat(pa.Table.from_batches(held), sink)
                    now, held = key, []
                held.append(batch.slice(a, b - a))
                if sink.held > 50_000:
                    yield from sink.batches()
            words.give_back()
        if held:
            treat(pa.Table.from_batches(held), sink)
            yield from sink.batches()

    return contexts.repartition("gram", "class").sortWithinPartitions("gram", "class").mapInArrow(run, out)


def _occurrences(texts: DataFrame) -> DataFrame:
    """(repeat, n_words, n, key, doc_id, start, leads, copies) of each occurrence of each repeat that isn't left to runs; copies of a text stand for all its documents."""
    by_gram = Window.partitionBy("gram")
    by_tail = Window.partitionBy("gram", "tail")
    wanted = (
        _anchor_table(texts)
        .repartition("gram")
        .withColumn("lo", F.min("left").over(by_tail))
        .withColumn("hi", F.max("left").over(by_tail))
        .where("not turned or lo <> hi")
        .withColumn("lo", F.min("left").over(by_gram))
        .withColumn("hi", F.max("left").over(by_gram))
        .where("lo <> hi")
        .select("gram", F.lit(0).cast("long").alias("class"), "key", "pos", "span")
    )
    every, known, reach = None, 0, REACH
    while True:
        found = cut(_found(_contexts(texts, wanted, reach), known, reach))
        part = found.where("n_words is not null").drop("gram", "class", "span")
        every = part if every is None else every.unionByName(part)
        wanted = found.where("n_words is null").select("gram", "class", "key", F.col("start").alias("pos"), "span")
        if wanted.isEmpty():
            return every
        known, reach = reach, reach * WIDER


def _whole(texts: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, copies) of texts of enough words that several documents have, and whether each is one run."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in words.slices(batch.column("text")):
                start, end, first = words.find(data, offsets, words.SOLID)
                n = np.diff(first)
                long = np.flatnonzero(n >= LEAST)
                if len(long):
                    h = words.hashes(data, start, end)
                    run = [_periodic(h[first[i] : first[i + 1]]) for i in long]
                    key, doc, copies = (batch.column(c).take(pa.array(long + at)) for c in ("key", "doc_id", "copies"))
                    yield pa.RecordBatch.from_arrays([key, doc, pa.array(n[long].astype(np.int32)), copies, pa.array(run)], ["key", "doc_id", "n_words", "copies", "run"])

    return texts.where("copies > 1").mapInArrow(run, f"key long, doc_id {kind}, n_words int, copies long, run boolean").distinct()


def _every(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key, doc_id, repeat_id, start, n_words, n_occurrences, period, phase): occurrences in each text, under its least id, and for the other ids the whole text."""
    texts, copies = _once(_keyed(docs, id_col, text))
    others = copies.where("not doc_id <=> lead").select("key", "doc_id")
    found = _occurrences(texts).select("key", "doc_id", F.col("repeat").alias("repeat_id"), "start", "n_words", F.col("n").alias("n_occurrences"), "copies")
    # A text that several documents have is a repeat; it may have been found already, if it is also a part of others.
    known = found.where("copies > 1 and start = 0").select("key", "n_words", F.col("repeat_id").alias("known"), F.col("n_occurrences").alias("n"))
    whole = cut(cut(_whole(texts)).where("not run").join(known, ["key", "n_words"], "left"))
    whole = whole.select(
        "key", "doc_id", F.coalesce("known", F.xxhash64("key", "n_words")).alias("repeat_id"), F.lit(0).alias("start"), "n_words", F.coalesce("n", "copies").alias("n_occurrences"), "known"
    )
    run = _run_table(texts)
    run = run.select("key", "doc_id", F.col("class").alias("repeat_id"), "start", "n_words", "n_occurrences", "period", "phase", "copies")
    one_run = _whole(texts).where("run").select("key")
    parts = [found.drop("copies"), whole.where("known is null").drop("known"), whole.drop("doc_id", "known").join(others, "key"), run.drop("copies")]
    parts.append(run.where("copies > 1").drop("doc_id", "copies").join(one_run, "key", "left_semi").join(others, "key"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_repeats, repeats), a row for each document that has any: its occurrences of all maximal repeats.

    ``repeats`` is a list, by place, of (repeat_id, start, n_words, n_occurrences, period, phase), where ``start`` is the number of the occurrence's first word.
    Entries with a ``period`` are runs, with their class as ``repeat_id``; they stand for all repeats within them. Of documents with the same text
    the one of least id has all occurrences, which are those of the others too; the others have the whole text as the repeat that it is.
    """
    entry = F.struct("start", "n_words", "repeat_id", "n_occurrences", "period", "phase")
    lists = _every(docs, id_col, text).groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return lists.select(
        "doc_id", F.size("x").alias("n_repeats"), F.transform("x", lambda x: F.struct(*(x[n].alias(n) for n in ("repeat_id", "start", "n_words", "n_occurrences", "period", "phase")))).alias("repeats")
    )


def expanded(rows: list[tuple], texts: dict) -> list[tuple[int, list[tuple]]]:
    """(n_words, occurrences (document, start)) of each maximal repeat within the runs of one class.

    ``rows`` are its (document, start, n_words, period, phase); ``texts`` has each document's words. A sequence of the class is so many words from
    a phase on, and occurs in each run that is long enough, once in each turn.
    """
    out, period = [], rows[0][3]

    def word(d, i):
        return texts[d][i] if 0 <= i < len(texts[d]) else (d, i)

    for phase in {r[4] for r in rows}:
        for n in {m - (phase - f) % period - t for _, _, m, _, f in rows for t in range(0, m, period)}:
            held = [(d, s + at) for d, s, m, _, f in rows for at in range((phase - f) % period, m - n + 1, period)] if n >= LEAST else []
            if len({word(d, i - 1) for d, i in held}) > 1 and len({word(d, i + n) for d, i in held}) > 1:
                out.append((n, sorted(held)))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words from each start to before each end, and the white space after them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    start, _, _ = words.find(data, np.array([0, len(data)]), words.SOLID)
    start = np.append(start, len(data))
    keep = np.ones(len(data), dtype=bool)
    for a, b in spans:
        keep[start[a] : start[min(b, len(start) - 1)]] = False
    return data[keep].tobytes().decode("utf-8", "surrogatepass")


def _run_spans(runs_: DataFrame) -> DataFrame:
    """(key, a, b): what of each run has come before, in an earlier run of its class or an earlier turn of its own.

    A run has sequences of ``LEAST`` words from up to ``period`` phases. For each phase of each class the first run that has it is found by
    an aggregate; a run's sequences from a phase whose first run is another are cut, and from its second turn on all are.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    own = runs_.withColumn("place", order).withColumn("many", F.least(F.col("n_words") - LEAST + 1, F.col("period")))
    phases = own.select("class", "key", "start", "n_words", "period", "place", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("at"), "phase")
    phases = phases.withColumn("from", (F.col("phase") + F.col("at")) % F.col("period"))
    firsts = phases.groupBy("class", "from").agg(F.min("place").alias("first"))
    known = phases.join(F.broadcast(firsts) if small_enough(firsts.count()) else firsts, ["class", "from"])
    before = known.where("first <> place")
    spans = before.select("key", "start", "at", F.lit(LEAST).alias("long"))
    turns = own.where(f"n_words - period >= {LEAST}").select("key", "start", F.col("period").alias("at"), (F.col("n_words") - F.col("period")).alias("long"))
    spans = spans.unionByName(turns)
    return spans.select("key", (F.col("start") + F.col("at")).alias("a"), (F.col("start") + F.col("at") + F.col("long")).alias("b"))


def cut_out(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents, with each repeat cut from the text wherever it occurs but first (by id and place).

    Every passage stays once: a word is cut if it is in a sequence of ``LEAST`` words that has come before. Documents without repeats are unchanged; one of which no word is left is dropped.
    The column ``length``, if there is one, has the new length of a text that was cut.
    """
    texts, copies = _once(_keyed(docs, id_col, text))
    spans = _occurrences(texts).where("not leads").select("key", F.col("start").alias("a"), (F.col("start") + F.col("n_words")).alias("b"))
    spans = spans.unionByName(_run_spans(_run_table(texts)))
    lists = cut(spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    gone = cut(copies.where("not doc_id <=> lead").join(_whole(texts).select("key"), "key", "left_semi").select("key", "doc_id"))

    @F.pandas_udf("string")
    def less(texts, lists):
        import pandas as pd

        out = [t if s is None else _without(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(texts, lists)]
        return pd.Series(out, dtype=object)

    less = less.asNondeterministic()  # else the filter below gets a call, and a worker, of its own
    key, at, new_text = (free_name(docs, n) for n in ("_cut_key", "_cut_spans", "_cut_text"))
    lists = lists.toDF(key, at)
    lists = F.broadcast(lists) if small_enough(lists.count(), 20_000) else lists
    keyed = docs.withColumn(key, F.xxhash64(F.col(f"`{text}`")))
    if n := gone.count():
        gone = gone.select(F.col("key").alias("gone_key"), F.col("doc_id").alias("gone_id"))
        gone = F.broadcast(gone) if small_enough(n) else gone
        keyed = keyed.join(gone, (keyed[f"`{key}`"] == F.col("gone_key")) & keyed[f"`{id_col}`"].eqNullSafe(F.col("gone_id")), "left_anti")
    joined = keyed.join(lists, key, "left")
    whole = joined.where(F.col(f"`{at}`").isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    shorter = joined.where(F.col(f"`{at}`").isNotNull()).withColumn(new_text, less(F.col(f"`{text}`"), F.col(f"`{at}`")))
    shorter = shorter.where(F.trim(F.regexp_replace(F.col(f"`{new_text}`"), r"\s+", "")) != "")
    new = {text: F.col(f"`{new_text}`")}
    if length in docs.columns:
        new[length] = F.length(F.col(f"`{new_text}`")).cast(docs.schema[length].dataType)
    return whole.unionByName(shorter.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns)))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op6_repeats": op6_repeats}
ORACLES: dict[str, str] = {}
