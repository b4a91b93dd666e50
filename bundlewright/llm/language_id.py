"""Operator 2: language identification by a sparse linear model.

Features are the letter 1-, 2- and 3-grams of the lower-cased text, with anything
but letters folded into one gap, hashed from their code points to ``2 ** BITS`` numbers, weighted by (1 + ln tf) idf and scaled to unit
length. Letters of every script are told apart. Document frequencies are counted over all documents. The model is
multinomial logistic regression, fitted one document at a time by
follow-the-regularised-leader with elastic-net penalties, which leaves most
weights at exactly zero; it has no features but those that the sample has. A temperature fitted to held-back documents then
calibrates its probabilities.

The fit reads a sample of the labelled documents, of ``train_docs`` expected, drawn
by a hash of the id evenly over the languages. That bound is the only one;
statistics and predictions take in every document and the whole of its text.

A document is rejected if it has no letters, or if no language reaches
``min_confidence``.

Defined cases: a null or empty text, or one without letters, is ``und`` with
confidence 0 and rejected; of languages that are as likely the first by name is given; texts of any length are taken whole; rows with a null label are classified but not used
for fitting; without any label nothing can be told, and all documents are ``und``
and kept; repeated rows each give a row; an empty table gives no rows; other columns, of whatever
name, are ignored by :func:`identify` and kept by :func:`accepted`.
"""

from __future__ import annotations

import pickle
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewright.llm import words
from bundlewright.llm.common import sole, table

TRAIN_DOCS = 4_000
MIN_CONFIDENCE = 0.3
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.2, 0.01
#: Bits of a feature's number.
BITS = 20
#: Characters of text whose features are made at a time; a longer text is taken alone.
SLICE_CHARS = 1 << 17


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter, or a mark that belongs to one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, count, first): each text's distinct features, sorted, how often it has each, and each text's first place, with the total at the end."""
    lowered = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in lowered], dtype=np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # One gap before each text and one after the last; gaps in a row are one.
    row = np.repeat(np.arange(len(texts)), size + 1)
    code = np.zeros(len(points) + len(texts) + 1, dtype=np.uint64)
    place = np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1), size)
    code[place] = np.where(_letters()[points], points, 0)
    row = np.append(row, len(texts))
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    # A text's letters stand between its own gap and the next text's, which ends it.
    shift = np.uint64(64 - BITS)
    one = words.mix(code + np.uint64(1))
    two = words.mix(one[:-1] * np.uint64(3) + code[1:])
    three = words.mix(two[:-1] * np.uint64(3) + code[2:])
    own = row.astype(np.uint64) << np.uint64(BITS)
    letter = code != 0
    inside2 = (letter[:-1] | letter[1:]) & ((row[:-1] == row[1:]) | ~letter[1:])
    inside3 = letter[1:-1] & ((row[:-2] == row[2:]) | ~letter[2:])
    inside3 |= letter[:-2] & ~letter[1:-1] & letter[2:] & (row[:-2] == row[2:])
    key = np.concatenate([(own | one >> shift)[letter], (own[:-1] | two >> shift)[inside2], (own[:-2] | three >> shift)[inside3]])
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    first = np.searchsorted(key >> np.uint64(BITS), np.arange(len(texts) + 1, dtype=np.uint64))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), count, first


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about ``SLICE_CHARS``."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(feature, df) over all documents; each partition sends one row for each feature that it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0).to_pylist()):
                df += np.bincount(grams(part)[0], minlength=1 << BITS)
            words.give_back()
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], ["feature", "df"])

    parts = sole(docs, text).mapInArrow(count, "feature int, df long")
    return parts.groupBy("feature").agg(F.sum("df").alias("df"))


class Model:
    """idf of all features, weights of those that have any, bias, temperature and class names."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.classes: list[str] = []
        self.features = np.zeros(0, dtype=np.int64)
        self.weights = np.zeros((1, 0))  # the last row is for features without weights
        self.bias = np.zeros(0)
        self.temperature = 1.0
        self._places: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_places": None}

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, first): the texts' TF-IDF vectors."""
        parts = [grams(p) for p in slices(texts)] or [grams([])]
        feature, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        each = np.concatenate([np.diff(p[2]) for p in parts])
        x = (1.0 + np.log(count)) * self.idf[feature]
        row = np.repeat(np.arange(len(each)), each)
        norm = np.sqrt(np.maximum(np.bincount(row, weights=x * x, minlength=len(each)), 1e-300))
        return feature, x / norm[row], np.concatenate([[0], np.cumsum(each)])

    def logits(self, feature: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self._places is None:
            self._places = np.full(1 << BITS, len(self.features), dtype=np.int32)
            self._places[self.features] = np.arange(len(self.features))
        on = np.flatnonzero(self._places[feature] < len(self.features))
        place, value = self._places[feature[on]], x[on]
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))[on]
        out = np.empty((len(first) - 1, len(self.classes)))
        for k in range(len(self.classes)):
            out[:, k] = np.bincount(row, weights=value * self.weights[place, k], minlength=len(out))
        return out + self.bias

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probabilities, whether the text has a letter)."""
        feature, x, first = self.vectors(texts)
        z = self.logits(feature, x, first) / self.temperature
        return _softmax(z), np.diff(first) > 0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True)) if z.shape[-1] else z
    return e / e.sum(axis=-1, keepdims=True) if z.shape[-1] else z


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], v: int, k: int) -> np.ndarray:
    """Weights of ``v`` features (rows of places, values and class), and the bias, which isn't penalised, as the last row."""
    z, n = np.zeros((v + 1, k)), np.zeros((v + 1, k))
    l1, l2 = np.full((v + 1, 1), L1), np.full((v + 1, 1), L2)
    l1[v] = l2[v] = 0.0

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at])
        return np.where(np.abs(zz) <= l1[at], 0.0, w)

    for _ in range(EPOCHS):
        for at, x, y in rows:
            at, x = np.append(at, v), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            squares = g * g
            z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squares
    return weights(np.arange(v + 1))


def fit(model: Model, texts: list[str], labels: list[str]) -> Model:
    """Fit in the given order; every fifth document is held back for the temperature."""
    model.classes = sorted(set(labels))
    number = {c: i for i, c in enumerate(model.classes)}
    feature, x, first = model.vectors(texts)
    train = [i for i in range(len(texts)) if i % 5 < 4]
    held = [i for i in range(len(texts)) if i % 5 == 4]
    seen = np.unique(np.concatenate([feature[first[i] : first[i + 1]] for i in train]))
    place = np.searchsorted(seen, feature)
    rows = [(place[first[i] : first[i + 1]], x[first[i] : first[i + 1]], number[labels[i]]) for i in train]
    w = ftrl(rows, len(seen), len(model.classes))
    some = np.flatnonzero((w[:-1] != 0).any(axis=1))
    model.features, model.weights, model.bias = seen[some], np.concatenate([w[some], np.zeros((1, w.shape[1]))]), w[-1]
    model._places = None
    scores = model.logits(feature, x, first)
    model.temperature = _temperature(scores[held], np.array([number[labels[i]] for i in held], dtype=int))
    return model


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm; 1 without documents or with one class.

    The targets are smoothed as in Platt's scaling, by one document over all of
    them: else documents that are all classed rightly would ask for certainty.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    loss = cross_entropy(logits, labels)
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def cross_entropy(logits: np.ndarray, labels: np.ndarray):
    """The mean cross-entropy with smoothed targets, as a function of the temperature's logarithm."""
    k, off = logits.shape[1], 1.0 / (len(labels) + 2)
    target = np.full(logits.shape, off / (k - 1))
    target[np.arange(len(labels)), labels] = 1.0 - off

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)))

    return loss


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Count over all documents, then fit in one task on a sample bounded by ``train_docs``."""
    narrow = sole(docs, id_col, text, label).toDF("doc_id", "text", "lang")
    found = document_frequencies(narrow).collect()  # at most 2 ** BITS rows
    sizes = {r["lang"]: r["n"] for r in narrow.groupBy("lang").agg(F.count("text").alias("n"), F.count(F.lit(1)).alias("all")).collect()}
    total = narrow.count()
    df = np.zeros(1 << BITS)
    df[[r["feature"] for r in found]] = [r["df"] for r in found]
    model = Model((np.log((1 + total) / (1 + df)) + 1).astype(np.float32))
    sizes = {lang: n for lang, n in sizes.items() if lang is not None and n}
    if not sizes:
        return model
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / len(sizes) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = narrow.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (draw < share)).withColumn("draw", draw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.to_pandas() for b in batches]
        rows = pd.concat(held) if held else pd.DataFrame({"doc_id": [], "text": [], "lang": [], "draw": []})
        rows = rows.sort_values(["draw", "doc_id", "text"], kind="stable")
        fitted = fit(model, rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else model
        del held, rows
        words.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()["model"])


def verdicts(model: Model, texts: list[str | None], min_confidence: float = MIN_CONFIDENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, confidence, keep) of each text."""
    n = len(texts)
    if not model.classes:
        return np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, dtype=bool)
    parts = []
    for some in slices(texts):
        p, letters = model.probabilities(some)
        best = p.argmax(axis=1)
        sure = np.where(letters, p[np.arange(len(some)), best], 0.0)
        lang = np.where(letters, np.array(model.classes, dtype=object)[best], "und")
        parts.append((lang, sure, letters & (sure >= min_confidence)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=object), np.zeros(0), np.zeros(0, dtype=bool))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, lang, confidence, keep) for every document; the documents aren't shuffled."""
    narrow = sole(docs, id_col, text).toDF("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, confidence, keep = verdicts(shared.value, batch.column(1).to_pylist(), min_confidence)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(confidence, pa.float64()), pa.array(keep, pa.bool_())],
                ["doc_id", "lang", "confidence", "keep"],
            )
            words.give_back()

    return narrow.mapInArrow(run, f"doc_id {kind}, lang string, confidence double, keep boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The documents that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        kept = pd.Series(verdicts(shared.value, texts.tolist(), min_confidence)[2], dtype=bool)
        words.give_back()
        return kept

    return docs.where(keep.asNondeterministic()(F.col(f"`{text}`")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
