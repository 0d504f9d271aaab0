"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the byte n-grams (four to six) that a lower-cased text has, each counted once.
A feature's scale is its log-count ratio, log((p + a) / |p|) - log((q + a) / |q|), with p and q
the texts of either label that have it; features whose document frequencies do not differ clearly between the classes are
left out. Logistic regression learns the weights of the scaled features.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, utf8_list
from .labelled import labelled_sample

ORDERS = (4, 5, 6)
_TABLE_BITS, _COUNT_BITS = 20, 24


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that begins at each byte, packed exactly into 64 bits with its length on top."""
    m = max(0, len(raw) - n + 1)
    out = np.full(m, n << 56, np.uint64)
    for k in range(n):
        out |= raw[k:k + m].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slots(keys: np.ndarray, bits: int = _TABLE_BITS) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def lowered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts in a row, their bounds)."""
    low = [t.decode().lower().encode() for t in texts]
    return np.frombuffer(b"".join(low), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)])


class ScaledNgrams:
    """Chosen n-grams (sorted), the weight of each and the intercept."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self._maybe = np.zeros(1 << _TABLE_BITS, bool)
        self._maybe[_slots(keys)] = True

    def present(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of every feature that a text has, once each."""
        found = []
        for n in ORDERS:
            grams = _grams(raw, n)
            place = np.flatnonzero(self._maybe[_slots(grams)])
            feature = np.searchsorted(self.keys, grams[place])
            feature[feature == len(self.keys)] = 0
            ok = self.keys[feature] == grams[place] if len(self.keys) else np.zeros(0, bool)
            place, feature = place[ok], feature[ok]
            text = np.searchsorted(at, place, "right") - 1
            inside = place + n <= at[text + 1]
            found.append(text[inside] * (len(self.keys) + 1) + feature[inside])
        both = np.unique(np.concatenate(found))
        return both // (len(self.keys) + 1), both % (len(self.keys) + 1)

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        text, feature = self.present(raw, at)
        logit = self.bias + np.bincount(text, self.weights[feature], len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _document_counts(texts: list[bytes], y: np.ndarray, clear) -> tuple[np.ndarray, ...]:
    """(n-gram, labelled 1 texts that have it, labelled 0 texts that have it) of the n-grams worth a look.

    The first pass counts in hashed slots, so its memory does not depend on the texts; the
    second counts exactly the n-grams of the slots that ``clear(pos, neg)`` picks.
    """
    counts = np.zeros((2, 1 << _COUNT_BITS), np.uint16 if len(texts) < 1 << 16 else np.uint32)

    def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw, _ = lowered([text])
        keys = np.unique(np.concatenate([_grams(raw, n) for n in ORDERS]))
        return keys, _slots(keys, _COUNT_BITS)

    for text, label in zip(texts, y):
        counts[int(label), grams(text)[1]] += 1
    worth = np.zeros(counts.shape[1], bool)
    for at in range(0, len(worth), 1 << 20):
        own = slice(at, at + (1 << 20))
        worth[own] = clear(counts[1, own].astype(float), counts[0, own].astype(float))
    found, label = [], []
    for text, one in zip(texts, y):
        keys, slots = grams(text)
        found.append(keys[worth[slots]])
        label.append(np.full(len(found[-1]), one))
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    label = np.concatenate(label)
    return keys, np.bincount(at, label, len(keys)), np.bincount(at, 1 - label, len(keys))


def fit_ngrams(texts: list[bytes], y: np.ndarray, least: int = 4, contrast: float = 4.5, smooth: float = 1.0,
               ridge: float = 1e-3, rounds: int = 400) -> ScaledNgrams:
    """``least`` texts must have an n-gram; ``contrast`` is the least z of the two classes' frequencies."""
    none = ScaledNgrams(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not len(texts) or y.min() == y.max():
        none.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(texts) else 0.0
        return none
    ones, zeros = y.sum(), len(y) - y.sum()

    def clear(pos: np.ndarray, neg: np.ndarray, at_least: float = contrast / 2) -> np.ndarray:
        share = (pos + neg) / len(y)
        z = (pos / ones - neg / zeros) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
        return (pos + neg >= least) & (np.abs(z) >= at_least)

    keys, pos, neg = _document_counts(texts, y, clear)
    keep = clear(pos, neg, contrast)
    ratio = np.log((pos + smooth) / (ones + 2 * smooth)) - np.log((neg + smooth) / (zeros + 2 * smooth))
    keys, ratio = keys[keep], ratio[keep]
    model = ScaledNgrams(keys, ratio, 0.0)
    text, feature = [], []
    for at in range(0, len(texts), 64):  # a few texts at a time, so that only their n-grams are in memory
        t, f = model.present(*lowered(texts[at:at + 64]))
        text.append(t + at)
        feature.append(f)
    text, feature = np.concatenate(text), np.concatenate(feature)
    value = ratio[feature]
    w, b = np.zeros(len(keys)), float(np.log(ones / zeros))
    state = np.zeros((4, len(keys) + 1))
    for t in range(1, rounds + 1):
        logit = b + np.bincount(text, value * w[feature], len(y))
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        g = np.append(np.bincount(feature, value * d[text], len(keys)) + ridge * w / len(keys), d.sum())
        state[0] += 0.1 * (g - state[0])
        state[1] += 0.001 * (g * g - state[1])
        move = 0.02 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return ScaledNgrams(keys, ratio * w, float(b))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 5000, id_col: str = "doc_id",
                   text_col: str = "text") -> ScaledNgrams:
    """The classifier fitted on at most ``rows`` labelled, not held-out texts, each of them whole."""
    return fit_ngrams(*labelled_sample(docs, labels, label, rows, id_col, text_col))


def _scores(batches: Iterable[pa.RecordBatch], model: ScaledNgrams, column: str,
            below: float | None) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, column, 2 << 20):
        score = model.score(*lowered(utf8_list(part.column(column))))
        if below is None:
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], ["id", "score"])
        else:
            yield part.filter(pa.array(score < below))


def score_toxicity(docs: DataFrame, model: ScaledNgrams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score in [0, 1]) of the whole text; null counts as empty."""
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(cols, functools.partial(_scores, model=model, column="text", below=None), "id long, score double")


def drop_toxic(docs: DataFrame, model: ScaledNgrams, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score stays below ``threshold``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return map_arrow(docs, functools.partial(_scores, model=model, column=text_col, below=threshold), schema)
