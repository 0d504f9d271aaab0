"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes step through the whole text four bytes
at a time; their responses are max-pooled in overlapping chunks of 256 bytes; the largest
and the mean chunk response of each filter go through one hidden layer to a probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, utf8_parts
from .labelled import labelled_sample

STEP, BLOCK = 4, 32  # bytes a filter moves; filter places in half a chunk


class ByteConvNet:
    """Parameters as float32 arrays; ``score`` for whole texts, ``fit`` by Adam on labelled texts."""

    def __init__(self, filters: int = 32, dims: int = 8, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"emb": normal(256, dims, scale=0.5), "left": normal(STEP * dims, filters, scale=0.25),
                  "right": normal(STEP * dims, filters, scale=0.25), "bias": np.zeros(filters, np.float32),
                  "mix": normal(2 * filters, hidden, scale=0.2), "mix_bias": np.zeros(hidden, np.float32),
                  "out": normal(hidden, scale=0.3), "out_bias": np.zeros(1, np.float32)}

    @staticmethod
    def padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes with each text filled up with zero bytes to whole blocks, first block of each text and the end)."""
        size = np.diff(at)
        blocks = np.maximum(1, -(-size // (STEP * BLOCK)))
        first = np.concatenate([[0], np.cumsum(blocks)])
        out = np.zeros(first[-1] * STEP * BLOCK, np.uint8)
        out[np.arange(len(raw)) + np.repeat(first[:-1] * STEP * BLOCK - at[:-1], size)] = raw
        return out, first

    def _responses(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedded steps, filter responses at each step)."""
        p = self.p
        steps = p["emb"][data].reshape(len(data) // STEP, -1)
        a, ahead = steps @ p["left"], steps @ p["right"]
        a[:-1] += ahead[1:]
        last = first[1:] * BLOCK - 1
        after = np.tile(p["emb"][0], STEP) @ p["right"]
        inner = last[:-1]
        a[inner] += after - ahead[inner + 1]
        a[last[-1]] += after
        return steps, a

    def _pool(self, a: np.ndarray, first: np.ndarray):
        blocks = a.reshape(-1, BLOCK, a.shape[1])
        top = blocks.max(1)
        chunk = top.copy()
        chunk[:-1] = np.maximum(top[:-1], top[1:])
        ends = first[1:] - 1
        chunk[ends] = top[ends]
        live = np.maximum(chunk + self.p["bias"], 0)
        most = np.maximum.reduceat(live, first[:-1])
        mean = np.add.reduceat(live, first[:-1]) / np.diff(first)[:, None].astype(np.float32)
        return top, chunk, live, np.concatenate([most, mean], 1)

    def _head(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(z @ self.p["mix"] + self.p["mix_bias"], 0)
        return h, h @ self.p["out"] + self.p["out_bias"][0]

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        data, first = self.padded(raw, at)
        _, a = self._responses(data, first)
        _, logit = self._head(self._pool(a, first)[3])
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -40, 40)))

    def _gradient(self, raw: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        data, first = self.padded(raw, at)
        steps, a = self._responses(data, first)
        top, chunk, live, z = self._pool(a, first)
        h, logit = self._head(z)
        d = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)).astype(np.float32)
        g = {"out": h.T @ d, "out_bias": d.sum(keepdims=True)}
        dh = np.outer(d, p["out"]) * (h > 0)
        g["mix"], g["mix_bias"] = z.T @ dh, dh.sum(0)
        dz = dh @ p["mix"].T
        n, text = live.shape[1], np.repeat(np.arange(len(y)), np.diff(first))
        dchunk = dz[text, n:] / np.diff(first)[text, None].astype(np.float32)
        most = live == z[text, :n]
        ties = np.add.reduceat(most, first[:-1], dtype=np.float32)
        dchunk += np.where(most, (dz[:, :n] / ties)[text], 0)
        dchunk *= live > 0
        g["bias"] = dchunk.sum(0)
        own = chunk == top
        dtop = dchunk * own
        dtop[1:] += (dchunk * ~own)[:-1]
        da = np.zeros_like(a)
        where = a.reshape(-1, BLOCK, n).argmax(1) + np.arange(len(top))[:, None] * BLOCK
        np.put_along_axis(da, where.reshape(-1, n), dtop, 0)
        g["left"] = steps.T @ da
        g["right"] = steps[1:].T @ da[:-1]
        dsteps = da @ p["left"].T
        dsteps[1:] += da[:-1] @ p["right"].T
        dbytes = dsteps.reshape(len(data), -1)
        g["emb"] = np.stack([np.bincount(data, dbytes[:, k], 256) for k in range(dbytes.shape[1])], 1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 24, rate: float = 4e-3,
            seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.p["out_bias"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0
        t = 0
        epochs = max(epochs, -(-400 * batch // max(1, len(texts)))) if len(texts) else 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                parts = [texts[k] for k in own]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                g = self._gradient(np.frombuffer(b"".join(parts), np.uint8), bounds, y[own])
                t += 1
                now = rate * (1 - 0.9 * epoch / epochs)
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        return self


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 2500, id_col: str = "doc_id",
                  text_col: str = "text") -> ByteConvNet:
    """The network fitted on at most ``rows`` labelled, not held-out texts, each of them whole.

    Without any labelled row the network stays at its start and scores everything near one half.
    """
    texts, y = labelled_sample(docs, labels, label, rows, id_col, text_col)
    return ByteConvNet().fit(texts, y)


def _scores(batches: Iterable[pa.RecordBatch], model, column: str, keep: float | None) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, column, 1 << 20):
        score = model.score(*utf8_parts(part.column(column)))
        if keep is None:
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], ["id", "score"])
        else:
            yield part.filter(pa.array(score >= keep))


def score_quality(docs: DataFrame, model: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score in [0, 1]) of the whole text; null counts as empty."""
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(cols, functools.partial(_scores, model=model, column="text", keep=None), "id long, score double")


def keep_quality(docs: DataFrame, model: ByteConvNet, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return map_arrow(docs, functools.partial(_scores, model=model, column=text_col, keep=threshold), schema)
