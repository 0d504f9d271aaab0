"""Substring dedup by difference-cover anchors.

A match of ``window`` words is found through shorter windows of ``anchor`` words that are
hashed only at positions p with p mod ``period`` in ``cover``. The cover is a difference
cover: any two positions have a common shift below the period that takes both into it. So
two equal windows of at least ``anchor + period - 1`` words contain one equal anchor at
the same place, wherever they lie in their documents.

1. Anchors: every document's cover anchors, packed per slice into one row per hash bucket;
   a bucket returns the anchors that more than one document has.
2. Extension: around its shared anchors, a document hashes its full windows (128 bits) and
   the bucket of each returns those that a document with a smaller id also has.
3. Removal: each word that such a window covers goes.

Rows per bucket hold arrays, so the shuffles carry eight bytes an anchor and no text; the
text itself is joined by id twice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WordHasher, byte_slices, int64_column, map_arrow, mix64, scratch_table, utf8_parts, window_hashes)

WINDOW, ANCHOR, PERIOD, COVER = 13, 7, 7, (0, 1, 3)
# Anchors or windows gathered in a task before it hands its buckets on.
FLUSH = 1 << 19
SLICE = 1 << 20  # bytes of text that one numpy step hashes
_SEEDS, _BASES = (11, 12), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.cache
def _hasher(k: int) -> WordHasher:
    return WordHasher(_SEEDS[k])


def _check_cover(window: int, anchor: int, period: int, cover: tuple[int, ...]) -> None:
    differences = {(a - b) % period for a in cover for b in cover}
    if differences != set(range(period)) or window < anchor + period - 1:
        raise ValueError("cover must be a difference cover and window at least anchor + period - 1")


def _positions(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in its text) of each word, from the first word of each text."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    return text, np.arange(first[-1]) - np.repeat(first[:-1], count)


def _anchors(h, first, text, place, p) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of each cover anchor that lies in one text of at least a window."""
    size = np.diff(first)[text] if len(text) else np.zeros(0, np.int64)
    key = window_hashes(h, p["anchor"], _BASES[0])
    inside = np.isin(np.arange(p["period"]), p["cover"])
    ok = (inside[place % p["period"]] & (place + p["anchor"] <= size) & (size >= p["window"]))[:len(key)]
    at = np.flatnonzero(ok)
    return at, key[at]


def _settle(keys: list[np.ndarray], docs: np.ndarray, both_ends: bool, n_buckets: int,
            names: list[str]) -> Iterator[pa.RecordBatch]:
    """A gathered set of (keys, document) as rows of arrays, one per bucket.

    Of the documents that share a key within the set, only the smallest (and the largest
    for ``both_ends``) must meet other sets in the key's bucket; for the rest the answer is
    settled here, and they only pass through a bucket of their document. So a key that a
    third of all documents has costs its bucket two entries a set.
    """
    if not len(docs):
        return
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    run = np.zeros(len(docs), bool)
    run[0] = True
    for k in keys:
        run[1:] |= k[1:] != k[:-1]
    new = run.copy()
    new[1:] |= docs[1:] != docs[:-1]
    keys, docs, run = [k[new] for k in keys], docs[new], run[new]
    open_ = run | np.concatenate([run[1:], [True]]) if both_ends else run
    for settled, pick, owner in ((False, open_, keys[0]), (True, ~open_, mix64(docs.view(np.uint64)))):
        at = np.flatnonzero(pick)
        if not len(at):
            continue
        bucket = (owner[at] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order].astype(np.int32)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        offsets = pa.array(np.concatenate([cut, [len(at)]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[at])) for x in (*[k.view(np.int64) for k in keys], docs)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([settled] * len(cut)), *lists],
                                         ["bucket", "settled", *names, "docs"])


def _anchor_rows(batches: Iterable[pa.RecordBatch], p: dict) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in byte_slices(batches, "text", SLICE):
        ids, there = int64_column(part.column("id"))
        _, _, h, first = _hasher(0).words(*utf8_parts(part.column("text")))
        text, place = _positions(first)
        at, key = _anchors(h, first, text, place, p)
        ok = there[text[at]]
        held.append((key[ok], ids[text[at][ok]]))
        if sum(len(k) for k, _ in held) >= FLUSH:
            yield from _flush(held, p)
            held = []
    yield from _flush(held, p)


def _flush(held, p) -> Iterator[pa.RecordBatch]:
    if held:
        key, docs = (np.concatenate(x) for x in zip(*held))
        yield from _settle([key], docs, True, p["buckets"], ["k1"])


def _to_docs(docs: np.ndarray, key: np.ndarray, n_buckets: int) -> pa.Table:
    """(bucket, docs, keys): one row for each bucket of documents, so that a document's keys meet again."""
    bucket = ((mix64(docs.view(np.uint64)) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    docs, key, bucket = docs[order], key[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(docs) else np.zeros(0, np.int64)
    at = pa.array(np.concatenate([cut, [len(docs)]]).astype(np.int32))
    return pa.table({"bucket": pa.array(bucket[cut]), "docs": pa.ListArray.from_arrays(at, pa.array(docs)),
                     "keys": pa.ListArray.from_arrays(at, pa.array(key))})


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy() for c in table.column(name).chunks]])


def _split(table: pa.Table, names: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns' values in the rows that are open, and in those already settled."""
    settled = table.column("settled")
    return tuple([_flat(part, c) for c in names] for part in (table.filter(pc.invert(settled)), table.filter(settled)))


def _shared_anchors(table: pa.Table, n_buckets: int) -> pa.Table:
    """(bucket, docs, keys) of the anchors of one bucket that more than one document has."""
    (key, docs), (sure_key, sure_docs) = _split(table, ["k1", "docs"])
    order = np.argsort(key, kind="stable")
    key, docs = key[order], docs[order]
    if len(key):
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.minimum.reduceat(docs, run) != np.maximum.reduceat(docs, run)
        ok = np.repeat(shared, np.diff(np.concatenate([run, [len(key)]])))
        key, docs = key[ok], docs[ok]
    return _to_docs(np.concatenate([docs, sure_docs]), np.concatenate([key, sure_key]), n_buckets)


def _by_doc(table: pa.Table) -> pa.Table:
    """(doc, keys): one row per document with the keys of it, each once."""
    docs, key = _flat(table, "docs"), _flat(table, "keys")
    if not len(docs):
        return pa.table({"doc": pa.array([], pa.int64()), "keys": pa.array([], pa.list_(pa.int64()))})
    order = np.lexsort((key, docs))
    docs, key = docs[order], key[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (key[1:] != key[:-1])])
    docs, key = docs[new], key[new]
    cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    at = pa.array(np.concatenate([cut, [len(key)]]).astype(np.int32))
    return pa.table({"doc": pa.array(docs[cut]), "keys": pa.ListArray.from_arrays(at, pa.array(key))})


def _has(text: np.ndarray, key: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which (text, key) are among the keys listed in the column for that text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    there = np.asarray(column.is_valid())
    sizes = np.where(there, sizes, 0)
    listed = column.flatten().to_numpy().view(np.uint64)
    if not len(listed) or not len(key):
        return np.zeros(len(key), bool)
    owner = np.repeat(np.arange(len(column)), sizes).astype(np.uint64)
    salt = np.uint64(0xD6E8FEB86659FD93)
    return np.isin(key ^ _of_text(text, salt), listed ^ _of_text(owner, salt))


def _of_text(text: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (text.astype(np.uint64) + np.uint64(1)) * salt
    return x ^ (x >> np.uint64(29))


def _window_rows(batches: Iterable[pa.RecordBatch], p: dict) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in byte_slices(batches, "text", SLICE):
        ids, _ = int64_column(part.column("id"))
        raw, at = utf8_parts(part.column("text"))
        _, _, h, first = _hasher(0).words(raw, at)
        text, place = _positions(first)
        word, key = _anchors(h, first, text, place, p)
        hit = np.zeros(len(h) + 1, np.int64)
        hit[1 + word[_has(text[word], key, part.column("keys"))]] = 1
        total = np.cumsum(hit)
        m = len(h) - p["window"] + 1
        if m <= 0:
            continue
        size = np.diff(first)[text]
        reach = p["window"] - p["anchor"] + 1
        ok = (total[reach:reach + m] > total[:m]) & (place + p["window"] <= size)[:m]
        begin = np.flatnonzero(ok)
        if not len(begin):
            continue
        _, _, h2, _ = _hasher(1).words(raw, at)
        held.append((window_hashes(h, p["window"], _BASES[0])[begin], window_hashes(h2, p["window"], _BASES[1])[begin],
                     ids[text[begin]]))
        if sum(len(x[0]) for x in held) >= FLUSH:
            yield from _flush_windows(held, p)
            held = []
    yield from _flush_windows(held, p)


def _flush_windows(held, p) -> Iterator[pa.RecordBatch]:
    if held:
        k1, k2, docs = (np.concatenate(x) for x in zip(*held))
        yield from _settle([k1, k2], docs, False, p["buckets"], ["k1", "k2"])


def _repeated_windows(table: pa.Table, n_buckets: int) -> pa.Table:
    """(bucket, docs, keys) of the windows of one bucket that a document with a smaller id has as well."""
    (k1, k2, docs), (sure_key, _, sure_docs) = _split(table, ["k1", "k2", "docs"])
    order = np.lexsort((docs, k2, k1))
    k1, k2, docs = k1[order], k2[order], docs[order]
    if len(k1):
        run = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        ok = docs > np.repeat(docs[run], np.diff(np.concatenate([run, [len(k1)]])))
        k1, docs = k1[ok], docs[ok]
    return _to_docs(np.concatenate([docs, sure_docs]), np.concatenate([k1, sure_key]), n_buckets)


def _kept(batches: Iterable[pa.RecordBatch], p: dict) -> Iterator[pa.RecordBatch]:
    for part in byte_slices(batches, "text", SLICE):
        raw, at = utf8_parts(part.column("text"))
        begin, end, h, first = _hasher(0).words(raw, at)
        text, place = _positions(first)
        m = max(0, len(h) - p["window"] + 1)
        key = window_hashes(h, p["window"], _BASES[0])
        ok = (place + p["window"] <= np.diff(first)[text])[:m] if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(ok)
        start = start[_has(text[start], key[start], part.column("keys"))]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + p["window"], -1)
        gone = np.cumsum(cover[:-1]) > 0
        kept, removed = [], np.zeros(part.num_rows, np.int64)
        np.add.at(removed, text[gone], 1)
        data = raw.tobytes()
        bounds = at.tolist()
        for k in range(part.num_rows):
            if not removed[k]:
                kept.append(b" ".join(data[bounds[k]:bounds[k + 1]].split()))
                continue
            mine = np.arange(first[k], first[k + 1])[~gone[first[k]:first[k + 1]]]
            kept.append(b" ".join([data[a:b] for a, b in zip(begin[mine].tolist(), end[mine].tolist())]))
        out = [part.column(c) for c in part.schema.names if c != "keys"]
        names = [c for c in part.schema.names if c != "keys"]
        yield pa.RecordBatch.from_arrays(
            [*out, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(first)), pa.array(removed)],
            [*names, "kept_text", "n_words", "n_removed"])


def _judged(base: DataFrame, window: int, anchor: int, period: int, cover: tuple[int, ...],
            buckets: int | None) -> tuple[DataFrame, dict]:
    """``base`` (id, text, ...) with ``keys``: its windows that a document with a smaller id has."""
    _check_cover(window, anchor, period, cover)
    spark = base.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = {"window": window, "anchor": anchor, "period": period, "cover": list(cover), "buckets": n}
    some = base.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    packed, listed = "bucket int, settled boolean, ", "bucket int, docs array<long>, keys array<long>"
    shared = (map_arrow(some, functools.partial(_anchor_rows, p=p), packed + "k1 array<long>, docs array<long>")
              .groupBy("bucket").applyInArrow(lambda t: _shared_anchors(t, n), listed)
              .groupBy("bucket").applyInArrow(_by_doc, "doc long, keys array<long>"))
    around = some.join(scratch_table(shared, "anchors"), F.col("id") == F.col("doc")).select("id", "text", "keys")
    repeated = (map_arrow(around, functools.partial(_window_rows, p=p),
                          packed + "k1 array<long>, k2 array<long>, docs array<long>")
                .groupBy("bucket").applyInArrow(lambda t: _repeated_windows(t, n), listed)
                .groupBy("bucket").applyInArrow(_by_doc, "doc long, keys array<long>"))
    repeated = scratch_table(repeated, "windows")
    return base.join(repeated, F.col("id") == F.col("doc"), "left").drop("doc"), p


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                    buckets: int | None = None) -> DataFrame:
    """One row per input row: (id, text, kept_text, n_words, n_removed).

    Words are runs of bytes other than space and \\t-\\r. A word goes when a window of
    ``window`` consecutive words covers it that also starts in a document with a smaller id
    (judged on the input). kept_text joins the kept words by one space. Null text has no
    words; texts shorter than a window lose nothing; a row without an id neither removes nor
    loses words; rows that repeat an id are judged as that one document.

    ``buckets``: how many hash buckets the anchors are dealt into (default: as many as
    the session has shuffle partitions), which bounds what one task sorts.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    judged, p = _judged(base, window, anchor, period, cover, buckets)
    return map_arrow(judged.select("id", "text", "keys"), functools.partial(_kept, p=p),
                     "id long, text string, kept_text string, n_words long, n_removed long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                   window: int = WINDOW, anchor: int = ANCHOR, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                   buckets: int | None = None) -> DataFrame:
    """``docs`` with the repeated words of ``substring_dedup`` taken out of ``text_col``.

    A text that loses nothing stays as it is, byte for byte; the others become their kept
    words joined by one space, and ``length_col``, if given, their number of characters.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row"))
    judged, p = _judged(base, window, anchor, period, cover, buckets)
    kind = dict(judged.dtypes)["row"]
    kept = map_arrow(judged.select("row", "text", "keys"), functools.partial(_kept, p=p),
                     f"row {kind}, text string, kept_text string, n_words long, n_removed long")
    changed = F.col("n_removed") > 0
    out = {c: F.col("row")[c] for c in docs.columns if c != text_col}
    out[text_col] = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    if length_col:
        out[length_col] = F.when(changed, F.char_length("kept_text").cast(dict(docs.dtypes)[length_col])).otherwise(out[length_col])
    return kept.select(*[out[c].alias(c) for c in docs.columns])
