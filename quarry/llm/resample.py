"""Target-distribution importance resampling: array-scored weights, exact selection of the winners.

Texts are described by hashed runs of one to ``ngrams`` words. The log ratio of a bucket's
share in the target to its share in the corpus is the bucket's gain; a document's weight is
the sum of its features' gains, looked up in one array. Adding Gumbel noise that is fixed by
the document's id and taking the largest scores draws documents in proportion to their
weights, without replacement.

The cutoff score is found by weighted medians of medians: every partition reports the median
of the keys that are still open, the driver takes the median of those, weighted by the
partitions' open keys, as the next pivot, and the side that cannot hold the cutoff is
discarded: a quarter of the open keys at least. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rank import global_row_number

from .common import byte_slices, map_arrow, scratch_table, utf8_parts

CHUNK_BYTES = 2 << 20
_SHORT = 64             # words below this length are hashed by table
_KEYS = ["k_score", "k_null", "k_id", "k_features"]


def _word_bytes() -> np.ndarray:
    """Bytes that words are made of: digits, letters and all that is not ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def _lower_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


class Crc32Grams:
    """CRC-32 of every run of words of many texts, from the CRCs of their words.

    A CRC is linear: a byte adds a value that depends on how many bytes follow, so a word's
    CRC is an exclusive or over its bytes, and that of two joined strings is the first one's,
    moved on by the length of the second, xor the second one's.
    """

    def __init__(self, ngrams: int):
        self.ngrams = ngrams
        self.inside, self.lower = _word_bytes(), _lower_bytes()
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
        self._step = step
        self._byte = np.empty((_SHORT, 256), np.uint32)
        self._byte[0] = step
        for d in range(1, _SHORT):
            self._byte[d] = self._zero(self._byte[d - 1])
        self._start = np.array([zlib.crc32(bytes(n)) for n in range(_SHORT)], np.uint32)
        self._move = np.empty((_SHORT, 4, 256), np.uint32)
        self._move[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for d in range(1, _SHORT):
            self._move[d] = self._zero(self._move[d - 1])
        self._far = [self._zero(self._move[-1])]        # moves by 64, 128, 256, ... bytes

    def _zero(self, c: np.ndarray) -> np.ndarray:
        """The CRC register after one more zero byte."""
        return self._step[c & 255] ^ (c >> 8)

    @staticmethod
    def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0, c & 255] ^ table[1, (c >> 8) & 255] ^ table[2, (c >> 16) & 255] ^ table[3, c >> 24]

    def moved(self, c: np.ndarray, by: np.ndarray) -> np.ndarray:
        """CRCs moved on by so many bytes."""
        near = by % _SHORT
        out = self._move[near, 0, c & 255] ^ self._move[near, 1, (c >> 8) & 255]
        out ^= self._move[near, 2, (c >> 16) & 255] ^ self._move[near, 3, c >> 24]
        blocks, bit = by // _SHORT, 0
        while (blocks >> bit).any():
            if bit == len(self._far):
                self._far.append(self._through(self._far[-1], self._far[-1]))
            at = np.flatnonzero((blocks >> bit) & 1)
            out[at] = self._through(self._far[bit], out[at])
            bit += 1
        return out

    def words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, byte after the last) of the words of texts in a row, already in lower case."""
        inside = self.inside[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def word_crcs(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - begin
        out = np.empty(len(begin), np.uint32)
        short = length < _SHORT
        b, n = begin[short], length[short]
        if len(b):
            starts = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(starts, n)
            values = self._byte[np.repeat(n, n) - 1 - inside, raw[np.repeat(b, n) + inside]]
            out[short] = np.bitwise_xor.reduceat(values, starts) ^ self._start[n]
        for k in np.flatnonzero(~short):
            out[k] = zlib.crc32(raw[begin[k]:end[k]])
        return out

    def grams(self, raw: np.ndarray, at: np.ndarray, context: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run length: (text, CRC-32) of the runs of so many words, in lower-cased texts in a row.

        Runs are taken by their last word; those that end in the first ``context`` words are left out.
        """
        begin, end = self.words(raw, at)
        text = np.searchsorted(at, begin, "right") - 1
        word = self.word_crcs(raw, begin, end)
        length = end - begin
        space = np.full(len(word), zlib.crc32(b" "), np.uint32)
        spaced = self.moved(space, length) ^ word                # of the word with a space before it
        run = word
        for n in range(1, self.ngrams + 1):
            if n > 1:
                run = self.moved(run[:-1], length[n - 1:] + 1) ^ spaced[n - 1:]
            last = np.arange(n - 1, len(word))
            whole = (text[last - n + 1] == text[last]) & (last >= context)
            yield text[last[whole]], run[whole]

    def parts(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The texts as (lower-cased bytes, bounds, words of context): together, or a long one in parts.

        A part begins with the last ``ngrams - 1`` words of the part before, so no run is lost.
        """
        low = self.lower[raw]
        if len(at) != 2 or len(low) <= CHUNK_BYTES:
            yield low, at, 0
            return
        tail, context, pos = np.zeros(0, np.uint8), 0, 0
        while pos < len(low):
            stop = pos + CHUNK_BYTES
            if stop < len(low):
                gaps = np.flatnonzero(~self.inside[low[pos:stop]])
                if len(gaps):
                    stop = pos + int(gaps[-1]) + 1
                else:
                    after = np.flatnonzero(~self.inside[low[stop:]])
                    stop = stop + int(after[0]) + 1 if len(after) else len(low)
            part = np.concatenate([tail, low[pos:stop]])
            bounds = np.array([0, len(part)])
            yield part, bounds, context
            begin, end = self.words(part, bounds)
            context = min(self.ngrams - 1, len(begin))
            tail = np.concatenate([part[begin[-context]:end[-1]], np.array([32], np.uint8)]) if context else part[:0]
            pos = stop


def _count_buckets(text_col: str, ngrams: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Crc32Grams(ngrams), np.zeros(buckets, np.int64)
        for piece in byte_slices(batches, text_col, CHUNK_BYTES):
            for raw, at, context in hasher.parts(*utf8_parts(piece.column(text_col))):
                for _, crc in hasher.grams(raw, at, context):
                    total += np.bincount(crc % buckets, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", ngrams: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket; every task counts its texts first."""
    only = texts.select(F.col(text_col).cast("string").alias("text"))
    counted = map_arrow(only, _count_buckets("text", ngrams, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():        # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the corpus's) of each bucket."""
    a, b, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (a + k) / ((s + 1.0) * (b + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh(ngrams: int, gains: np.ndarray):
    buckets = len(gains)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Crc32Grams(ngrams)
        for piece in byte_slices(batches, "text", CHUNK_BYTES):
            rows = piece.num_rows
            words, features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for raw, at, context in hasher.parts(*utf8_parts(piece.column("text"))):
                for n, (text, crc) in enumerate(hasher.grams(raw, at, context)):
                    count = np.bincount(text, minlength=rows)
                    words += count if n == 0 else 0
                    features += count
                    # sums of whole numbers below 2**53 are exact in doubles
                    weight += np.bincount(text, gains[crc % buckets].astype(np.float64), rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), *(pa.array(x, pa.int64()) for x in (words, features, weight))],
                ["id", "n_words", "n_features", "weight"])
    return run


def gumbel_score(doc_id: Column, weight: Column, seed: int) -> Column:
    """weight + floor(-1000 ln(-ln u)), u fixed by the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _middle(keys: np.ndarray) -> list[int] | None:
    """The lower median of the rows of ``keys``, compared column by column."""
    if not len(keys):
        return None
    order = np.lexsort(keys.T[::-1])
    return keys[order[(len(keys) - 1) // 2]].tolist()


def _split_report(width: int, pivot: list[int] | None):
    """One row per task: how many keys lie before, at and after the pivot, and the medians of either side."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.column_stack([c.to_numpy() for c in b.columns]) for b in batches if b.num_rows]
        keys = np.concatenate(parts) if parts else np.zeros((0, width), np.int64)
        if pivot is None:
            before = np.zeros(len(keys), bool)
            equal = before
        else:
            before, equal = np.zeros(len(keys), bool), np.ones(len(keys), bool)
            for c, p in enumerate(pivot):
                before |= equal & (keys[:, c] < p)
                equal &= keys[:, c] == p
        low, high = keys[before], keys[~before & ~equal]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(low)], pa.int64()), pa.array([int(equal.sum())], pa.int64()), pa.array([len(high)], pa.int64()),
             pa.array([_middle(low)], pa.list_(pa.int64())), pa.array([_middle(high)], pa.list_(pa.int64()))],
            ["n_before", "n_at", "n_after", "mid_before", "mid_after"])
    return run


def weighted_median(medians: list[tuple[list[int], int]]) -> list[int]:
    """The first of the sorted medians at which half of all weight is reached."""
    half, so_far = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        so_far += n
        if so_far >= half:
            return key
    raise ValueError("no median")


def kth_key(keys: DataFrame, k: int) -> list[int]:
    """The ``k``-th smallest row (from 1) of a table of whole-number columns without nulls, column by column.

    One job a round; each task sends one row, and each round discards a quarter of the open
    keys or more. What is left is written anew whenever three quarters of the table are
    discarded, so all rounds together read a small multiple of the table once.
    """
    columns = keys.columns
    struct = F.struct(*columns)

    def literal(key: list[int]) -> Column:
        return F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(columns, key)])

    schema = "n_before long, n_at long, n_after long, mid_before array<long>, mid_after array<long>"
    stored, low, high, pivot, size = keys, None, None, None, None
    while True:
        open_ = stored
        if low is not None:
            open_ = open_.where(struct > literal(low))
        if high is not None:
            open_ = open_.where(struct < literal(high))
        report = map_arrow(open_, _split_report(len(columns), pivot), schema).collect()     # a row per task
        before, at, after = (sum(r[c] for r in report) for c in ("n_before", "n_at", "n_after"))
        if size is None:
            size = before + at + after
            if not 1 <= k <= size:
                raise ValueError(f"there is no key {k} of {size}")
        if before < k <= before + at:
            return pivot
        if k <= before:
            high, left, medians = pivot, before, [(r.mid_before, r.n_before) for r in report if r.n_before]
        else:
            k -= before + at
            low, left, medians = pivot if pivot is not None else low, after, [(r.mid_after, r.n_after) for r in report if r.n_after]
        pivot = weighted_median(medians)
        if 4 * left <= size:
            kept = stored
            if low is not None:
                kept = kept.where(struct > literal(low))
            if high is not None:
                kept = kept.where(struct < literal(high))
            stored, low, high, size = scratch_table(kept, "open-keys"), None, None, left


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, ngrams: int = 3,
                        buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    floor(percent * N / 100) of the N documents with ``min_words`` words or more are drawn,
    by falling score, then smaller id (null last), then fewer features. Null and empty texts
    have no features and weight 0. Rows that repeat an id are documents of their own. An
    empty target or corpus gives counts of zero; an empty corpus gives an empty result.
    Only the columns named here are read, so others may have any name.
    """
    corpus = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(corpus, "text", ngrams, buckets),
                         bucket_counts(target, target_text_col, ngrams, buckets))
    weighed = map_arrow(corpus, _weigh(ngrams, gains), "id long, n_words long, n_features long, weight long")
    scored = scratch_table(weighed.withColumn("score", gumbel_score(F.col("id"), F.col("weight"), seed)), "scored")
    wanted = scored.where(F.col("n_words") >= min_words).count() * percent // 100
    columns = ["id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    keyed = scored.select(*columns, (-F.col("score")).alias("k_score"), F.col("id").isNull().cast("long").alias("k_null"),
                          F.coalesce("id", F.lit(0)).alias("k_id"), F.col("n_features").alias("k_features"))
    cutoff = kth_key(keyed.where(F.col("n_words") >= min_words).select(*_KEYS), wanted)
    limit = F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(_KEYS, cutoff)])
    wins = (F.col("n_words") >= min_words) & (F.struct(*_KEYS) <= limit)
    # rows equal in all keys are equal in the result; the row number only splits them over ranges
    winners = keyed.where(wins).withColumn("k_row", F.xxhash64(F.monotonically_increasing_id()))
    ranked = global_row_number(winners, [*_KEYS, "k_row"], "rank")
    drawn = F.when(F.col("rank") <= wanted, F.col("rank").cast("long"))
    return (ranked.select(*columns, drawn.alias("rank"))
            .unionByName(keyed.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank"))))
