"""Shared helpers of the operators: scratch tables, Arrow text access, word hashes, components.

Every operator reads only the columns it names, under its own internal names, so extra
columns of the input (whatever they are called) never clash with its results.
"""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import scratch_path

# Slice of an Arrow batch that one numpy step works on; a longer single text is one slice.
SLICE_BYTES = 4 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_files_freed(spark: SparkSession):
    """Spark drops the shuffle files of each query run inside as soon as it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder, and reread.

    Cuts the lineage like a checkpoint does, but stays columnar and compressed; the files
    are shared, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_files_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _package_archive() -> str:
    """The library as a zip archive on the driver."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-py-"), "quarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Executors get the library from the driver (once per context), wherever they run."""
    sc = spark.sparkContext
    if not getattr(sc, "_quarry_shipped", False):
        sc.addPyFile(_package_archive())
        sc._quarry_shipped = True


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def byte_slices(batches: Iterable[pa.RecordBatch], column: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, all of them, in slices of at most ``max_bytes`` of ``column`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, where each text begins and the last one ends); null is empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def utf8_list(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null is empty."""
    raw, at = utf8_parts(column)
    raw = raw.tobytes()
    at = at.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def int64_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, mask of the values that are there)."""
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), there


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (shift-xor-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of ASCII-whitespace separated words, for a whole slice of texts at once.

    A word's hash is a polynomial in an odd base over random byte values; prefix sums
    modulo 2**64 give every word's value by one subtraction. Two hashers with different
    seeds are independent.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self._byte = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self._base = int(rng.integers(0, 2**62)) * 4 + 3
        self._inverse = pow(self._base, -1, 2**64)
        self._up = self._down = np.ones(1, np.uint64)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self._space = space

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = 1 << int(n - 1).bit_length()
            self._up, self._down = (np.full(n, x, np.uint64) for x in (self._base, self._inverse))
            for powers in (self._up, self._down):
                powers[0] = 1
                np.cumprod(powers, out=powers)

    def words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, byte after the last, hash) of each word, and the first word of each text (n + 1)."""
        if not len(raw):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
        inside = ~self._space[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self._byte[raw] * self._up[:len(raw)], out=total[1:])
        h = mix64((total[end] - total[begin]) * self._down[begin] + (end - begin).astype(np.uint64))
        return begin, end, h, np.searchsorted(begin, at)


def window_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes (by first word); shorter tails are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(base)
        out += h[k:k + m]
    return mix64(out)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node each of ``n`` nodes reaches over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)``; the component is its smallest node.

    Alternating large-star and small-star rounds: each round re-hangs the neighbours of a
    node on the smallest of them, until nothing changes. The smallest neighbour is a
    partial aggregate joined back, so a node with very many links splits like any skewed
    join; each round is a scratch table. Only the change check (a count and a checksum)
    comes to the driver. Nulls and self-links are ignored.
    """
    spark = edges.sparkSession
    one_way = (edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    current = scratch_table(one_way, name)
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch_table(large.where("u != v"), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        current = scratch_table(small, name)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
