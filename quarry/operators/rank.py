"""Whole-table ordered operators without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` plans ``Exchange SinglePartition``: every
row of the table goes through one task. At scale that is the bottleneck (and an OOM
risk), so the global operators here run as:

1. ``repartitionByRange(*order)`` - Spark samples the *full* sort key (including the
   tie-break columns) to pick range bounds, so buckets are balanced even when one value
   holds a large share of rows: the tie-break splits it. AQE may merge neighbouring
   ranges of a small input; a merged partition is still one contiguous range.
2. ``sortWithinPartitions`` + the position of each row inside its bucket
   (``monotonically_increasing_id`` minus the partition's id base: no shuffle).
3. ``checkpoint()`` into the shared checkpoint folder: range bounds come from sampling,
   so the bucket assignment is fixed once and reused by every later branch, and the
   lineage is cut (an executor loss does not re-sample).
4. A per-bucket count table (one row per bucket, a bounded size set by ``num_buckets``)
   gives each bucket's offset; it is broadcast back, and rank = offset + position + 1.

Exact whatever bounds the sampling picks; only the balance depends on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

BUCKET = "_bucket"
POS = "_pos"
OFFSET = "_offset"
TOTAL = "_total"

# Partition index lives in the upper 31 bits of monotonically_increasing_id.
_ID_SHIFT = 33


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ordered_buckets(df: DataFrame, order: Sequence[str | Column], num_buckets: int | None = None) -> DataFrame:
    """Tag rows with ``_bucket`` (contiguous ranges of ``order``) and ``_pos`` inside it.

    Without ``num_buckets`` the range shuffle starts at ``spark.sql.shuffle.partitions``
    and AQE may coalesce neighbouring ranges to its advisory partition size, so the number
    of ranges follows the data size (a coalesced partition is still one contiguous range,
    and its index still orders the ranges).
    """
    cols = _cols(order)
    pid = F.spark_partition_id()
    ranged = df.repartitionByRange(num_buckets, *cols) if num_buckets else df.repartitionByRange(*cols)
    tagged = (ranged
                .sortWithinPartitions(*cols)
                .withColumn(BUCKET, pid)
                .withColumn(POS, F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), _ID_SHIFT)))
    return reliable_checkpoint(tagged)


def bucket_offsets(buckets: DataFrame) -> DataFrame:
    """(``_bucket``, ``_offset``, ``_total``): rows before each bucket and in all buckets.

    One row per bucket, so the un-partitioned window here sorts at most ``num_buckets``
    rows; the result is small by construction and broadcast by the callers.
    """
    counts = buckets.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(BUCKET,
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(OFFSET),
                         F.sum("_n").over(everything).alias(TOTAL))


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "rn",
                      num_buckets: int | None = None, keep_total: bool = False) -> DataFrame:
    """``row_number() over (order by <order>)`` computed without a single-partition sort.

    ``order`` should be a total order (add a key); otherwise tied rows get an arbitrary
    but consistent numbering, as with the built-in window.
    """
    b = ordered_buckets(df, order, num_buckets)
    off = bucket_offsets(b)
    out = (b.join(F.broadcast(off), BUCKET)
            .withColumn(name, F.col(OFFSET) + F.col(POS) + 1)
            .drop(BUCKET, POS, OFFSET))
    return out if keep_total else out.drop(TOTAL)


def ntile_from_rank(rn: Column, total: Column, k: int) -> Column:
    """``ntile(k)`` from a 1-based row number and the row count.

    With q, r = divmod(N, k) the first r tiles hold q+1 rows and the rest q rows; when
    N < k every row is its own tile (q = 0, r = N).
    """
    q = F.floor(total / k)
    r = total % k
    big = F.ceil(rn / (q + 1))
    small = F.ceil((rn - r) / q)
    return F.when(rn <= r * (q + 1), big).otherwise(small).cast("int")


def ntile(df: DataFrame, k: int, order: Sequence[str | Column], name: str = "ntile",
          num_buckets: int | None = None) -> DataFrame:
    """Add ``ntile(k) over (order by <order>)`` as column ``name``, by the distributed rank."""
    ranked = global_row_number(df, order, name="_rn", num_buckets=num_buckets, keep_total=True)
    return ranked.withColumn(name, ntile_from_rank(F.col("_rn"), F.col(TOTAL), k)).drop("_rn", TOTAL)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    group_cols: Sequence[str] = (), num_buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default), NULLs skipped.

    Returns one row per group with one column per entry of ``probs`` (alias → p); rows with
    a NULL group are left out, as pandas' grouping does. At position h = (n-1)·p the result is
    v[⌊h⌋] + (v[⌊h⌋+1] − v[⌊h⌋])·(h − ⌊h⌋).

    Only the value and group columns are read, and equal values are counted first (a
    partial aggregate, so a hot value collapses before any shuffle). The (group, value,
    count) rows are cut into ranges; a small table of count totals per (range, group) gives
    the rows before each range, and a window per (range, group) the rows before each value.
    No exchange that carries those rows is keyed by the group alone.
    """
    groups = list(group_cols)
    counts = (df.select(*groups, F.col(value).cast("double").alias("_v")).dropna()
                .groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranges = ordered_buckets(counts, [*groups, "_v"], num_buckets).drop(POS)
    # one row per range and group that it holds: at most ranges + groups rows
    per_range = ranges.groupBy(BUCKET, *groups).agg(F.sum("_c").alias("_s"))
    in_group = Window.partitionBy(*groups).orderBy(BUCKET)
    before = per_range.select(
        BUCKET, *groups,
        F.coalesce(F.sum("_s").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_s").over(in_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    inside = Window.partitionBy(BUCKET, *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (ranges.withColumn("_upto", F.sum("_c").over(inside)).join(before, [BUCKET, *groups])
                    .withColumn("_last", F.col("_before") + F.col("_upto"))
                    .withColumn("_first", F.col("_last") - F.col("_c") + 1))

    def holds(rank: Column) -> Column:
        return (F.col("_first") <= rank) & (rank <= F.col("_last"))

    aggs, finals, wanted = [], [], F.lit(False)
    for alias, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.floor(h) + 1
        hi = F.least(lo + 1, F.col("_n"))
        wanted = wanted | holds(lo) | holds(hi)
        aggs += [F.max(F.when(holds(lo), F.col("_v"))).alias(f"{alias}__lo"),
                 F.max(F.when(holds(hi), F.col("_v"))).alias(f"{alias}__hi"),
                 F.max(h - F.floor(h)).alias(f"{alias}__f")]
        finals.append((F.col(f"{alias}__lo") + (F.col(f"{alias}__hi") - F.col(f"{alias}__lo")) * F.col(f"{alias}__f"))
                      .alias(alias))
    picked = ranked.where(wanted)
    agg = picked.groupBy(*groups).agg(*aggs) if groups else picked.agg(*aggs)
    return agg.select(*groups, *finals)
