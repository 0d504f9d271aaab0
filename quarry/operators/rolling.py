"""Running totals per key (W1) and the rolling-share analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col_, pct


def running_total(df: DataFrame, keys: Sequence[str], order: str, value, out: str,
                  pre_aggregate: bool = True, segmented: bool = False,
                  num_buckets: int | None = None, keys_may_be_null: bool = True) -> DataFrame:
    """``sum(value) over (partition by keys order by order)`` with the default RANGE frame.

    Rows with equal ``order`` inside a key share one total; NULL values add nothing.
    ``keys_may_be_null=False`` when keys and order can never be NULL (e.g. after an inner
    equi-join on them) lets the join back use plain equality.

    ``pre_aggregate`` (default): sum per (keys, order) first - partial aggregation, so a
    key holding a third of all rows is reduced map-side - then run the window over that
    table, whose partitions hold one row per distinct ``order`` value, and join the
    totals back on (keys, order) with null-safe equality. The join's build side has one
    row per join key, so AQE's skew-join handling can split a hot key on the probe side.
    Without it the window sorts each key's raw rows in one task: for inputs that already
    hold one row per (keys, order).

    ``segmented``: for keys with an unbounded number of distinct ``order`` values (a
    key holding a third of all timestamps), the per-step table is cut into balanced
    contiguous ranges of (keys, order) (``rank.ordered_buckets``); each (range, key)
    segment gets its own running sum, plus the total of the same key in earlier ranges
    from a table with at most #ranges + #keys rows. No task holds a whole key.
    """
    keys = list(keys)
    v = col_(value)
    w = Window.partitionBy(*keys).orderBy(order)
    if not pre_aggregate:
        return df.withColumn(out, F.sum(v).over(w))
    per_step = df.groupBy(*keys, order).agg(F.sum(v).alias("_step"))
    if segmented:
        running = _segmented_running_sum(per_step, keys, order, num_buckets)
    else:
        running = per_step.withColumn("_run", F.sum("_step").over(w))
    if not keys_may_be_null:
        # Plain equality keeps the join on the (keys, order) hash partitioning the input
        # usually already has (null-safe keys are rewritten and force another shuffle).
        totals = running.select(*keys, order, F.col("_run").alias(out))
        return df.join(totals, [*keys, order], "left").select(*df.columns, out)
    totals = running.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, order]], F.col("_run").alias(out))
    cond = [df[k].eqNullSafe(totals[f"_k_{k}"]) for k in [*keys, order]]
    return df.join(totals, cond, "left").drop(*[f"_k_{k}" for k in [*keys, order]])


def _segmented_running_sum(steps: DataFrame, keys: list[str], order: str, num_buckets: int | None) -> DataFrame:
    from .rank import BUCKET, POS, ordered_buckets
    b = ordered_buckets(steps, [*keys, order], num_buckets)
    in_seg = Window.partitionBy(BUCKET, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_seg_run", F.sum("_step").over(in_seg))
    seg = b.groupBy(BUCKET, *keys).agg(F.sum("_step").alias("_seg"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = seg.select(*[F.col(k).alias(f"_c_{k}") for k in [BUCKET, *keys]],
                       F.sum("_seg").over(earlier).alias("_carry"))
    cond = [b[k].eqNullSafe(carry[f"_c_{k}"]) for k in [BUCKET, *keys]]
    j = b.join(carry, cond, "left")
    run = F.when(F.col("_seg_run").isNull() & F.col("_carry").isNull(), F.lit(None)) \
           .otherwise(F.coalesce("_seg_run", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return j.select(*keys, order, "_step", run.alias("_run"))


def rolling_vaccinations(deaths: DataFrame, vacs: DataFrame) -> DataFrame:
    """Join deaths and vaccinations on (location, date), country rows only, running total.

    (continent, location, date, population, new_vaccinations, rolling_vaccinations_count)
    """
    country_days = deaths.select("continent", "location", "date", "population").where(F.col("continent").isNotNull())
    both = country_days.join(vacs.select("location", "date", "new_vaccinations"), ["location", "date"])
    both = both.select("continent", "location", "date", "population", "new_vaccinations")
    # One row per location and day: aggregating first would reduce nothing, so the window reads the rows.
    return running_total(both, ["location"], "date", F.col("new_vaccinations").cast("bigint"),
                         "rolling_vaccinations_count", pre_aggregate=False)


def rolling_share(rolling: DataFrame) -> DataFrame:
    """Adds the running share of the population vaccinated, in percent."""
    return rolling.withColumn("rolling_percent_vaccinated",
                              pct(F.col("rolling_vaccinations_count").cast("double"), F.col("population")))
