"""Exact order statistics by sketch brackets: two reads of the input, nothing written.

The first read builds, per group, a mergeable quantile sketch (KLL) beside count, mean,
squared deviations and range. For every wanted rank the sketch gives two values that
bracket it: the ranks ``MARGIN`` error bounds before and after. The second read counts the
values below each bracket and, by value, those inside; only these (a share of about
2 · ``MARGIN`` · error of the rows, fewer where values repeat) are ordered, and the wanted
ranks are read off their running counts. A rank outside its bracket, which the sketch's
error bound all but excludes, raises instead of giving a wrong value.

Sketches are merged in two steps (``SALTS`` partial groups first), so no task reads the
sketches of all map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_K = 4096
# Published single-sided rank error of a KLL sketch at 99 %: 2.296 / k**0.9021.
SKETCH_ERROR = 2.296 / SKETCH_K ** 0.9021
MARGIN = 3
SALTS = 64


def _partial_moments(values: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, mean, m2, min, max, sketch) from one read; values that are NULL or NaN do not count."""
    first = values.groupBy(*groups, F.expr(f"pmod(spark_partition_id(), {SALTS})").alias("_salt")).agg(*[
        F.expr(e).alias(name) for name, e in (
            ("n", "count(_v)"), ("mean", "avg(_v)"), ("m2", "var_pop(_v) * count(_v)"), ("min", "min(_v)"), ("max", "max(_v)"),
            ("sketch", f"kll_sketch_agg_double(_v, {SKETCH_K})"))])
    merged = first.groupBy(*groups).agg(*[
        F.expr(e).alias(name) for name, e in (
            ("n", "sum(n)"), ("parts", "collect_list(CASE WHEN n > 0 THEN struct(n, mean, m2) END)"), ("min", "min(min)"), ("max", "max(max)"),
            ("sketch", f"kll_merge_agg_double(CASE WHEN n > 0 THEN sketch END, {SKETCH_K})"))])
    merged = merged.selectExpr("*", "try_divide(aggregate(parts, 0D, (s, p) -> s + p.n * p.mean), n) AS mean")
    off = "aggregate(parts, 0D, (s, p) -> s + p.m2 + p.n * (p.mean - mean) * (p.mean - mean))"
    return merged.selectExpr(*[f"`{c}`" for c in merged.columns if c != "parts"], f"{off} AS m2")


class Target(NamedTuple):
    """Ranks (from 1) to look up, as SQL over column ``n`` and the groups, all within two of ``share`` · n.

    A share that differs by group is a dictionary by the (whole-number) value of the first group column.
    """
    share: float | dict[int, float]
    ranks: list[str]


def _bracket(target: Target, by: float, end: str, key: str) -> str:
    """SQL of the value ``by`` off the target's share; ``end`` beyond the shares and where all values are inside."""
    def value_at(share: float) -> str:
        if not 0 < share < 1:
            return f"`{end}`"
        return f"CASE WHEN n <= {SKETCH_K} THEN `{end}` ELSE kll_sketch_get_quantile_double(sketch, {share!r}D) END"
    if isinstance(target.share, dict):
        return f"CASE `{key}` " + " ".join(f"WHEN {g} THEN {value_at(p + by)}" for g, p in target.share.items()) + " END"
    return value_at(target.share + by)


def values_at_ranks(values: DataFrame, targets: Sequence[Target], groups: Sequence[str] = ()) -> DataFrame:
    """The values of column ``_v`` at the wanted ranks of each group, with the group's moments:
    (groups…, n, mean, m2, min, max, and for rank j of target i: at{i}_{j}, before{i}_{j}, same{i}_{j}).

    ``before`` counts the smaller values and ``same`` the equal ones. NULL values do not count.
    """
    groups, keys = list(groups), list(groups)
    if not groups:
        values, keys = values.withColumn("_all", F.expr("pmod(spark_partition_id(), 1)")), ["_all"]
    # a rank lies at most two values off its share of the rows; so few values are all inside
    slack = MARGIN * SKETCH_ERROR + 2 / SKETCH_K
    moments = _partial_moments(values, keys)
    brackets = moments.selectExpr(*[f"`{c}`" for c in moments.columns if c != "sketch"], *[
        f"{_bracket(t, by, end, keys[0])} AS {side}{i}" for i, t in enumerate(targets)
        for side, by, end in (("from", -slack, "min"), ("to", slack, "max"))])
    # the sketch is random, so its brackets are used once and travel with what they counted
    fixed = [c for c in brackets.columns if c not in keys]
    placed = values.join(F.broadcast(brackets), keys)           # one row per group
    every = range(len(targets))
    inside = " OR ".join(f"_v BETWEEN from{i} AND to{i}" for i in every)
    counted = placed.groupBy(*keys, F.expr(f"CASE WHEN {inside} THEN _v END").alias("_x")).agg(
        F.expr("count(_v)").alias("_c"), *[F.expr(f"max(`{c}`)").alias(c) for c in fixed],
        *[F.expr(f"count_if(_v < from{i})").alias(f"_below{i}") for i in every])
    by = "PARTITION BY " + ", ".join(f"`{c}`" for c in keys)
    run = f"OVER ({by} ORDER BY _x NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ranked = counted.selectExpr("*", *[
        f"CASE WHEN _x >= from{i} THEN sum(_below{i}) OVER ({by}) + sum(CASE WHEN _x >= from{i} THEN _c ELSE 0 END) {run} END AS _last{i}"
        for i in every])
    picks = [F.expr(f"max(`{c}`)").alias(c) for c in fixed]
    for i, target in enumerate(targets):
        for j, rank in enumerate(target.ranks):
            holds = f"_last{i} - _c < {rank} AND {rank} <= _last{i}"
            picks += [F.expr(f"max(CASE WHEN {holds} THEN {what} END)").alias(f"{name}{i}_{j}")
                      for what, name in (("_x", "at"), (f"_last{i} - _c", "before"), ("_c", "same"))]
    picked = ranked.groupBy(*groups).agg(*picks)                # without groups always one row
    lost = " OR ".join(f"at{i}_{j} IS NULL" for i, t in enumerate(targets) for j in range(len(t.ranks)))
    n = f"CASE WHEN n > 0 AND ({lost}) THEN raise_error('a wanted rank lies outside its sketch bracket') ELSE coalesce(n, 0) END"
    return picked.withColumn("n", F.expr(n))


def summarise(df: DataFrame, value: str, probs: dict[str, float], group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group: (groups…, n, mean, std, min, max, one column per entry of ``probs``).

    Exact quantiles with linear interpolation (pandas/numpy default): at h = (n-1)·p the result
    is v[⌊h⌋] + (v[⌊h⌋+1] − v[⌊h⌋])·(h − ⌊h⌋). NULL and NaN values are skipped; a group
    without values has n 0 and NULL elsewhere; rows with a NULL group are left out. ``std`` is
    the sample deviation, NULL below two values.

    The groups are those an analysis names (columns, variants): one bracket row per group is
    broadcast, and a group's few values inside brackets meet in one task. For groups that
    grow with the data use ``rank.exact_quantiles``.
    """
    groups = list(group_cols)
    v = F.col(value).cast("double")
    values = df.select(*groups, F.when(~F.isnan(v), v).alias("_v"))
    values = values.na.drop(subset=groups) if groups else values
    targets, finals = [], []
    for i, (alias, p) in enumerate(probs.items()):
        h = f"((n - 1) * {float(p)!r}D)"
        targets.append(Target(p, [f"(floor({h}) + 1)", f"least(floor({h}) + 2, n)"]))
        finals.append(F.expr(f"at{i}_0 + (at{i}_1 - at{i}_0) * ({h} - floor({h}))").alias(alias))
    std = F.expr("CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END")
    return values_at_ranks(values, targets, groups).select(*groups, "n", "mean", std.alias("std"), "min", "max", *finals)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups…, one column per entry of ``probs``): the quantiles of ``summarise``; groups without values are left out."""
    out = summarise(df, value, probs, group_cols)
    return (out.where("n > 0") if group_cols else out).select(*group_cols, *probs)
