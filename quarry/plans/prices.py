"""BTC/ETH price analyses over the ``prices`` view: gaps, fill, statistics, outliers, charts.

The notebook's data flow is kept: gaps are diagnosed on the raw series; the back-fill then
replaces the frame, and every later step reads the filled data or ``data_cleaned`` (filled, two dates dropped). ``bitcoin`` has no gaps,
so steps that only read it skip the fill: their result is the same.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.scalar import format_number_line
from ..operators import charts, clean, dq, resampling, stats
from ..sources import catalog, stored
from ..sources.tables import table_path
from ..sources.views import prices
from .registry import query
from .sqlgen import REPLICATES, SEED, edge_rows_sql, hist_sql, in_bin_sql, union_all, weights_sql

P = ("prices",)
COLS = ["event_id", "ts", "bitcoin", "ether"]
SERIES = ["bitcoin", "ether"]

# Parameters of the registered queries.
CONTEXT = ("2024-01-06", "2024-01-12")       # the days around the five-day ether gap (7..11)
DROP_DAYS = ["2024-01-07", "2024-01-21"]
MASK_BELOW = 20.0
ORDER = ["ts", "event_id"]


def _r(c, n=6):
    return F.round(c, n)


def _drop_days_sql():
    return ", ".join(f"DATE '{d}'" for d in DROP_DAYS)


def _drop_days(df):
    return clean.drop_keys(df, F.to_date("ts"), [dt.date.fromisoformat(x) for x in DROP_DAYS])


def _data(spark, d):
    """The series after the back-fill."""
    return clean.backfill(prices(spark, d), "ether", ORDER)


def _data_cleaned(spark, d):
    return _drop_days(_data(spark, d))


def _bitcoin_cleaned(spark, d):
    """``data_cleaned`` for steps reading bitcoin only (no gaps: the fill changes nothing)."""
    return _drop_days(prices(spark, d)).select("event_id", "ts", "bitcoin")


# Oracle CTEs for the same frames.
_DATA_SQL = f""", data AS (
  SELECT event_id, ts, bitcoin,
         first_value(ether IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           AS ether
  FROM prices),
data_cleaned AS (SELECT * FROM data WHERE (CAST(ts AS DATE) IN ({_drop_days_sql()})) IS NOT TRUE),
btc_cleaned AS (SELECT event_id, ts, bitcoin FROM prices WHERE (CAST(ts AS DATE) IN ({_drop_days_sql()})) IS NOT TRUE)
"""


@query("null_audit", covers="I6", views=P, sql=union_all(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM prices" for c in COLS))
def null_audit(spark, d):
    return dq.null_counts(prices(spark, d), COLS)


@query("any_null", covers="I5 C7", views=P, sql=union_all(
    f"SELECT '{c}' AS column_name, coalesce(bool_or({c} IS NULL), false) AS has_null FROM prices" for c in COLS))
def any_null(spark, d):
    return dq.any_null(prices(spark, d), COLS)


@query("null_rows", covers="I7 C7", views=P, sql="SELECT * FROM prices WHERE ether IS NULL")
def null_rows(spark, d):
    return dq.null_rows(prices(spark, d), "ether")


@query("date_slice", covers="P10 C7", views=P, sql=f"""
SELECT * FROM prices WHERE ts >= TIMESTAMP '{CONTEXT[0]}' AND ts < TIMESTAMP '{CONTEXT[1]}' + INTERVAL 1 DAY""")
def date_slice(spark, d):
    return clean.date_slice(prices(spark, d), "ts", *CONTEXT)


@query("gap_days", covers="P10 S1 G1 I7", views=P, sql="""
SELECT *, CAST(ts AS DATE) AS day FROM prices
WHERE CAST(ts AS DATE) IN (SELECT CAST(ts AS DATE) FROM prices GROUP BY 1 HAVING count(ether) = 0)""")
def gap_days(spark, d):
    # the series stored by day; the days without any ether price are found in the summary and only they are read
    files = stored.bucket_count(stored.stored_bytes(spark, table_path(d, "events")))
    by_day = stored.store_by_day(prices(spark, d), catalog.unique_name("prices"), "ts", ["ts", "event_id"], files)
    summary = stored.day_summary(by_day, catalog.unique_name("price_days"), F.count("ether").alias("n_ether"))
    return stored.days_where(by_day, summary, F.col("n_ether") == 0)


@query("bfill", covers="W3 C7", views=P, sql="""
SELECT *, first_value(ether IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          AS ether_filled FROM prices""")
def bfill(spark, d):
    return clean.backfill(prices(spark, d), "ether", ORDER, out="ether_filled")


@query("drop_dates", covers="P12 X9 C6", views=P, sql=_DATA_SQL + "SELECT * FROM data_cleaned")
def drop_dates(spark, d):
    return _data_cleaned(spark, d)


@query("drop_mask", covers="P13", views=P, sql=f"SELECT * FROM prices WHERE NOT coalesce(ether < {MASK_BELOW}, false)")
def drop_mask(spark, d):
    return clean.drop_masked(prices(spark, d), F.col("ether") < MASK_BELOW)


def _variants(spark, d):
    data = _data(spark, d)
    return data.withColumn("variant", F.lit("raw")).unionByName(_drop_days(data).withColumn("variant", F.lit("cleaned")))


_VARIANTS_SQL = """variants AS (SELECT 'raw' AS variant, * FROM data UNION ALL SELECT 'cleaned' AS variant, * FROM data_cleaned)
"""


@query("central_tendency", covers="A10 C6", views=P, sql=_DATA_SQL + ", " + _VARIANTS_SQL + union_all(
    f"SELECT variant, '{c}' AS column_name, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median "
    f"FROM variants GROUP BY variant" for c in SERIES))
def central_tendency(spark, d):
    out = stats.central_tendency(_variants(spark, d), SERIES, extra=["variant"])
    return out.select("variant", "column_name", _r(F.col("mean")).alias("mean"), _r(F.col("median")).alias("median"))


@query("dispersion", covers="A11 A12 C6", views=P, sql=_DATA_SQL + ", " + _VARIANTS_SQL + union_all(
    f"SELECT variant, '{c}' AS column_name, round(max({c}) - min({c}), 6) AS value_range, "
    f"round(var_samp({c}), 6) AS variance, round(stddev_samp({c}), 6) AS std FROM variants GROUP BY variant"
    for c in SERIES))
def dispersion(spark, d):
    out = stats.dispersion(_variants(spark, d), SERIES, extra=["variant"])
    return out.select("variant", "column_name", *[_r(F.col(c)).alias(c) for c in ("value_range", "variance", "std")])


@query("quantiles", covers="A13 G7", views=P, sql=_DATA_SQL + """
SELECT round(quantile_cont(bitcoin, 0.2), 6) AS q20, round(quantile_cont(bitcoin, 0.5), 6) AS q50 FROM btc_cleaned""")
def quantiles(spark, d):
    q = stats.quantiles(_bitcoin_cleaned(spark, d), "bitcoin", {"q20": 0.2, "q50": 0.5})
    return q.select(_r(F.col("q20")).alias("q20"), _r(F.col("q50")).alias("q50"))


def _btc_variants(spark, d):
    p = prices(spark, d).select("ts", "bitcoin")
    return p.withColumn("variant", F.lit("raw")).unionByName(_drop_days(p).withColumn("variant", F.lit("cleaned")))


@query("iqr", covers="A14 C6", views=P, sql=_DATA_SQL + """
, v AS (SELECT 'raw' AS variant, bitcoin FROM prices UNION ALL SELECT 'cleaned' AS variant, bitcoin FROM btc_cleaned)
SELECT variant, round(quantile_cont(bitcoin, 0.25), 6) AS q25, round(quantile_cont(bitcoin, 0.75), 6) AS q75,
       round(quantile_cont(bitcoin, 0.75) - quantile_cont(bitcoin, 0.25), 6) AS iqr
FROM v GROUP BY variant""")
def iqr(spark, d):
    q = stats.iqr(_btc_variants(spark, d), "bitcoin", ["variant"])
    return q.select("variant", *[_r(F.col(c)).alias(c) for c in ("q25", "q75", "iqr")])


_Z_SQL = "avg(bitcoin) {op} 2 * stddev_samp(bitcoin)"
_IQR_SQL = "avg(bitcoin) {op} 2 * (quantile_cont(bitcoin, 0.75) - quantile_cont(bitcoin, 0.25))"


@query("zscore_limits", covers="C3 X11 G7", views=P, sql=f"""
SELECT round({_Z_SQL.format(op='-')}, 6) AS lower_limit, round({_Z_SQL.format(op='+')}, 6) AS upper_limit FROM prices""")
def zscore_limits(spark, d):
    lim = stats.zscore_limits(prices(spark, d), "bitcoin")
    return lim.select(*[_r(F.col(c)).alias(c) for c in ("lower_limit", "upper_limit")])


@query("iqr_limits", covers="C4 X11 G7", views=P, sql=f"""
SELECT round({_IQR_SQL.format(op='-')}, 6) AS lower_limit, round({_IQR_SQL.format(op='+')}, 6) AS upper_limit
FROM prices""")
def iqr_limits(spark, d):
    lim = stats.mean_iqr_limits(prices(spark, d), "bitcoin")
    return lim.select(*[_r(F.col(c)).alias(c) for c in ("lower_limit", "upper_limit")])


@query("format_limits", covers="X12", views=P, sql=f"""
SELECT printf('Upper Limit: %.4f', {_Z_SQL.format(op='+')}) AS upper_text,
       printf('Lower Limit: %.4f', {_Z_SQL.format(op='-')}) AS lower_text FROM prices""")
def format_limits(spark, d):
    # four decimals: the last digits of a floating-point sum depend on its order
    return stats.format_limits(stats.zscore_limits(prices(spark, d), "bitcoin"), decimals=4)


@query("format_limits_whole", covers="X12", views=P, sql=f"""
SELECT 'Upper Limit' AS upper_label, round({_Z_SQL.format(op='+')}, 6) AS upper_value, 'Lower Limit' AS lower_label,
       round({_Z_SQL.format(op='-')}, 6) AS lower_value, true AS whole FROM prices""")
def format_limits_whole(spark, d):
    # the whole value is printed: read as a number again it is the limit itself
    limits = stats.zscore_limits(prices(spark, d), "bitcoin")
    both = limits.select("*", *[format_number_line(f"{side.title()} Limit", f"{side}_limit").alias(f"{side}_text") for side in ("upper", "lower")])
    number = {side: F.substring_index(f"{side}_text", ": ", -1).cast("double") for side in ("upper", "lower")}
    return both.select(*[c for side in ("upper", "lower") for c in (
        F.substring_index(f"{side}_text", ": ", 1).alias(f"{side}_label"), _r(number[side]).alias(f"{side}_value"))],
        ((number["upper"] == F.col("upper_limit")) & (number["lower"] == F.col("lower_limit"))).alias("whole"))


@query("outliers_lt", covers="C5 P11", views=P, sql=_DATA_SQL + f"""
SELECT * FROM data WHERE bitcoin < (SELECT {_Z_SQL.format(op='+')} FROM prices)""")
def outliers_lt(spark, d):
    limit = stats.limit(stats.zscore_limits(prices(spark, d), "bitcoin"), "upper_limit")
    return clean.keep_below(_data(spark, d), "bitcoin", limit)


@query("outliers_drop_gt", covers="C5 P13", views=P, sql=_DATA_SQL + f"""
SELECT * FROM data WHERE NOT coalesce(bitcoin > (SELECT {_Z_SQL.format(op='+')} FROM prices), false)""")
def outliers_drop_gt(spark, d):
    limit = stats.limit(stats.zscore_limits(prices(spark, d), "bitcoin"), "upper_limit")
    return clean.drop_above(_data(spark, d), "bitcoin", limit)


@query("series_buckets", covers="G1", views=P, sql=union_all(
    f"SELECT '{c}' AS column_name, date_trunc('day', ts) AS bucket_start, count({c}) AS n, min({c}) AS min, "
    f"max({c}) AS max, round(avg({c}), 6) AS mean FROM prices GROUP BY 2" for c in SERIES))
def series_buckets(spark, d):
    # G1: both raw series, one point per day
    out = charts.series_buckets(prices(spark, d), "ts", SERIES, "1 day")
    return out.withColumn("mean", _r(F.col("mean")))


@query("hist_150", covers="G2", views=P, sql=_DATA_SQL + hist_sql("btc_cleaned", "bitcoin", 150))
def hist_150(spark, d):
    return charts.histogram(_bitcoin_cleaned(spark, d), "bitcoin", 150)


MOST_BINS = 50                               # bars of a distribution plot with default bins


def _default_bins_sql(src: str, col: str, most: int = MOST_BINS) -> str:
    """The Freedman–Diaconis bin count of a column as a scalar subquery."""
    h = "(2 * iqr / pow(CAST(n AS DOUBLE), CAST(1 AS DOUBLE) / 3))"
    return f"""(SELECT CAST(least({most}, CASE WHEN n < 2 THEN 1 WHEN {h} = 0 THEN floor(sqrt(n)) ELSE ceil(rng / {h}) END)
                            AS BIGINT)
                FROM (SELECT count({col}) AS n, max({col}) - min({col}) AS rng,
                             quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) AS iqr FROM {src}) AS spread)"""


@query("density_hist", covers="G3", views=P, sql=_DATA_SQL + hist_sql(
    "btc_cleaned", "bitcoin", _default_bins_sql("btc_cleaned", "bitcoin"), density=True, most=MOST_BINS))
def density_hist(spark, d):
    # Density histogram with the default (Freedman–Diaconis) bins
    btc = _bitcoin_cleaned(spark, d)
    h = charts.histogram(btc, "bitcoin", charts.fd_bins(btc, "bitcoin", MOST_BINS), density=True)
    return h.withColumn("density", F.round("density", 12))


@query("ecdf_50", covers="G6", views=P,
       sql=_DATA_SQL + hist_sql("btc_cleaned", "bitcoin", 50, cumulative=True))
def ecdf_50(spark, d):
    return charts.ecdf(_bitcoin_cleaned(spark, d), "bitcoin", 50)


@query("rug", covers="G5", views=P, sql=_DATA_SQL + """
SELECT bitcoin AS value, count(*) AS n FROM btc_cleaned WHERE bitcoin IS NOT NULL GROUP BY 1""")
def rug(spark, d):
    return charts.rug(_bitcoin_cleaned(spark, d), "bitcoin")


KDE_GRID = 200


@query("kde", covers="G3 G4", views=P, sql=_DATA_SQL + f"""
, st AS (SELECT min(ether) AS lo, max(ether) AS hi, count(ether) AS n,
               stddev_samp(ether) * pow(CAST(count(ether) AS DOUBLE), -0.2) AS bw FROM data_cleaned),
vals AS (SELECT ether AS v, count(*) AS c FROM data_cleaned WHERE ether IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS grid_index FROM range({KDE_GRID})),
pts AS (SELECT grid_index, lo + grid_index * ((hi - lo) / {KDE_GRID - 1}) AS x, n, bw, v, c FROM g, st, vals)
SELECT grid_index, round(x, 9) AS x,
       round(sum(c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM pts GROUP BY grid_index, x, n, bw""")
def kde(spark, d):
    # Density curve between the smallest and largest value
    out = charts.kde(_data_cleaned(spark, d), "ether", gridsize=KDE_GRID, cut=0.0)
    return out.select("grid_index", _r(F.col("x"), 9).alias("x"), _r(F.col("density"), 12).alias("density"))


_PAIRS_SQL = """, pairs AS (SELECT bitcoin, ether FROM data_cleaned WHERE bitcoin IS NOT NULL AND ether IS NOT NULL)
"""


@query("joint_bins", covers="G8", views=P, sql=_DATA_SQL + _PAIRS_SQL + f"""
, ex AS ({edge_rows_sql('bitcoin', 'pairs', 10)}), ey AS ({edge_rows_sql('ether', 'pairs', 10)})
SELECT ex.bin AS bin_x, ey.bin AS bin_y, count(*) AS n
FROM pairs JOIN ex ON {in_bin_sql('pairs.bitcoin', 'ex')} JOIN ey ON {in_bin_sql('pairs.ether', 'ey')} GROUP BY ALL""")
def joint_bins(spark, d):
    # 2-D counts; joint_marginals has both marginals
    return charts.joint_bins(_data_cleaned(spark, d), "bitcoin", "ether", 10)


@query("ols_fit", covers="G9", views=P, sql=_DATA_SQL + """
SELECT round(regr_slope(ether, bitcoin), 9) AS slope, round(regr_intercept(ether, bitcoin), 9) AS intercept,
       round(regr_r2(ether, bitcoin), 9) AS r2, CAST(regr_count(ether, bitcoin) AS BIGINT) AS n FROM data_cleaned""")
def ols_fit(spark, d):
    # The line; regression_band has its band
    out = stats.least_squares(_data_cleaned(spark, d), "ether", "bitcoin")
    return out.select(*[_r(F.col(c), 9).alias(c) for c in ("slope", "intercept", "r2")], F.col("n").cast("bigint"))


@query("bfill_context", covers="W3 P10 C7", views=P, sql=f"""
, ctx AS (SELECT * FROM prices WHERE ts >= TIMESTAMP '{CONTEXT[0]}' AND ts < TIMESTAMP '{CONTEXT[1]}' + INTERVAL 1 DAY)
SELECT *, first_value(ether IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          AS ether_filled FROM ctx""")
def bfill_context(spark, d):
    # W3 on the slice alone: only values inside it can fill its gaps
    return clean.backfill(clean.date_slice(prices(spark, d), "ts", *CONTEXT), "ether", ORDER, out="ether_filled")


@query("hist_150_ether", covers="G2", views=P, sql=_DATA_SQL + hist_sql("data_cleaned", "ether", 150))
def hist_150_ether(spark, d):
    # G2 of the back-filled series
    return charts.histogram(_data_cleaned(spark, d), "ether", 150)


@query("joint_marginals", covers="G8 G2", views=P, sql=_DATA_SQL + _PAIRS_SQL + "".join(f"""
, e_{c} AS ({edge_rows_sql(c, 'pairs', 10)})""" for c in SERIES) + union_all(f"""
SELECT '{c}' AS column_name, bin, lo, hi, count(pairs.{c}) AS n
FROM e_{c} LEFT JOIN pairs ON {in_bin_sql(f'pairs.{c}', f'e_{c}')} GROUP BY ALL""" for c in SERIES))
def joint_marginals(spark, d):
    return charts.joint_marginals(_data_cleaned(spark, d), "bitcoin", "ether", 10)


@query("regression_band", covers="G9 R5", views=P, sql=_DATA_SQL + f"""
, pair AS (SELECT event_id AS k, bitcoin AS x, ether AS y FROM data_cleaned WHERE ether IS NOT NULL AND bitcoin IS NOT NULL),
{weights_sql('pair', 'x, y')},
sums AS (SELECT b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx,
                sum(w * x * y) / sum(w) AS xy FROM weighted GROUP BY b),
line AS (SELECT mx, my, (xy - mx * my) / (xx - mx * mx) AS slope FROM sums),
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(x) AS lo, max(x) AS hi FROM pair),
g AS (SELECT CAST(range AS INTEGER) AS grid_index, lo + range * ((hi - lo) / 99) AS x, a, b FROM range(100), s)
SELECT grid_index, round(x, 6) AS x, round(any_value(a + b * x), 6) AS fitted,
       round(quantile_cont(my + slope * (x - mx), 0.025), 6) AS lower, round(quantile_cont(my + slope * (x - mx), 0.975), 6) AS upper
FROM g, line GROUP BY grid_index, x""")
def regression_band(spark, d):
    out = resampling.regression_band(_data_cleaned(spark, d), "ether", "bitcoin", "event_id", replicates=REPLICATES, seed=SEED)
    return out.select("grid_index", *[_r(F.col(c)).alias(c) for c in ("x", "fitted", "lower", "upper")])


@query("ecdf_default", covers="G6", views=P, sql=_DATA_SQL + hist_sql(
    "btc_cleaned", "bitcoin", _default_bins_sql("btc_cleaned", "bitcoin"), cumulative=True, most=MOST_BINS))
def ecdf_default(spark, d):
    # cumulative histogram with the default bins
    btc = _bitcoin_cleaned(spark, d)
    return charts.ecdf(btc, "bitcoin", charts.fd_bins(btc, "bitcoin", MOST_BINS))


@query("cumulative_density", covers="G6 G4", views=P, sql=_DATA_SQL + f"""
, st AS (SELECT min(bitcoin) AS lo, max(bitcoin) AS hi,
                stddev_samp(bitcoin) * pow(CAST(count(bitcoin) AS DOUBLE), -0.2) AS bw FROM btc_cleaned),
pts AS (SELECT CAST(range AS INTEGER) AS grid_index, lo + range * ((hi - lo) / {KDE_GRID - 1}) AS x, bw
        FROM range({KDE_GRID}), st),
curve AS (SELECT grid_index, x, sum(exp(-0.5 * ((x - bitcoin) / bw) * ((x - bitcoin) / bw))) AS density
          FROM pts, btc_cleaned WHERE bitcoin IS NOT NULL GROUP BY grid_index, x)
SELECT grid_index, round(x, 9) AS x,
       round(sum(density) OVER (ORDER BY grid_index) / sum(density) OVER (), 9) AS cum_density
FROM curve""")
def cumulative_density(spark, d):
    # running sum of the density curve over its grid
    out = charts.cumulative_density(charts.kde(_bitcoin_cleaned(spark, d), "bitcoin", gridsize=KDE_GRID))
    return out.select("grid_index", _r(F.col("x"), 9).alias("x"), _r(F.col("cum_density"), 9).alias("cum_density"))
