"""Jobs the reference's README declares without source: rates, Box-Cox, bootstrap, models, I/O."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..functions.scalar import nan_to_null, to_number_lenient
from ..operators import dashboards, gram, models, resampling, stats
from ..operators.coaster import clean_coasters
from ..session import scratch_path
from ..sources import catalog, csv
from ..sources.tables import read_table
from ..sources.views import coasters, prices
from .registry import query
from .sqlgen import REPLICATES, SEED, union_all, weights_sql

RATE_DIMS = ["lang", "source"]
MODEL_FEATURES = ["height_ft", "inversions", "gforce", "year_introduced"]


@query("rate_by_attribute", covers="R2", sql="""
WITH j AS (SELECT d.lang, d.source, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
""" + union_all(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS dim_value, round(avg(CAST(toxic AS DOUBLE)), 9) "
                f"AS rate, count(*) AS n FROM j GROUP BY {c}" for c in RATE_DIMS))
def rate_by_attribute(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id", "toxic")
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source")   # text is never read
    out = dashboards.rate_by_attributes(labels.join(docs, "doc_id"), "toxic", RATE_DIMS)
    return out.withColumn("rate", F.round("rate", 9))


_LAMBDAS = stats.boxcox_grid()


@query("boxcox_lambda", covers="R6", sql=f"""
WITH x AS (SELECT value FROM events WHERE value > 0),
s AS (SELECT count(value) AS n, sum(ln(value)) AS sl FROM x),
g AS (SELECT CAST(round(-2 + range * 0.1, 10) AS DOUBLE) AS "lambda" FROM range({len(_LAMBDAS)}))
SELECT "lambda", round(-n / 2 * ln(var_pop(CASE WHEN "lambda" = 0 THEN ln(value)
                                               ELSE (pow(value, "lambda") - 1) / "lambda" END))
                       + ("lambda" - 1) * sl, 4) AS llf
FROM g, x, s GROUP BY "lambda", n, sl""")
def boxcox_lambda(spark, d):
    ev = read_table(spark, d, "events").select("value")
    return stats.boxcox_profile(ev, "value", _LAMBDAS).withColumn("llf", F.round("llf", 4))


PRICE_SCHEMA = StructType([
    StructField("event_id", LongType()),
    StructField("ts", TimestampNTZType()),
    StructField("bitcoin", DoubleType()),
    StructField("ether", DoubleType()),
])


@query("csv_roundtrip", covers="S1 X9", views=("prices",), sql="SELECT event_id, ts, bitcoin, ether FROM prices")
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "prices-csv")
    csv.write_csv(prices(spark, d), path)
    return csv.read_series_csv(spark, path, PRICE_SCHEMA, "ts")


def _interval_sql(statistic: str, estimate: str, value: str) -> str:
    return f"""SELECT '{statistic}' AS statistic, round({estimate}, 9) AS estimate,
       round(quantile_cont({value}, 0.025), 9) AS ci_low, round(quantile_cont({value}, 0.975), 9) AS ci_high,
       count(*) AS replicates FROM per_replicate"""


def _rounded(out):
    return out.withColumns({c: F.round(c, 9) for c in ("estimate", "ci_low", "ci_high")})


@query("bootstrap_ci", covers="R5", sql=f"""
WITH x AS (SELECT event_id AS k, value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
{weights_sql('x', 'v')},
per_replicate AS (SELECT b, sum(w * v) / sum(w) AS m FROM weighted GROUP BY b)
{_interval_sql('mean(value)', '(SELECT avg(v) FROM x)', 'm')}""")
def bootstrap_ci(spark, d):
    ev = nan_to_null(read_table(spark, d, "events").select("event_id", "value"), ["value"])
    return _rounded(resampling.bootstrap_ci(ev, "value", "event_id", REPLICATES, SEED, partitions=spark.sparkContext.defaultParallelism))


@query("model_comparison", covers="R4")
def model_comparison(spark, d):
    return models.model_comparison(coasters(spark, d), "speed_mph", MODEL_FEATURES, "row_id")


@query("linear_holdout", covers="R4", views=("coasters",), sql=f"""
, x AS (SELECT speed_mph AS y, height_ft AS x,
               CAST(CAST('0x' || substr(md5(concat_ws('|', row_id, {SEED})), 1, 13) AS BIGINT) AS DOUBLE)
                 / 4503599627370496 < 0.2 AS test
        FROM coasters WHERE speed_mph IS NOT NULL AND height_ft IS NOT NULL),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM x WHERE NOT test),
miss AS (SELECT y, y - (a + b * x) AS e, a, b, n FROM x, line WHERE test)
SELECT round(b, 6) AS slope, round(a, 6) AS intercept, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
       round(1 - avg(e * e) / var_pop(y), 6) AS r2, n AS n_train, count(*) AS n_test
FROM miss GROUP BY a, b, n""")
def linear_holdout(spark, d):
    out = models.linear_holdout(coasters(spark, d), "speed_mph", "height_ft", "row_id", seed=SEED)
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "rmse", "mae", "r2")})


_PAIR = ["height_ft", "gforce"]
_FAMILIES = ["mean", "least_squares", "ridge_0.1", "ridge_1", "principal_components_1", "partial_least_squares_1", "only_height_ft"]


@query("linear_families", covers="R4", views=("coasters",), sql=f"""
, x AS (SELECT CAST(speed_mph AS DOUBLE) AS y, CAST(height_ft AS DOUBLE) AS x1, CAST(gforce AS DOUBLE) AS x2,
               CAST(CAST('0x' || substr(md5(concat_ws('|', row_id, {SEED})), 1, 13) AS BIGINT) AS DOUBLE)
                 / 4503599627370496 < 0.2 AS test
        FROM coasters WHERE speed_mph IS NOT NULL AND height_ft IS NOT NULL AND gforce IS NOT NULL),
s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(y) AS sy, stddev_pop(x1) AS s1,
             stddev_pop(x2) AS s2, corr(x1, x2) AS r, corr(x1, y) AS c1, corr(x2, y) AS c2 FROM x WHERE NOT test),
b AS (
  SELECT 'mean' AS model, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM s
  UNION ALL SELECT name, ((1 + l) * c1 - r * c2) / ((1 + l) * (1 + l) - r * r), ((1 + l) * c2 - r * c1) / ((1 + l) * (1 + l) - r * r)
    FROM s, (VALUES ('least_squares', CAST(0 AS DOUBLE)), ('ridge_0.1', CAST(0.1 AS DOUBLE)), ('ridge_1', CAST(1 AS DOUBLE))) AS v(name, l)
  UNION ALL SELECT 'principal_components_1', (c1 + sign(r) * c2) / (2 * (1 + abs(r))), sign(r) * (c1 + sign(r) * c2) / (2 * (1 + abs(r))) FROM s
  UNION ALL SELECT 'partial_least_squares_1', c1 * (c1 * c1 + c2 * c2) / (c1 * c1 + c2 * c2 + 2 * r * c1 * c2),
                   c2 * (c1 * c1 + c2 * c2) / (c1 * c1 + c2 * c2 + 2 * r * c1 * c2) FROM s
  UNION ALL SELECT 'only_height_ft', c1, 0 FROM s),
miss AS (SELECT model, n, y, y - (my + b1 * sy / s1 * (x1 - m1) + b2 * sy / s2 * (x2 - m2)) AS e FROM b, s, x WHERE test)
SELECT model, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - avg(e * e) / var_pop(y), 6) AS r2,
       any_value(n) AS n_train, count(*) AS n_test
FROM miss GROUP BY model""")
def linear_families(spark, d):
    # families with a closed form for two features
    out = models.compare_families(coasters(spark, d), "speed_mph", _PAIR, "row_id", _FAMILIES, seed=SEED)
    return out.withColumns({c: F.round(c, 6) for c in ("rmse", "mae", "r2")})


@query("gamma_inference", covers="R7", views=("coasters",), sql="""
, x AS (SELECT speed_mph AS y FROM coasters WHERE speed_mph > 0 AND """ + " AND ".join(f"{f} IS NOT NULL" for f in MODEL_FEATURES) + """),
s AS (SELECT count(*) AS n, round(2 * count(*) * (ln(avg(y)) - avg(ln(y))), 6) AS null_deviance FROM x)
SELECT term, CAST(0 AS DOUBLE) AS score, n, null_deviance, true AS improves
FROM s, (VALUES ('intercept'), """ + ", ".join(f"('{f}')" for f in MODEL_FEATURES) + """) AS v(term)""")
def gamma_inference(spark, d):
    # the score equations hold at the fit (0 for every term), and the fit is better than the mean
    rows = models.positive_rows(coasters(spark, d), "speed_mph", MODEL_FEATURES)
    out = gram.gamma_inference(rows, "speed_mph", MODEL_FEATURES)
    return out.select("term", (F.round("score", 6) + 0.0).alias("score"), "n", F.round("null_deviance", 6).alias("null_deviance"),
                      (F.col("deviance") <= F.col("null_deviance")).alias("improves"))


@query("gamma_glm", covers="R7")
def gamma_glm(spark, d):
    return models.gamma_glm(coasters(spark, d), "speed_mph", MODEL_FEATURES, "row_id")


@query("gamma_glm_factor", covers="R7", views=("coasters",), sql="""
SELECT row_id, speed_mph, round(avg(speed_mph) OVER (PARTITION BY inversions), 4) AS prediction
FROM coasters WHERE speed_mph > 0""")
def gamma_glm_factor(spark, d):
    # one categorical factor: the fitted mean of a group is the group's mean
    levels = {f"is_{k}": (F.col("inversions") == k).cast("double") for k in range(1, 8)}
    out = models.gamma_glm(coasters(spark, d).withColumns(levels), "speed_mph", list(levels), "row_id")
    return out.withColumn("prediction", F.round("prediction", 4))


@query("bootstrap_corr", covers="R5", views=("coasters",), sql=f"""
, x AS (SELECT row_id AS k, speed_mph AS x, height_ft AS y FROM coasters
        WHERE speed_mph IS NOT NULL AND height_ft IS NOT NULL),
{weights_sql('x', 'x, y')},
sums AS (SELECT b, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx,
                sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM weighted GROUP BY b),
per_replicate AS (SELECT (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS r FROM sums)
{_interval_sql('corr(speed_mph,height_ft)', '(SELECT corr(x, y) FROM x)', 'r')}""")
def bootstrap_corr(spark, d):
    # correlation with a bootstrap interval: coaster speed vs height
    return _rounded(resampling.bootstrap_corr_ci(coasters(spark, d), "speed_mph", "height_ft", "row_id", REPLICATES, SEED,
                                                 partitions=spark.sparkContext.defaultParallelism))


@query("boxcox_apply", covers="R6", sql=f"""
WITH x AS (SELECT value FROM events WHERE value > 0),
g AS (SELECT CAST(round(-2 + range * 0.1, 10) AS DOUBLE) AS l FROM range({len(_LAMBDAS)})),
p AS (SELECT l, -count(*) / 2 * ln(var_pop(CASE WHEN l = 0 THEN ln(value) ELSE (pow(value, l) - 1) / l END))
                + (l - 1) * sum(ln(value)) AS llf FROM g, x GROUP BY l),
best AS (SELECT arg_max(l, llf) AS l FROM p)
SELECT event_id, l AS "lambda",
       round(CASE WHEN value > 0 THEN CASE WHEN l = 0 THEN ln(value) ELSE (pow(value, l) - 1) / l END END, 9) AS transformed
FROM events, best""")
def boxcox_apply(spark, d):
    # every value under the grid's most likely lambda
    ev = read_table(spark, d, "events").select("event_id", "value")
    best = stats.boxcox_best(stats.boxcox_profile(ev, "value", _LAMBDAS))
    out = ev.withColumn("lambda", best)
    return out.select("event_id", "lambda", F.round(stats.boxcox_transform(F.col("value"), F.col("lambda")), 9)
                      .alias("transformed"))


def _llf_sql(lam: str) -> str:
    """Profile log-likelihood of the values in ``x`` at ``lam``, as an aggregate expression."""
    return f"""(-count(*) / 2.0 * ln(var_pop(CASE WHEN {lam} = 0 THEN ln(value) ELSE (pow(value, {lam}) - 1) / {lam} END))
         + ({lam} - 1) * sum(ln(value)))"""


# the largest likelihood by thirds, then both interval ends by halves, each step over all values
@query("boxcox_fit", covers="R6", sql=f"""
WITH RECURSIVE x AS (SELECT value FROM events WHERE value > 0),
thirds AS (
  SELECT CAST(-4 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi, 0 AS step
  UNION ALL
  SELECT CASE WHEN l1 < l2 THEN m1 ELSE lo END, CASE WHEN l1 < l2 THEN hi ELSE m2 END, step + 1
  FROM (SELECT lo, hi, step, m1, m2, {_llf_sql("m1")} AS l1, {_llf_sql("m2")} AS l2
        FROM (SELECT lo, hi, step, lo + (hi - lo) / 3 AS m1, hi - (hi - lo) / 3 AS m2 FROM thirds WHERE step < 45) AS t, x
        GROUP BY lo, hi, step, m1, m2) AS u),
best AS (SELECT (lo + hi) / 2 AS lam FROM thirds WHERE step = 45),
top AS (SELECT lam, count(*) AS n, {_llf_sql("lam")} AS llf FROM best, x GROUP BY lam),
halves AS (
  SELECT side, lam AS inner_, lam + 4 * side AS outer_, llf, 0 AS step FROM top, (VALUES (-1), (1)) AS s(side)
  UNION ALL
  SELECT side, CASE WHEN l >= llf - 1.920729410347062 THEN mid ELSE inner_ END,
         CASE WHEN l >= llf - 1.920729410347062 THEN outer_ ELSE mid END, llf, step + 1
  FROM (SELECT side, inner_, outer_, llf, step, mid, {_llf_sql("mid")} AS l
        FROM (SELECT *, (inner_ + outer_) / 2 AS mid FROM halves WHERE step < 45) AS h, x
        GROUP BY side, inner_, outer_, llf, step, mid) AS v)
SELECT n, round(lam, 5) AS "lambda", round(llf, 4) AS llf,
       (SELECT round(inner_, 5) FROM halves WHERE step = 45 AND side = -1) AS ci_low,
       (SELECT round(inner_, 5) FROM halves WHERE step = 45 AND side = 1) AS ci_high
FROM top""")
def boxcox_fit(spark, d):
    fit = stats.boxcox_fit(read_table(spark, d, "events").select("value"), "value")
    return fit.withColumns({c: F.round(c, 4 if c == "llf" else 5) for c in ("lambda", "llf", "ci_low", "ci_high")})


@query("csv_inferred", covers="S1", views=("coasters",), sql="SELECT * FROM coasters")
def csv_inferred(spark, d):
    # column types guessed from the text; widened to the view's types, since a guess depends on the data
    table = coasters(spark, d)
    path = scratch_path(spark, "coasters-csv")
    csv.write_csv(table, path)
    read = csv.read_csv(spark, path, infer=True)
    return read.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])


_TYPED = ["row_id", "coaster_name", "speed_mph", "inversions", "gforce", "opening_date"]


@query("inferred_types", covers="S2", views=("coasters",), sql=", texts AS (SELECT " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c in _TYPED) + " FROM coasters)\n" + union_all(f"""
SELECT '{c}' AS column_name, CASE WHEN n_values = 0 THEN 'string' """ + " ".join(
    f"WHEN misfits_{t} = 0 THEN '{t}'" for t in csv.TYPE_PATTERNS) + f""" ELSE 'string' END AS inferred_type, *
FROM (SELECT count({c}) AS n_values, """ + ", ".join(
    f"count(*) FILTER (NOT regexp_matches({c}, '{p}')) AS misfits_{t}" for t, p in csv.TYPE_PATTERNS.items()) + f""" FROM texts) AS t
""" for c in _TYPED))
def inferred_types(spark, d):
    # written as CSV and read back as text, then one aggregate finds each column's type
    path = scratch_path(spark, "coasters-text")
    table = coasters(spark, d).select(*_TYPED)
    csv.write_csv(table, path)
    texts = StructType([StructField(c, StringType()) for c in _TYPED])
    return csv.infer_types(csv.read_csv(spark, path, texts))


@query("text_to_number", covers="X10", views=("coasters",), sql="""
SELECT row_id, CASE WHEN inversions <> 0 THEN gforce END AS number FROM coasters""")
def text_to_number(spark, d):
    # a text column that holds a name on some rows
    c = coasters(spark, d)
    text = F.when(F.col("inversions") == 0, F.col("coaster_name")).otherwise(F.col("gforce").cast("string"))
    return c.select("row_id", to_number_lenient(text).alias("number"))


@query("saved_extract", covers="R3 C16 S5 S8", views=("coasters",), sql="""
SELECT row_id, coaster_name AS Coaster_Name, location AS Location, CAST(opening_date AS DATE) AS Opening_Date,
       speed_mph AS Speed_MPH
FROM coasters WHERE row_id IN (SELECT min(row_id) FROM coasters GROUP BY coaster_name, location, opening_date)""")
def saved_extract(spark, d):
    # the cleaned coasters as a saved table for a dashboard
    renames = {"coaster_name": "Coaster_Name", "location": "Location", "opening_date": "Opening_Date",
               "speed_mph": "Speed_MPH"}
    name = catalog.unique_name("coaster_extract")
    catalog.drop_if_exists(spark, name)
    catalog.select_into(clean_coasters(coasters(spark, d), renames), name)
    return catalog.read_back(spark, name)
