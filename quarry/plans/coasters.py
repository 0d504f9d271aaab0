"""Roller-coaster analyses over the ``coasters`` view: cleaning, dedup, distributions, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, dq, explore, stats
from ..sources import catalog, stored
from ..sources.views import coasters
from .registry import query
from .sqlgen import edge_rows_sql, hist_sql, in_bin_sql, union_all

C = ("coasters",)
ALL_BUT_KEY = ["coaster_name", "location", "type_main", "year_introduced", "opening_date", "speed_mph",
               "height_ft", "inversions", "gforce"]
DEDUP_SUBSET = ["coaster_name", "location", "opening_date"]
NUMERIC = ["year_introduced", "speed_mph", "height_ft", "inversions", "gforce"]
CORR_VARS = ["year_introduced", "speed_mph", "height_ft", "inversions", "gforce"]
BOX_VARS = ["speed_mph", "height_ft"]
OUTLIER_REACH = 0.4                          # whisker length of box_outliers, in IQRs
NAME_LOOKED_UP = "blue rod"
# The reference's column renames, mapped onto the stand-in column names.
RENAMES = {
    "coaster_name": "Coaster_Name",
    "location": "Location",
    "type_main": "Type_Main",
    "year_introduced": "Year_Introduced",
    "opening_date": "Opening_Date",
    "speed_mph": "Speed_MPH",
    "height_ft": "Height_ft",
    "inversions": "Inversions",
    "gforce": "Gforce",
}


def _r(c, n=6):
    return F.round(c, n)


def _deduped(spark, d):
    """The coasters after the notebook's dedup step; every feature analysis reads these."""
    return dq.drop_duplicates_keep_first(coasters(spark, d), "row_id", DEDUP_SUBSET)


_DEDUP_SQL = f""", cd AS (SELECT * FROM coasters WHERE row_id IN (SELECT min(row_id) FROM coasters
                                                   GROUP BY {', '.join(DEDUP_SUBSET)}))
"""


@query("dup_all", covers="I10 W4", views=C, sql=f"""
SELECT * FROM coasters WHERE row_id NOT IN (SELECT min(row_id) FROM coasters GROUP BY {', '.join(ALL_BUT_KEY)})""")
def dup_all(spark, d):
    return dq.duplicated_rows(coasters(spark, d), "row_id")


@query("dup_subset", covers="I11 W4", views=C, sql="""
SELECT * FROM coasters WHERE row_id NOT IN (SELECT min(row_id) FROM coasters GROUP BY coaster_name)""")
def dup_subset(spark, d):
    return dq.duplicated_rows(coasters(spark, d), "row_id", ["coaster_name"])


@query("dedup_keep_first", covers="P14 W4", views=C, sql=f"""
SELECT * FROM coasters WHERE row_id IN (SELECT min(row_id) FROM coasters GROUP BY {', '.join(DEDUP_SUBSET)})""")
def dedup_keep_first(spark, d):
    return dq.drop_duplicates_keep_first(coasters(spark, d), "row_id", DEDUP_SUBSET)


@query("rename_drop", covers="P3 P4", views=C, sql="SELECT row_id, " + ", ".join(
    f"{a} AS {b}" for a, b in RENAMES.items() if a != "coaster_name") + " FROM coasters")
def rename_drop(spark, d):
    return coasters(spark, d).drop("coaster_name").withColumnsRenamed(RENAMES)


_CLEAN_SQL = """cleaned AS (SELECT row_id, coaster_name AS Coaster_Name, location AS Location, type_main AS Type_Main,
       year_introduced AS Year_Introduced, CAST(opening_date AS DATE) AS Opening_Date, speed_mph AS Speed_MPH,
       height_ft AS Height_ft, inversions AS Inversions, gforce AS Gforce FROM coasters)"""


@query("coaster_clean", covers="C16 R3 X9 P1 P3 P14", views=C, sql=f""", {_CLEAN_SQL}
SELECT * FROM cleaned WHERE row_id IN (SELECT min(row_id) FROM cleaned GROUP BY Coaster_Name, Location, Opening_Date)""")
def coaster_clean(spark, d):
    from ..operators.coaster import clean_coasters
    return clean_coasters(coasters(spark, d), RENAMES)


@query("describe_numeric", covers="I4", views=C, sql=_DEDUP_SQL + union_all(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM cd" for c in NUMERIC))
def describe_numeric(spark, d):
    out = dq.describe_numeric_stats(_deduped(spark, d), NUMERIC)
    return out.select("column_name", "count", *[_r(F.col(c)).alias(c) for c in ("mean", "std")], "min",
                      *[_r(F.col(c)).alias(c) for c in ("p25", "p50", "p75")], "max")


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in CORR_VARS)


@query("corr_matrix", covers="A18 P19 G14", views=C, sql=_DEDUP_SQL + f""", cc AS (SELECT * FROM cd WHERE {_COMPLETE})
""" + union_all(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}), 9) AS corr FROM cc"
                for a in CORR_VARS for b in CORR_VARS))
def corr_matrix(spark, d):
    return stats.corr_matrix(_deduped(spark, d), CORR_VARS).withColumn("corr", _r(F.col("corr"), 9))


@query("value_counts_top10", covers="A16 O6 G13", views=C, sql=_DEDUP_SQL + """
SELECT year_introduced, count(*) AS n FROM cd WHERE year_introduced IS NOT NULL GROUP BY year_introduced
ORDER BY n DESC, year_introduced LIMIT 10""")
def value_counts_top10(spark, d):
    return explore.value_counts(_deduped(spark, d), "year_introduced", top=10)


@query("fastest_locations", covers="A15 P7 P18 O4 C17 G13", views=C, sql=_DEDUP_SQL + """
SELECT location, round(avg(speed_mph), 6) AS mean, count(speed_mph) AS count FROM cd WHERE location <> 'Other'
GROUP BY location HAVING count(speed_mph) >= 10 ORDER BY mean DESC""")
def fastest_locations(spark, d):
    out = explore.ranked_group_means(_deduped(spark, d), "location", "speed_mph", min_count=10, exclude="Other")
    return out.withColumn("mean", _r(F.col("mean")))


@query("hist_30", covers="G2", views=C, sql=_DEDUP_SQL + hist_sql("cd", "speed_mph", 30))
def hist_30(spark, d):
    return charts.histogram(_deduped(spark, d), "speed_mph", 30)


SPEED_KDE_GRID = 1000


@query("kde_speed", covers="G4", views=C, sql=_DEDUP_SQL + f"""
, st AS (SELECT min(speed_mph) AS mn, max(speed_mph) AS mx, count(speed_mph) AS n,
               stddev_samp(speed_mph) * pow(CAST(count(speed_mph) AS DOUBLE), -0.2) AS bw FROM cd),
st2 AS (SELECT mn - 0.5 * (mx - mn) AS lo, mx + 0.5 * (mx - mn) AS hi, n, bw FROM st),
vals AS (SELECT speed_mph AS v, count(*) AS c FROM cd WHERE speed_mph IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS grid_index FROM range({SPEED_KDE_GRID})),
pts AS (SELECT grid_index, lo + grid_index * ((hi - lo) / {SPEED_KDE_GRID - 1}) AS x, n, bw, v, c FROM g, st2, vals)
SELECT grid_index, round(x, 9) AS x,
       round(sum(c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM pts GROUP BY grid_index, x, n, bw""")
def kde_speed(spark, d):
    # 1000 points, half a range beyond both ends
    out = charts.kde(_deduped(spark, d), "speed_mph", gridsize=SPEED_KDE_GRID, pad_range=0.5)
    return out.select("grid_index", _r(F.col("x"), 9).alias("x"), _r(F.col("density"), 12).alias("density"))


def _scatter_sql(hue: str | None, k: int = 10):
    hue_col = f"{hue} AS hue, " if hue else ""
    return _DEDUP_SQL + f""", pairs AS (SELECT {hue_col}CAST(speed_mph AS DOUBLE) AS x, CAST(height_ft AS DOUBLE) AS y FROM cd
                WHERE speed_mph IS NOT NULL AND height_ft IS NOT NULL),
ex AS ({edge_rows_sql('x', 'pairs', k)}), ey AS ({edge_rows_sql('y', 'pairs', k)})
SELECT {'pairs.hue, ' if hue else ''}ex.bin AS bin_x, ey.bin AS bin_y, count(*) AS n
FROM pairs JOIN ex ON {in_bin_sql('pairs.x', 'ex')} JOIN ey ON {in_bin_sql('pairs.y', 'ey')} GROUP BY ALL"""


@query("scatter_bins", covers="G10", views=C, sql=_scatter_sql(None))
def scatter_bins(spark, d):
    # Speed against height, binned
    return charts.joint_bins(_deduped(spark, d), "speed_mph", "height_ft", 10)


@query("scatter_hue", covers="G10", views=C, sql=_scatter_sql("year_introduced"))
def scatter_hue(spark, d):
    # G10 with a colour per year, binned per year
    out = charts.joint_bins(_deduped(spark, d), "speed_mph", "height_ft", 10, hue="year_introduced")
    return out.withColumnRenamed("year_introduced", "hue")


def _pair_sql(k: int = 10):
    values = union_all(f"SELECT row_id, type_main AS hue, '{c}' AS var, CAST({c} AS DOUBLE) AS v FROM cd "
                       f"WHERE {c} IS NOT NULL" for c in CORR_VARS)
    edges = union_all(f"SELECT '{c}' AS var, * FROM ({edge_rows_sql(c, 'wide', k)})" for c in CORR_VARS)
    return _DEDUP_SQL + f""", wide AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CORR_VARS)} FROM cd),
vals AS ({values}),
edge AS ({edges}),
placed AS (SELECT row_id, hue, vals.var, bin FROM vals JOIN edge ON vals.var = edge.var AND {in_bin_sql('v', 'edge')})
SELECT a.var AS var_x, c.var AS var_y, a.hue, a.bin AS bin_x, c.bin AS bin_y, count(*) AS n
FROM placed a JOIN placed c ON a.row_id = c.row_id GROUP BY ALL"""


@query("pair_grid", covers="G11", views=C, sql=_pair_sql())
def pair_grid(spark, d):
    return charts.pair_grid(_deduped(spark, d), CORR_VARS, "type_main", 10)


GROUP_GRID = 50


@query("pair_densities", covers="G11 G4", views=C, sql=_DEDUP_SQL + ", vals AS (" + union_all(
    f"SELECT '{c}' AS column_name, type_main, CAST({c} AS DOUBLE) AS v FROM cd WHERE {c} IS NOT NULL AND type_main IS NOT NULL"
    for c in CORR_VARS) + f"""),
counted AS (SELECT column_name, type_main, v, count(*) AS c FROM vals GROUP BY ALL),
st AS (SELECT column_name, type_main, min(v) AS lo, max(v) AS hi, count(*) AS n,
              count(*) / sum(count(*)) OVER (PARTITION BY column_name) AS share,
              stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw FROM vals GROUP BY column_name, type_main),
pts AS (SELECT column_name, type_main, CAST(range AS INTEGER) AS grid_index, n, share, bw,
               lo - 3 * bw + range * ((hi - lo + 6 * bw) / {GROUP_GRID - 1}) AS x
        FROM st, range({GROUP_GRID}) WHERE hi > lo)
SELECT p.column_name, p.type_main, grid_index, round(x, 9) AS x,
       round(share * sum(c * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (n * bw * sqrt(2 * pi())), 10) AS density
FROM pts p JOIN counted USING (column_name, type_main)
GROUP BY p.column_name, p.type_main, grid_index, x, n, share, bw""")
def pair_densities(spark, d):
    # the diagonal of the pair grid: one curve per variable and coaster type
    long = stats.long_values(_deduped(spark, d), CORR_VARS, ["type_main"])
    out = charts.group_density(long, "value", ["column_name"], "type_main", gridsize=GROUP_GRID)
    return out.withColumns({"x": _r(F.col("x"), 9), "density": _r(F.col("density"), 10)})


@query("box_stats", covers="G12 A13 A14", views=C, sql=_DEDUP_SQL + """, q AS (""" + union_all(
    f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, "
    f"quantile_cont({c}, 0.75) AS q3 FROM cd" for c in BOX_VARS) + """),
long AS (""" + union_all(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM cd WHERE {c} IS NOT NULL"
                         for c in BOX_VARS) + """)
SELECT q.column_name, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM long JOIN q ON long.column_name = q.column_name GROUP BY q.column_name, q1, median, q3""")
def box_stats(spark, d):
    out = charts.box_stats(_deduped(spark, d), BOX_VARS)
    return out.select("column_name", *[_r(F.col(c)).alias(c) for c in ("q1", "median", "q3", "iqr")],
                      "whisker_low", "whisker_high", "n_outliers")


@query("preview_head5", covers="I2", views=C, sql="SELECT * FROM coasters ORDER BY row_id LIMIT 5")
def preview_head5(spark, d):
    # The first rows by row key
    return coasters(spark, d).orderBy("row_id").limit(5)


@query("coaster_shape", covers="I1 C16", views=C, sql=_DEDUP_SQL + """
SELECT 'raw' AS stage, count(*) AS n_rows, 10 AS n_cols FROM coasters
UNION ALL
SELECT 'deduplicated' AS stage, count(*) AS n_rows, 10 AS n_cols FROM cd""")
def coaster_shape(spark, d):
    # I1 before and after the dedup step
    raw = dq.shape(coasters(spark, d)).select(F.lit("raw").alias("stage"), "n_rows", "n_cols")
    ded = dq.shape(_deduped(spark, d)).select(F.lit("deduplicated").alias("stage"), "n_rows", "n_cols")
    return raw.unionByName(ded)


@query("year_value_counts", covers="A16", views=C, sql=_DEDUP_SQL + """
SELECT year_introduced, count(*) AS n FROM cd WHERE year_introduced IS NOT NULL GROUP BY year_introduced""")
def year_value_counts(spark, d):
    # Every value, most frequent first
    return explore.value_counts(_deduped(spark, d), "year_introduced")


@query("box_outliers", covers="G12", views=C, sql=_DEDUP_SQL + """, v AS (""" + union_all(
    f"SELECT '{c}' AS column_name, row_id, CAST({c} AS DOUBLE) AS value, quantile_cont({c}, 0.25) OVER () AS q1, "
    f"quantile_cont({c}, 0.75) OVER () AS q3 FROM cd WHERE {c} IS NOT NULL" for c in BOX_VARS) + f""")
SELECT column_name, row_id, value FROM v WHERE value < q1 - {OUTLIER_REACH} * (q3 - q1) OR value > q3 + {OUTLIER_REACH} * (q3 - q1)""")
def box_outliers(spark, d):
    # the given table holds no value 1.5 IQR out, so the registered query draws shorter whiskers
    return charts.box_outliers(_deduped(spark, d), BOX_VARS, "row_id", whis=OUTLIER_REACH)


@query("coaster_null_audit", covers="I6 C16", views=C, sql=union_all(
    f"SELECT '{b}' AS column_name, count(*) FILTER (WHERE {a} IS NULL) AS n_null FROM coasters" for a, b in RENAMES.items()))
def coaster_null_audit(spark, d):
    # missing values per renamed column, before the duplicates go
    return dq.null_counts(coasters(spark, d).withColumnsRenamed(RENAMES), list(RENAMES.values()))


@query("load_audit", covers="I1 I5 I6 I10 C16", views=C, sql=f""", {_CLEAN_SQL},
kept AS (SELECT * FROM cleaned WHERE row_id IN (SELECT min(row_id) FROM cleaned GROUP BY Coaster_Name, Location, Opening_Date))
SELECT CAST(NULL AS VARCHAR) AS column_name, 'rows' AS measure, count(*) AS n FROM kept
UNION ALL SELECT NULL, 'no inversions', count(*) FILTER (WHERE Inversions = 0) FROM kept
UNION ALL SELECT NULL, 'stored rows', count(*) FROM kept
""" + "".join(f"UNION ALL SELECT '{c}', 'nulls', count(*) FILTER (WHERE {c} IS NULL) FROM kept\n"
              for c in ["row_id", *RENAMES.values()]))
def load_audit(spark, d):
    # the cleaned coasters are written and audited by one scan; the stored table is counted beside
    from ..operators.coaster import clean_coasters
    clean = clean_coasters(coasters(spark, d), RENAMES)
    table, audit = stored.store_audited(clean, catalog.unique_name("coasters_clean"), {"no inversions": F.col("Inversions") == 0})
    counted = table.agg(F.lit(None).cast("string").alias("column_name"), F.lit("stored rows").alias("measure"),
                        F.count(F.lit(1)).alias("n"))
    return audit.unionByName(counted)


@query("coaster_by_name", covers="P5 C16", views=C, sql=f"""
SELECT * FROM coasters WHERE coaster_name = '{NAME_LOOKED_UP}'""")
def coaster_by_name(spark, d):
    # every row of one repeated name, to see how its rows differ
    return coasters(spark, d).where(F.col("coaster_name") == NAME_LOOKED_UP)


@query("dup_projection", covers="I10 W4", views=C, sql="""
SELECT row_id, location, inversions FROM coasters
WHERE row_id NOT IN (SELECT min(row_id) FROM coasters GROUP BY location, inversions)""")
def dup_projection(spark, d):
    # repeats over all columns of a projection that has some
    return dq.duplicated_rows(coasters(spark, d).select("row_id", "location", "inversions"), "row_id")


def _location_means(spark, d):
    out = explore.ranked_group_means(_deduped(spark, d), "location", "speed_mph", exclude="Other", ascending=True)
    return out.withColumn("mean", _r(F.col("mean")))


_MEANS_SQL = _DEDUP_SQL + """
SELECT location, round(avg(speed_mph), 6) AS mean{extra} FROM cd WHERE location <> 'Other'
GROUP BY location HAVING count(speed_mph) >= 10 ORDER BY mean, location"""


@query("slowest_locations", covers="A15 G13", views=C, sql=_MEANS_SQL.format(extra=", count(speed_mph) AS count"))
def slowest_locations(spark, d):
    return _location_means(spark, d)


@query("location_means", covers="A15 G13", views=C, sql=_MEANS_SQL.format(extra=""))
def location_means(spark, d):
    # the means alone
    return _location_means(spark, d).drop("count")
