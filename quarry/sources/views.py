"""Stand-in views: the reference's datasets expressed over the driver tables.

Each view is a lazy DataFrame; nothing is read until an action runs, and Catalyst prunes
the columns a query does not use down to the parquet scans.

Join strategy (``sales``): the two small, fixed-size TPC-H dimensions (``nation`` has 25
rows and ``region`` 5 at every scale factor) are broadcast explicitly. Every other join
is left to Spark: AQE broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a sort-merge join, so no
side that grows with the data is broadcast unchecked. Dimensions are joined into
``customer`` before it meets ``orders`` so the wide ``lineitem`` stream is shuffled only
for the two joins that need it (by order key, then by part key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from .tables import read_table

# Fixed values of the stand-in mapping (FIXTURES.md §2).
SHIPPED = "F"                       # o_orderstatus standing in for 'Shipped'
DEAL_SMALL_BELOW = 35000            # l_extendedprice bands for dealsize
DEAL_MEDIUM_BELOW = 70000
OTHER_BRAND = "Brand#1"             # p_brand shown as location 'Other'


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with order, customer, geography and product attributes."""
    l = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")

    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)          # 25 rows
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
    ords = o.join(cust, o.o_custkey == cust.c_custkey)
    lines = l.join(ords, l.l_orderkey == ords.o_orderkey).join(p, l.l_partkey == p.p_partkey)

    price = F.col("l_extendedprice")
    return lines.select(
        F.col("o_orderkey").alias("ordernumber"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("productcode"),
        price.cast("decimal(18,2)").alias("sales"),
        (price.cast("decimal(18,2)") * (1 - F.col("l_discount") - F.col("l_tax")).cast("decimal(9,4)")).alias("profit"),
        F.col("l_quantity").alias("qty"),
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").cast("int").alias("year_id"),
        F.month("o_orderdate").cast("int").alias("month_id"),
        F.col("o_orderdate").alias("orderdate"),
        F.col("p_type").alias("productline"),
        F.col("c_name").alias("customername"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("territory"),
        F.when(price < DEAL_SMALL_BELOW, "Small").when(price < DEAL_MEDIUM_BELOW, "Medium")
         .otherwise("Large").alias("dealsize"),
    )


def _location(user_id):
    return F.concat(F.when(user_id % 10 == 1, F.lit("United States ")).otherwise(F.lit("Land ")),
                    user_id.cast("string"))


def _covid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, day) with the three daily counts both covid views use.

    Both views derive from this aggregate. A query joining them reads ``events`` once per
    view, each time only with the columns that view needs.
    """
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    et = F.col("event_type")
    return (e.groupBy("user_id", F.col("ts").cast("date").alias("date"))
             .agg(F.sum(F.when(et.isin("view", "click", "signup"), 1).otherwise(0)).cast("bigint").alias("nc"),
                  F.sum(F.when(et == "error", 1).otherwise(0)).cast("bigint").alias("nd"),
                  F.sum(F.when(et == "purchase", 1).otherwise(0)).cast("bigint").alias("nv")))


def covid_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per location and day: population, new and total cases/deaths (counts as text)."""
    from pyspark.sql import Window
    d = _covid_daily(spark, sf_dir)
    uid = F.col("user_id")
    # Running totals per user over days: a partition holds one row per day, so its size
    # is bounded by the number of days whatever the number of events.
    w = Window.partitionBy("user_id").orderBy("date")
    return d.select(
        _location(uid).alias("location"),
        "date",
        F.when(uid % 25 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("C"), (uid % 6).cast("string"))).alias("continent"),
        (1000 + 10 * uid).cast("double").alias("population"),
        F.col("nc").cast("double").alias("new_cases"),
        F.col("nd").cast("string").alias("new_deaths"),
        F.sum("nc").over(w).cast("bigint").cast("string").alias("total_cases"),
        F.sum("nd").over(w).cast("bigint").cast("string").alias("total_deaths"),
    )


def covid_vaccinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per location and day: new vaccinations as text, NULL on days without any."""
    d = _covid_daily(spark, sf_dir)
    return d.select(
        _location(F.col("user_id")).alias("location"),
        "date",
        F.nullif(F.col("nv"), F.lit(0)).cast("string").alias("new_vaccinations"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two price series keyed by event: ``bitcoin`` complete, ``ether`` with gaps."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    day = F.dayofmonth("ts")
    ether = F.when(F.col("event_type").isin("view", "click") & ~day.between(7, 11), F.col("value"))
    out = e.select("event_id", "ts", F.col("value").alias("bitcoin"), ether.alias("ether"))
    return nan_to_null(out, ["bitcoin", "ether"])


def coasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coaster attributes; ``row_id`` is the row order, ``speed_mph`` has gaps."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                                   "p_retailprice")
    year = (1950 + F.col("p_size")).cast("int")
    out = p.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("coaster_name"),
        F.when(F.col("p_brand") == OTHER_BRAND, F.lit("Other")).otherwise(F.col("p_brand")).alias("location"),
        F.col("p_type").alias("type_main"),
        year.alias("year_introduced"),
        F.concat(year.cast("string"), F.lit("-01-15")).alias("opening_date"),
        F.when(F.col("p_size") < 50, F.col("p_retailprice")).alias("speed_mph"),
        F.col("p_size").cast("double").alias("height_ft"),
        (F.col("p_partkey") % 8).cast("int").alias("inversions"),
        ((F.col("p_partkey") % 50).cast("double") / 10).alias("gforce"),
    )
    return nan_to_null(out, ["speed_mph", "height_ft", "gforce"])


VIEWS = {
    "sales": sales,
    "covid_deaths": covid_deaths,
    "covid_vaccinations": covid_vaccinations,
    "prices": prices,
    "coasters": coasters,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose the views to ``spark.sql`` under their names (session temp views)."""
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
