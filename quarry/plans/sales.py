"""Car-sales analyses over the ``sales`` view: exploration, RFM, products sold together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import day_diff
from ..operators import basket, explore, rfm
from ..operators.rank import ntile
from ..sources import catalog
from ..sources.views import SHIPPED, sales
from .registry import query
from .sqlgen import union_all

# Parameters of the registered queries (the reference hard-codes its year/month the same way).
LAST_YEAR = " 2001"          # text with a leading blank, compared as a number
YEAR = " 1998"
MONTH = "11"
BASKET_LINES = 2

S = ("sales",)


@query("preview_top20", covers="I2 P2", views=S, sql="""
SELECT ordernumber, line_no, productcode, CAST(sales AS DOUBLE) AS sales, status, orderdate,
       productline, customername, dealsize
FROM sales ORDER BY ordernumber, line_no, productcode, sales LIMIT 20""")
def preview_top20(spark, d):
    s = sales(spark, d)
    return (s.select("ordernumber", "line_no", "productcode", F.col("sales").cast("double").alias("sales"), "status",
                     "orderdate", "productline", "customername", "dealsize")
             .orderBy("ordernumber", "line_no", "productcode", "sales").limit(20))


@query("shape", covers="I1", views=S, sql="SELECT count(*) AS n_rows, 16 AS n_cols FROM sales")
def shape(spark, d):
    from ..operators.dq import shape as shape_of
    return shape_of(sales(spark, d))


_DISTINCT_COLS = ["status", "year_id", "productline", "country", "dealsize", "territory"]


@query("distinct_values", covers="I8", views=S, sql="\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM sales" for c in _DISTINCT_COLS))
def distinct_values(spark, d):
    return explore.distinct_values(sales(spark, d), _DISTINCT_COLS)


@query("months_in_year", covers="I9 P6", views=S, sql=f"""
SELECT DISTINCT month_id FROM sales WHERE year_id = CAST(trim('{LAST_YEAR}') AS INTEGER) ORDER BY month_id""")
def months_in_year(spark, d):
    return explore.distinct_where(sales(spark, d), "month_id", explore.period_filter(LAST_YEAR)).orderBy("month_id")


def _revenue_sql(dim):
    return f"SELECT {dim}, CAST(sum(sales) AS DOUBLE) AS revenue FROM sales GROUP BY {dim} ORDER BY revenue DESC"


@query("revenue_by_line", covers="A1 O3", views=S, sql=_revenue_sql("productline"))
def revenue_by_line(spark, d):
    return explore.revenue_by(sales(spark, d), "productline")


@query("revenue_by_year", covers="A1 O3", views=S, sql=_revenue_sql("year_id"))
def revenue_by_year(spark, d):
    return explore.revenue_by(sales(spark, d), "year_id")


@query("revenue_by_deal", covers="A1 O3", views=S, sql=_revenue_sql("dealsize"))
def revenue_by_deal(spark, d):
    return explore.revenue_by(sales(spark, d), "dealsize")


@query("month_revenue", covers="A2 P5 C15", views=S, sql=f"""
SELECT month_id, CAST(sum(sales) AS DOUBLE) AS revenue, count(ordernumber) AS frequency
FROM sales WHERE year_id = CAST(trim('{YEAR}') AS INTEGER) GROUP BY month_id ORDER BY revenue DESC""")
def month_revenue(spark, d):
    return explore.revenue_in_period(sales(spark, d), YEAR)


@query("line_revenue_in_month", covers="A3 P5 C15", views=S, sql=f"""
SELECT productline, CAST(sum(sales) AS DOUBLE) AS revenue, count(ordernumber) AS frequency
FROM sales WHERE year_id = CAST(trim('{YEAR}') AS INTEGER) AND month_id = CAST(trim('{MONTH}') AS INTEGER)
GROUP BY month_id, productline ORDER BY revenue DESC""")
def line_revenue_in_month(spark, d):
    return explore.revenue_in_period(sales(spark, d), YEAR, MONTH, by="productline")


_RFM_BASE_SQL = """
SELECT customername, CAST(sum(sales) AS DOUBLE) AS monetary_value,
       CAST(sum(sales) AS DOUBLE) / count(sales) AS avg_monetary_value,
       count(ordernumber) AS frequency, max(orderdate) AS last_order_date,
       max(max(orderdate)) OVER () AS max_order_date,
       CAST(date_diff('day', CAST(max(orderdate) AS DATE), CAST(max(max(orderdate)) OVER () AS DATE)) AS INTEGER)
         AS recency
FROM sales GROUP BY customername"""


def _tile_sql(measure):
    return f"CAST(ntile(4) OVER (ORDER BY {measure}, customername) AS INTEGER)"


_RFM_SCORES_SQL = f"""
scored_customers AS (
  SELECT *, {_tile_sql('recency')} AS rfm_recency, {_tile_sql('frequency')} AS rfm_frequency,
         {_tile_sql('monetary_value')} AS rfm_monetary,
         rfm_recency + rfm_frequency + rfm_monetary AS rfm_cell,
         rfm_recency || '' || rfm_frequency || '' || rfm_monetary AS rfm_cell_string
  FROM ({_RFM_BASE_SQL}) AS customers)"""


def _rfm_sql(body):
    # Appends the RFM CTEs after the sales view CTE.
    return f", {_RFM_SCORES_SQL.strip()}\n{body}"


def _segment_case():
    whens = " ".join(f"WHEN rfm_cell_string IN ({', '.join(repr(c) for c in codes)}) THEN '{label}'"
                     for label, codes in rfm.SEGMENT_CODES.items())
    return f"CASE {whens} END"


def _scores(spark, d):
    return rfm.rfm_scores(rfm.rfm_base(sales(spark, d)))


@query("rfm_base", covers="A4 J3 X8", views=S, sql=_RFM_BASE_SQL)
def rfm_base(spark, d):
    return rfm.rfm_base(sales(spark, d))


@query("rfm_scores", covers="C1 W2 X4 X5 X7", views=S, sql=_rfm_sql("SELECT * FROM scored_customers"))
def rfm_scores(spark, d):
    return _scores(spark, d)


@query("rfm_cells", covers="C1", views=S, sql=_rfm_sql(
    "SELECT rfm_cell_string, count(*) AS n_customers FROM scored_customers GROUP BY rfm_cell_string"))
def rfm_cells(spark, d):
    return (_scores(spark, d).groupBy("rfm_cell_string").agg(F.count(F.lit(1)).alias("n_customers"))
            .orderBy(F.desc("n_customers"), "rfm_cell_string"))


@query("rfm_segments", covers="C2 P15 P16", views=S, sql=_rfm_sql(
    f"SELECT customername, rfm_recency, rfm_frequency, rfm_monetary, {_segment_case()} AS rfm_segment FROM scored_customers"))
def rfm_segments(spark, d):
    return rfm.rfm_segments(_scores(spark, d))


@query("case_segments", covers="P15 P16 C2", views=S, sql=_rfm_sql(
    f"SELECT {_segment_case()} AS rfm_segment, count(*) AS n_customers FROM scored_customers GROUP BY 1"))
def case_segments(spark, d):
    seg = rfm.rfm_segments(_scores(spark, d))
    return seg.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("n_customers")).orderBy(F.desc("n_customers"))


@query("select_into_view", covers="S5 S7 S8 S6", views=S, sql=_rfm_sql("SELECT * FROM scored_customers"))
def select_into_view(spark, d):
    # Written once to the shared folder, read back by name
    name = catalog.unique_name("customer_scores")
    catalog.drop_if_exists(spark, name)
    catalog.select_into(_scores(spark, d), name)
    return catalog.read_back(spark, name)


@query("ntile_scaled", covers="W2", views=S, sql="""
SELECT ordernumber, line_no, productcode, CAST(sales AS DOUBLE) AS sales,
       CAST(ntile(4) OVER (ORDER BY sales, ordernumber, line_no, productcode) AS INTEGER) AS sales_quartile
FROM sales""")
def ntile_scaled(spark, d):
    s = sales(spark, d).select("ordernumber", "line_no", "productcode", "sales")
    out = ntile(s, 4, ["sales", "ordernumber", "line_no", "productcode"], "sales_quartile")
    return out.withColumn("sales", F.col("sales").cast("double"))


@query("scalar_subquery_max_date", covers="J3 X8", views=S, sql="""
SELECT ordernumber, max(orderdate) AS order_date, (SELECT max(orderdate) FROM sales) AS max_order_date,
       CAST(date_diff('day', CAST(max(orderdate) AS DATE), CAST((SELECT max(orderdate) FROM sales) AS DATE)) AS INTEGER)
         AS days_before_max
FROM sales GROUP BY ordernumber""")
def scalar_subquery_max_date(spark, d):
    per_order = sales(spark, d).groupBy("ordernumber").agg(F.max("orderdate").alias("order_date"))
    last = per_order.select(F.max("order_date")).scalar()      # max of maxima: reuses the aggregate
    return per_order.select("ordernumber", "order_date", last.alias("max_order_date"),
                            day_diff(F.col("order_date"), last).alias("days_before_max"))


@query("semi_two_line_orders", covers="J5 P17 A8", views=S, sql=f"""
SELECT ordernumber, line_no, productcode, status FROM sales
WHERE ordernumber IN (SELECT ordernumber FROM sales GROUP BY ordernumber
                      HAVING count(*) FILTER (WHERE status = 'F') = {BASKET_LINES})""")
def semi_two_line_orders(spark, d):
    s = sales(spark, d).select("ordernumber", "line_no", "productcode", "status")
    return basket.lines_of_n_line_orders(s, BASKET_LINES)


_CODE_LIST_SQL = f"""
lists AS (
  SELECT ordernumber, string_agg(CAST(productcode AS VARCHAR), ',' ORDER BY productcode) AS product_codes
  FROM sales WHERE ordernumber IN (SELECT ordernumber FROM sales WHERE status = 'F' GROUP BY ordernumber
                                   HAVING count(*) = {BASKET_LINES})
  GROUP BY ordernumber),
code_lists AS (
  SELECT o.ordernumber, l.product_codes FROM (SELECT DISTINCT ordernumber FROM sales) o
  LEFT JOIN lists l ON o.ordernumber = l.ordernumber)"""


@query("order_code_list", covers="J6 A9 A17 X5 X6 O5 C13", views=S,
       sql=f", {_CODE_LIST_SQL.strip()}\nSELECT * FROM code_lists ORDER BY product_codes DESC NULLS LAST")
def order_code_list(spark, d):
    return basket.order_code_lists(sales(spark, d), BASKET_LINES)


@query("pair_frequency", covers="C14", views=S, sql=f""", {_CODE_LIST_SQL.strip()}
SELECT product_codes, count(ordernumber) AS n_orders FROM code_lists WHERE product_codes IS NOT NULL
GROUP BY product_codes""")
def pair_frequency(spark, d):
    return basket.code_set_frequency(basket.order_code_lists(sales(spark, d), BASKET_LINES))


_SETS_SQL = """SELECT * FROM (WITH RECURSIVE held AS (SELECT DISTINCT ordernumber, productcode AS c FROM sales),
sets AS (
  SELECT ordernumber, c, [c] AS codes FROM held
  UNION ALL SELECT s.ordernumber, h.c, list_append(s.codes, h.c) FROM sets s JOIN held h ON h.ordernumber = s.ordernumber AND h.c > s.c),
often AS (SELECT codes, count(*) AS n FROM sets GROUP BY codes HAVING count(*) >= 2),
total AS (SELECT count(DISTINCT ordernumber) AS orders FROM held)
"""


@query("recurring_sets", covers="C14", views=S, sql=_SETS_SQL + """
SELECT array_to_string(codes, ',') AS product_codes, CAST(len(codes) AS INTEGER) AS n_codes, n AS n_orders, round(n / orders, 9) AS support
FROM often, total WHERE len(codes) > 1) AS found""")
def recurring_sets(spark, d):
    # sets of any size, found rather than read off a list
    out = basket.recurring_sets(sales(spark, d).select("ordernumber", "productcode"))
    return out.withColumn("support", F.round("support", 9))


@query("product_rules", covers="C14", views=S, sql=_SETS_SQL + """
, rule AS (SELECT codes, n, unnest(codes) AS consequent FROM often WHERE len(codes) > 1)
SELECT array_to_string(list_filter(rule.codes, lambda x: x <> consequent), ',') AS antecedent, consequent,
       round(rule.n / a.n, 9) AS confidence, round(CAST(rule.n AS DOUBLE) / a.n / (CAST(c.n AS DOUBLE) / orders), 6) AS lift,
       round(rule.n / orders, 9) AS support
FROM rule JOIN often a ON a.codes = list_filter(rule.codes, lambda x: x <> consequent) JOIN often c ON c.codes = [consequent], total) AS found""")
def product_rules(spark, d):
    out = basket.product_rules(sales(spark, d).select("ordernumber", "productcode"))
    return out.withColumns({"confidence": F.round("confidence", 9), "lift": F.round("lift", 6), "support": F.round("support", 9)})


_DASH_DIMS = ["productline", "country", "month_id", "segment", "territory"]


@query("dashboard_sales", covers="R1 R3", views=S, sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS dim_value, CAST(sum(sales) AS DOUBLE) AS total_sales, "
    f"CAST(sum(profit) AS DOUBLE) AS total_profit, sum(qty) AS total_qty, count(*) AS n_lines FROM sales GROUP BY {c}" for c in _DASH_DIMS))
def dashboard_sales(spark, d):
    from ..operators.dashboards import totals_by_dimensions
    return totals_by_dimensions(sales(spark, d), _DASH_DIMS,
                                {"total_sales": ("sales", "double"), "total_profit": ("profit", "double"),
                                 "total_qty": ("qty", None)})


@query("lines_per_order", covers="A8 P5", views=S, sql="""
SELECT ordernumber, count(*) AS n_lines FROM sales WHERE status = 'F' GROUP BY ordernumber""")
def lines_per_order(spark, d):
    return explore.lines_per_key(sales(spark, d), "ordernumber", F.col("status") == SHIPPED)


def _summary_dims():
    y, m = int(YEAR.strip()), int(MONTH.strip())
    in_year = explore.period_filter(YEAR)
    in_month = explore.period_filter(YEAR, MONTH)
    return {
        "product_line": F.col("productline"),
        "year": F.col("year_id"),
        "deal_size": F.col("dealsize"),
        f"month_of_{y}": F.when(in_year, F.col("month_id")),
        f"product_line_in_{y}_{m:02d}": F.when(in_month, F.col("productline")),
    }


def _summary_sql():
    y, m = int(YEAR.strip()), int(MONTH.strip())
    parts = [("product_line", "productline", "TRUE"), ("year", "year_id", "TRUE"), ("deal_size", "dealsize", "TRUE"),
             (f"month_of_{y}", "month_id", f"year_id = {y}"),
             (f"product_line_in_{y}_{m:02d}", "productline", f"year_id = {y} AND month_id = {m}")]
    long = union_all(f"SELECT '{n}' AS dimension, CAST({c} AS VARCHAR) AS value, sales FROM sales WHERE {w}"
                     for n, c, w in parts)
    return f""", long AS ({long}),
totals AS (SELECT dimension, value, CAST(sum(sales) AS DOUBLE) AS revenue FROM long GROUP BY dimension, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY revenue DESC, value DESC) AS rn FROM totals)
SELECT dimension, value AS best_value, revenue FROM ranked WHERE rn = 1"""


@query("sales_summary", covers="C15 A1 A2 A3", views=S, sql=_summary_sql())
def sales_summary(spark, d):
    # best line, best year, best deal size, best month of the year, best line in that month
    return explore.best_by_dimension(sales(spark, d), _summary_dims())
