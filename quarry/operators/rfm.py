"""RFM customer scoring (C1) and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import concat_text, day_diff
from ..session import reliable_checkpoint
from .tiles import ntiles

# Segment labels and the three-digit RFM codes mapped to them, as written
# in the reference's CASE expression. The 30 other codes of 111..444 get no label (NULL).
SEGMENT_CODES = {
    "Lost customers": ["111", "112", "121", "122", "123", "132", "211", "212", "114", "141"],
    "Slipping customer, cannot lose": ["133", "134", "143", "244", "334", "343", "344"],
    "New customers": ["311", "411", "331"],
    "Potential churner": ["222", "223", "233", "322"],
    "Active": ["323", "333", "321", "422", "332", "432"],
    "Loyal": ["433", "434", "443", "444"],
}


def rfm_base(sales: DataFrame, customer: str = "customername", amount: str = "sales",
             date: str = "orderdate", order_id: str = "ordernumber", distinct_orders: bool = False) -> DataFrame:
    """Per customer: monetary sum and mean, line count, last date, dataset's last date, recency.

    ``frequency`` counts lines over all years (as the reference's code does; its comment
    says orders: ``distinct_orders=True`` counts distinct order ids instead). The dataset's
    last date is the maximum of the customers' last dates: a scalar subquery over the
    per-customer table, which is checkpointed first (while this function runs), so the order
    lines are read once. The mean is the exact decimal sum divided by the non-null count, in double.
    """
    g = reliable_checkpoint(sales.groupBy(customer).agg(
        F.sum(amount).alias("_sum"),
        F.count(amount).alias("_n"),
        (F.countDistinct(order_id) if distinct_orders else F.count(order_id)).alias("frequency"),
        F.max(date).alias("last_order_date")))
    max_date = g.select(F.max("last_order_date")).scalar()
    return g.select(
        customer,
        F.col("_sum").cast("double").alias("monetary_value"),
        (F.col("_sum").cast("double") / F.col("_n")).alias("avg_monetary_value"),
        "frequency",
        "last_order_date",
        max_date.alias("max_order_date"),
        day_diff(F.col("last_order_date"), max_date).alias("recency"),
    )


def rfm_scores(base: DataFrame, customer: str = "customername", k: int = 4,
               recency_best_first: bool = False) -> DataFrame:
    """Three ``ntile(k)`` scores (ties broken by customer), their sum and 3-digit code.

    Recency is tiled by ascending days as in the reference (tile 1 = most recent); with
    ``recency_best_first`` the days are tiled descending (tile k = most recent).
    All three orders are tiled together from their border rows (``tiles.ntiles``), at every
    size; ``rfm_base`` has already written the per-customer table, which is only read here.
    """
    s = ntiles(base, k, {"rfm_recency": ("recency", recency_best_first), "rfm_frequency": "frequency",
                         "rfm_monetary": "monetary_value"}, customer)
    return s.withColumns({
        "rfm_cell": F.col("rfm_recency") + F.col("rfm_frequency") + F.col("rfm_monetary"),
        "rfm_cell_string": concat_text("rfm_recency", "rfm_frequency", "rfm_monetary"),
    })


def segment_label(code) -> F.Column:
    """Searched CASE without ELSE over the code text: unlisted codes give NULL."""
    expr = None
    for label, codes in SEGMENT_CODES.items():
        cond = F.col(code).isin(*codes) if isinstance(code, str) else code.isin(*codes)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def rfm_segments(scores: DataFrame, customer: str = "customername") -> DataFrame:
    return scores.select(customer, "rfm_recency", "rfm_frequency", "rfm_monetary",
                         segment_label("rfm_cell_string").alias("rfm_segment"))
