"""Properties from SURVEY §5 checked on the driver tables at two scale factors."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import basket, clean, dq, rolling, stats
from quarry.sources.views import coasters, covid_deaths, covid_vaccinations, prices, sales

SFS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.mark.parametrize("sf", SFS)
def test_semi_join_rows_are_n_times_orders(spark, sf):
    # every line of an order carries the order's status, so each chosen order contributes n lines
    s = sales(spark, sf)
    for n in (2, 3):
        ids = basket.orders_with_n_lines(s, n, "F")
        assert basket.lines_of_n_line_orders(s, n, "F").count() == n * ids.count()


@pytest.mark.parametrize("sf", SFS)
def test_median_two_ways(spark, sf):
    p = prices(spark, sf)
    q = stats.quantiles(p, "bitcoin", {"q50": 0.5}).first()["q50"]
    ref = p.agg(F.median("bitcoin")).first()[0]
    assert q == pytest.approx(ref, rel=1e-12)


@pytest.mark.parametrize("sf", SFS)
def test_rows_after_dedup_equal_distinct_keys(spark, sf):
    c = coasters(spark, sf)
    subset = ["coaster_name", "location", "opening_date"]
    kept = dq.drop_duplicates_keep_first(c, "row_id", subset)
    assert kept.count() == c.select(*subset).distinct().count()
    assert kept.count() + dq.duplicated_rows(c, "row_id", subset).count() == c.count()


@pytest.mark.parametrize("sf", SFS)
def test_running_share_non_decreasing(spark, sf):
    r = rolling.rolling_share(rolling.rolling_vaccinations(covid_deaths(spark, sf), covid_vaccinations(spark, sf)))
    w = Window.partitionBy("location").orderBy("date")
    prev = r.withColumn("prev", F.lag("rolling_vaccinations_count").over(w))
    assert prev.where(F.col("rolling_vaccinations_count") < F.col("prev")).count() == 0


@pytest.mark.parametrize("sf", SFS)
def test_keep_below_is_drop_above_minus_boundary_and_nulls(spark, sf):
    p = prices(spark, sf)
    limit = stats.limit(stats.zscore_limits(p, "bitcoin"))
    lt, not_gt = clean.keep_below(p, "bitcoin", limit), clean.drop_above(p, "bitcoin", limit)
    extra = not_gt.join(lt, "event_id", "left_anti")
    lim_value = stats.zscore_limits(p, "bitcoin").first()["upper_limit"]
    assert extra.where(F.col("bitcoin").isNotNull() & (F.col("bitcoin") != lim_value)).count() == 0


@pytest.mark.parametrize("sf", SFS)
def test_backfill_leaves_only_trailing_gaps(spark, sf):
    f = clean.backfill(prices(spark, sf), "ether", ["ts", "event_id"], out="ether_filled")
    last_valid = prices(spark, sf).where(F.col("ether").isNotNull()).agg(F.max(F.struct("ts", "event_id"))).first()[0]
    still_null = f.where(F.col("ether_filled").isNull())
    ts_l, id_l = F.lit(last_valid[0]).cast("timestamp_ntz"), F.lit(last_valid[1]).cast("bigint")
    before_last = (F.col("ts") < ts_l) | ((F.col("ts") == ts_l) & (F.col("event_id") < id_l))
    assert still_null.where(before_last).count() == 0
    assert f.where(F.col("ether").isNotNull() & (F.col("ether") != F.col("ether_filled"))).count() == 0


@pytest.mark.parametrize("sf", SFS)
def test_covid_join_key_is_unique(spark, sf):
    for v in (covid_deaths(spark, sf), covid_vaccinations(spark, sf)):
        assert v.groupBy("location", "date").count().where("count > 1").count() == 0


def test_rfm_frequency_variants(spark):
    from quarry.operators import rfm
    s = sales(spark, SFS[0])
    lines = {r[0]: r[1] for r in rfm.rfm_base(s).select("customername", "frequency").collect()}
    orders = {r[0]: r[1] for r in rfm.rfm_base(s, distinct_orders=True).select("customername", "frequency").collect()}
    ref = {r[0]: r[1] for r in s.groupBy("customername").agg(F.countDistinct("ordernumber")).collect()}
    assert orders == ref and all(lines[c] >= orders[c] for c in lines)
