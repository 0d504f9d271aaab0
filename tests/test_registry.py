"""Every registered query against its DuckDB oracle (sf0.001), plus plan-shape checks."""

import pytest

from conftest import SF_SMALL
from quarry.plans.registry import ORACLE, QUERIES, load_all

load_all()

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))
_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
               "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    from tools.check_oracle import duck_con
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    import tools.check_oracle as co
    from tools.check_oracle import canon
    co.EXACT = True                      # floats compared bit for bit
    sdf = QUERIES[name](spark, SF_SMALL)
    sc, sr = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = duck.sql(ORACLE[name])
    duck_types = {c: _DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: f.dataType.simpleString() for f in sdf.schema.fields} == duck_types
    cur = duck.execute(ORACLE[name])
    dc, dr = canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n != "model_comparison"])
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 1


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "rfm_segment" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_in_subquery_plans_left_semi(spark):
    plan = QUERIES["semi_two_line_orders"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["date_slice"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    plan = QUERIES["rate_by_attribute"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


def test_ntile_has_no_single_partition_sort_of_rows(spark):
    plan = QUERIES["ntile_scaled"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # the only un-partitioned window is over the per-bucket count table, inside the broadcast
    assert "ntile(" not in plan.lower()


def _single_partition_outside_broadcast(plan: str) -> list[str]:
    """Lines with an Exchange SinglePartition that carries rows (not partial aggregates) and has no
    BroadcastExchange ancestor."""
    lines = plan.split("\n")

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        if i + 1 < len(lines) and "partial_" in lines[i + 1]:
            continue                      # global aggregate: one partial row per task
        d, ok = depth(line), False
        for prev in reversed(lines[:i]):
            if depth(prev) < d:
                d = depth(prev)
                if "BroadcastExchange" in prev:
                    ok = True
                    break
        if not ok:
            bad.append(line.strip())
    return bad


@pytest.mark.parametrize("name", ["ntile_scaled", "bfill", "quantiles", "describe_numeric"])
def test_ordered_operators_keep_rows_off_single_partition(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert _single_partition_outside_broadcast(plan) == []


def test_year_filter_reaches_the_orders_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = QUERIES["month_revenue"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in plan and "LessThan(o_orderdate,1999-01-01T00:00)" in plan
