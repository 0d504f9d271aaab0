"""SQL text of the stand-in views, runnable by Spark SQL and DuckDB alike.

The oracle SQL of each registered query is ``WITH <views it needs> <body>``; the driver
registers only the raw tables, so every oracle statement carries its views inline.
"""

from __future__ import annotations

VIEW_SQL = {
    "sales": """
SELECT o.o_orderkey AS ordernumber, l.l_linenumber AS line_no, l.l_partkey AS productcode,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS sales,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l.l_discount - l.l_tax AS DECIMAL(9,4)) AS profit, l.l_quantity AS qty, o.o_orderstatus AS status,
       CAST(year(o.o_orderdate) AS INT) AS year_id, CAST(month(o.o_orderdate) AS INT) AS month_id,
       o.o_orderdate AS orderdate, p.p_type AS productline, c.c_name AS customername,
       c.c_mktsegment AS segment, n.n_name AS country, r.r_name AS territory,
       CASE WHEN l.l_extendedprice < 35000 THEN 'Small' WHEN l.l_extendedprice < 70000 THEN 'Medium' ELSE 'Large' END AS dealsize
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey""",
    "covid_deaths": """
SELECT location, date, CASE WHEN user_id % 25 = 0 THEN NULL ELSE concat('C', CAST(user_id % 6 AS STRING)) END AS continent,
       CAST(1000 + 10 * user_id AS DOUBLE) AS population, CAST(nc AS DOUBLE) AS new_cases, CAST(nd AS STRING) AS new_deaths,
       CAST(CAST(SUM(nc) OVER (PARTITION BY user_id ORDER BY date) AS BIGINT) AS STRING) AS total_cases,
       CAST(CAST(SUM(nd) OVER (PARTITION BY user_id ORDER BY date) AS BIGINT) AS STRING) AS total_deaths
FROM (SELECT user_id, CAST(ts AS DATE) AS date,
             concat(CASE WHEN user_id % 10 = 1 THEN 'United States ' ELSE 'Land ' END, CAST(user_id AS STRING)) AS location,
             CAST(SUM(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS nc,
             CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS nd
      FROM events GROUP BY user_id, CAST(ts AS DATE)) d""",
    "covid_vaccinations": """
SELECT concat(CASE WHEN user_id % 10 = 1 THEN 'United States ' ELSE 'Land ' END, CAST(user_id AS STRING)) AS location,
       CAST(ts AS DATE) AS date,
       CAST(nullif(CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT), 0) AS STRING) AS new_vaccinations
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "prices": """
SELECT event_id, ts, value AS bitcoin,
       CASE WHEN event_type IN ('view', 'click') AND day(ts) NOT BETWEEN 7 AND 11 THEN value END AS ether
FROM events""",
    "coasters": """
SELECT p_partkey AS row_id, p_name AS coaster_name, CASE WHEN p_brand = 'Brand#1' THEN 'Other' ELSE p_brand END AS location,
       p_type AS type_main, CAST(1950 + p_size AS INT) AS year_introduced,
       concat(CAST(1950 + p_size AS STRING), '-01-15') AS opening_date,
       CASE WHEN p_size < 50 THEN p_retailprice END AS speed_mph, CAST(p_size AS DOUBLE) AS height_ft,
       CAST(p_partkey % 8 AS INT) AS inversions, CAST(p_partkey % 50 AS DOUBLE) / 10 AS gforce
FROM part""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body.strip()}"
