"""Oracle SQL fragments shared by several registered queries (DuckDB dialect)."""

from __future__ import annotations

from ..operators.resampling import poisson1_cdf

REPLICATES, SEED = 100, 7
_POISSON_SQL = "CASE " + " ".join(f"WHEN u < CAST({c!r} AS DOUBLE) THEN {k}" for k, c in enumerate(poisson1_cdf())) + " ELSE 21 END"


def weights_sql(src: str, cols: str) -> str:
    """CTEs up to weighted: each row of src(k, ...) once per replicate b with its weight w."""
    return f"""hashed AS (SELECT {cols}, md5(concat_ws('|', k, blk.range, {SEED})) AS h, blk.range AS block
            FROM {src}, range({REPLICATES // 4}) AS blk),
drawn AS (SELECT {cols}, block * 4 + q.range + 1 AS b,
                 CAST(CAST('0x' || substr(h, CAST(q.range * 8 + 1 AS BIGINT), 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
          FROM hashed, range(4) AS q),
weighted AS (SELECT {cols}, b, {_POISSON_SQL} AS w FROM drawn)"""


def edges_sql(col: str, src: str, where: str = "TRUE") -> str:
    """lo/hi (numpy's ±0.5 for a constant column) and n of a column."""
    return (f"SELECT CASE WHEN min({col}) = max({col}) THEN min({col}) - 0.5 ELSE min({col}) END AS lo, "
            f"CASE WHEN min({col}) = max({col}) THEN max({col}) + 0.5 ELSE max({col}) END AS hi, "
            f"count({col}) AS n FROM {src} WHERE {where}")


def edge_rows_sql(col: str, src: str, k: int | str, most: int | None = None) -> str:
    """One row per bin of ``col``: bin, lo, hi, whether it is the last (closed) one, value count, width.

    ``k`` is a number, or a scalar SQL expression of at most ``most``.
    """
    return (f"SELECT CAST(r.range AS INTEGER) AS bin, lo + r.range * ((hi - lo) / {k}) AS lo, "
            f"lo + (r.range + 1) * ((hi - lo) / {k}) AS hi, r.range = {k} - 1 AS last, n AS total, (hi - lo) / {k} AS width "
            f"FROM ({edges_sql(col, src)}) AS ends, range({most or k}) AS r WHERE r.range < {k}")


def in_bin_sql(x: str, edges: str) -> str:
    """Whether x lies in a bin: lo <= x < hi, the last bin closed."""
    return f"({x} >= {edges}.lo AND ({x} < {edges}.hi OR {edges}.last))"


def hist_sql(src: str, col: str, k: int | str, density: bool = False, cumulative: bool = False,
             most: int | None = None) -> str:
    """Histogram over all k bins (empty bins included); optional density / cumulative form."""
    body = f""", edge AS ({edge_rows_sql(col, src, k, most)}),
h AS (SELECT edge.bin, edge.lo, edge.hi, edge.total, edge.width, count(x.{col}) AS n
      FROM edge LEFT JOIN {src} AS x ON {in_bin_sql('x.' + col, 'edge')} GROUP BY ALL)
"""
    if cumulative:
        return body + ("SELECT bin, hi, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum_n, "
                       "sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cum_share FROM h")
    if density:
        return body + "SELECT bin, lo, hi, n, round(n / (total * width), 12) AS density FROM h"
    return body + "SELECT bin, lo, hi, n FROM h"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
