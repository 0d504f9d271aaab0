"""``ntile`` by several orders at once, from the rows at the tile borders.

The rows of a table are cut into k tiles by (value, key), ascending, for each of several
values. Only the k − 1 border rows of each order are looked for, all of them in shared
passes (``order_stats.values_at_ranks``): first the value at each border's rank, then,
among the rows that share this value, the key, by the numbers that its next bytes spell.
Every row's tiles are then comparisons with the border rows, made where the row is. No row
is sorted, shuffled or written; the borders (orders × (k − 1) rows) come to the driver.
"""

from __future__ import annotations

import os
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .order_stats import Target, values_at_ranks

_STEP = 6           # key bytes that a double holds exactly


def border_ranks(k: int, n: int | None = None) -> list:
    """The rank of the last row of tiles 1 … k − 1: of n rows, or as SQL over column ``n``."""
    if n is None:
        return [f"({t} * floor(n / {k}) + least({t}, n % {k}))" for t in range(1, k)]
    return [t * (n // k) + min(t, n % k) for t in range(1, k)]


def _number(value: Column, descending: bool) -> Column:
    """The value as a double in ascending order; NULL comes first, or last where descending."""
    v = F.coalesce(value.cast("double"), F.lit(float("-inf")))
    return -v if descending else v


def _next_bytes(raw: Column, at: int) -> Column:
    """The number that the next ``_STEP`` bytes after the first ``at`` spell; missing bytes count as zero."""
    return F.conv(F.rpad(F.hex(F.substring(raw, at + 1, _STEP)), 2 * _STEP, "0"), 16, 10).cast("double")


class _Border:
    """A border row being looked for: the ``rank``-th of ``same`` rows with this value and key prefix."""

    def __init__(self, order: str, value: float, rank: int, same: int, prefix: bytes):
        self.order, self.value, self.rank, self.same, self.prefix = order, value, rank, same, prefix


def _at_border(b: _Border, raw: Column | None) -> Column:
    same = F.col(b.order) == F.lit(b.value)
    return same & (F.substring(raw, 1, len(b.prefix)) == F.lit(b.prefix)) if b.prefix else same


def _border_keys(rows: DataFrame, borders: list[_Border], text: bool, longest: int) -> list:
    """The key of every border row, in order of ``borders``; keys have ``longest`` bytes at most."""
    raw = F.encode(F.col("key"), "utf-8") if text else None
    number_at = (lambda at: _next_bytes(raw, at)) if text else (lambda at: F.col("key").cast("double"))
    at, open_ = len(borders[0].prefix), list(range(len(borders)))
    while open_:
        hit = F.array_compact(F.array(*[F.when(_at_border(borders[i], raw), F.lit(i)) for i in open_]))
        matched = rows.select(F.explode(hit).alias("border"), number_at(at).alias("_v"))
        rank = "CASE border " + " ".join(f"WHEN {i} THEN {borders[i].rank}" for i in open_) + " END"
        share = {i: borders[i].rank / borders[i].same for i in open_}
        for r in values_at_ranks(matched, [Target(share, [rank])], ["border"]).collect():
            b = borders[r.border]
            b.rank, b.same = b.rank - r.before0_0, r.same0_0
            b.prefix = b.prefix + int(r.at0_0).to_bytes(_STEP, "big") if text else r.at0_0
        at += _STEP
        open_ = [i for i in open_ if borders[i].same > 1 and at < longest]
    if not text:
        return [int(b.prefix) if float(b.prefix).is_integer() else b.prefix for b in borders]
    if all(len(b.prefix) >= longest for b in borders):
        return [b.prefix.rstrip(b"\0").decode() for b in borders]
    # one row of each is left: its prefix is filled up with zero bytes where the key ended before
    hexed = [F.rpad(F.hex(raw), 2 * len(b.prefix), "0") for b in borders]
    mine = [(F.col(b.order) == F.lit(b.value)) & (F.substring(h, 1, 2 * len(b.prefix)) == F.lit(b.prefix.hex().upper()))
            for b, h in zip(borders, hexed)]
    return list(rows.agg(*[F.min(F.when(m, F.col("key"))).alias(f"k{i}") for i, m in enumerate(mine)]).first())


def ntiles(df: DataFrame, k: int, orders: dict[str, str | tuple[str, bool]], key: str) -> DataFrame:
    """``df`` with, for each entry of ``orders`` (name → value column, or (value column, descending)), the column
    ``name`` = ``ntile(k) over (order by value [desc], key)``.

    ``key`` is unique (text or a number below 2**53); values are numbers that a double holds
    exactly and not NaN. NULL values come first, or last where descending. ``df`` is read a few
    times, so it should be a written or checkpointed table.
    """
    spec = {name: (v, False) if isinstance(v, str) else v for name, v in orders.items()}
    numbers = {name: _number(F.col(v), desc) for name, (v, desc) in spec.items()}
    text = isinstance(df.schema[key].dataType, StringType)
    if not text and not isinstance(df.schema[key].dataType, NumericType):
        raise ValueError("the key must be text or a number")
    rows = df.select(F.col(key).alias("key"), *[n.alias(name) for name, n in numbers.items()])
    long = rows.unpivot([], list(spec), "order", "_v")
    targets = [Target(t / k, [rank]) for t, rank in enumerate(border_ranks(k), 1)]
    found = {r.order: r for r in values_at_ranks(long, targets, ["order"]).collect()}
    if not found:
        return df.withColumns({name: F.lit(None).cast("int") for name in spec})
    prefix, longest = b"", 0
    if text:
        ends = rows.agg(F.min("key").alias("a"), F.max("key").alias("z"), F.max(F.octet_length("key")).alias("n")).first()
        prefix, longest = os.path.commonprefix([ends.a.encode(), ends.z.encode()]), ends.n
    borders = [_Border(name, r[f"at{i}_0"], rank - r[f"before{i}_0"], r[f"same{i}_0"], prefix)
               for name, r in found.items() for i, rank in enumerate(border_ranks(k, r.n))]
    keys = _border_keys(rows, borders, text, longest) if borders else []
    out = {}
    for name in spec:
        beyond = [((numbers[name] > F.lit(b.value)) | ((numbers[name] == F.lit(b.value)) & (F.col(key) > F.lit(at)))).cast("int")
                  for b, at in zip(borders, keys) if b.order == name]
        out[name] = sum(beyond, F.lit(1)).cast("int")
    return df.withColumns(out)

