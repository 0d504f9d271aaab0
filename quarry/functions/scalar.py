"""Scalar expressions used by the analyses (all built-in Spark functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ingest rule: pandas skips NaN in aggregates, Spark does not, so map NaN to NULL."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def to_decimal(c, precision: int = 18, scale: int = 2) -> Column:
    """``convert(decimal(p,s), c)``."""
    return col_(c).cast(f"decimal({precision},{scale})")


def to_int(c, lenient: bool = False) -> Column:
    """``cast(c as int)``; ANSI cast fails on bad text, ``lenient`` gives NULL instead."""
    return col_(c).try_cast("int") if lenient else col_(c).cast("int")


def to_bigint(c, lenient: bool = False) -> Column:
    return col_(c).try_cast("bigint") if lenient else col_(c).cast("bigint")


def pct(numerator, denominator) -> Column:
    """``(a/b)*100`` with real division; a zero or NULL denominator gives NULL."""
    return F.try_divide(col_(numerator), col_(denominator)) * 100


def day_diff(start, end) -> Column:
    """T-SQL ``datediff(DD, start, end)``: calendar-day boundaries crossed."""
    return F.datediff(col_(end).cast("date"), col_(start).cast("date"))


def text_eq_number(c, text: str) -> Column:
    """``c = ' 2004'`` with the implicit text→number conversion made explicit (blanks trimmed)."""
    return col_(c) == F.trim(F.lit(text)).cast("int")


def concat_text(*cols) -> Column:
    """T-SQL ``a + b`` on text: NULL-propagating concatenation (never ``+`` in Spark)."""
    return F.concat(*[col_(c).cast("string") for c in cols])


def format_number_line(label: str, c, decimals: int | None = None) -> Column:
    """``"Upper Limit: {}".format(x)``: the full value, or with a fixed number of decimals."""
    if decimals is None:
        return F.concat(F.lit(f"{label}: "), col_(c).cast("string"))
    return F.format_string(f"{label}: %.{decimals}f", col_(c))


def to_timestamp_lenient(c, fmt: str | None = None) -> Column:
    """Parse text to timestamp; unparsable text gives NULL instead of failing."""
    return F.try_to_timestamp(col_(c), F.lit(fmt)) if fmt else F.try_to_timestamp(col_(c))


def to_number_lenient(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: text → double, NULL when not a number."""
    return col_(c).try_cast("double")


def period_range(c, year: int, month: int | None = None, kind: str = "timestamp_ntz") -> Column:
    """``c`` within a calendar year (or month) as a half-open range of literals.

    Equivalent to ``year(c) = year [and month(c) = month]``, but a plain comparison on the
    column, so the parquet scan can skip row groups by their min/max statistics.
    """
    import datetime as dt
    if month is None:
        lo, hi = dt.date(year, 1, 1), dt.date(year + 1, 1, 1)
    else:
        lo = dt.date(year, month, 1)
        hi = dt.date(year + (month == 12), month % 12 + 1, 1)
    x = col_(c)
    return (x >= F.lit(lo.isoformat()).cast(kind)) & (x < F.lit(hi.isoformat()).cast(kind))
