"""The coaster cleaning pipeline (C16): project → parse date → rename → dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dq import drop_duplicates_keep_first


def clean_coasters(df: DataFrame, renames: dict[str, str], date_col: str = "opening_date",
                   subset: tuple[str, ...] = ("Coaster_Name", "Location", "Opening_Date"),
                   order_key: str = "row_id") -> DataFrame:
    """Keep the renamed columns, parse the opening date, drop later duplicates on ``subset``.

    The date parse is ANSI: text that is not a date fails the job, as ``pd.to_datetime``
    raises; use ``functions.scalar.to_timestamp_lenient`` on dirty input.
    """
    keep = [order_key, *renames]
    projected = df.select(*keep).withColumn(date_col, F.to_date(date_col))
    renamed = projected.withColumnsRenamed(renames)
    return drop_duplicates_keep_first(renamed, order_key, list(subset))
