"""The labelled rows a classifier is fitted on, and the split that is held out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8_list


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """(texts, labels) of at most ``rows`` labelled rows that are not held out, chosen by a hash of the id.

    The bound is the only thing that limits what reaches the driver: ids and labels are cut
    to ``rows`` first, then their whole texts are looked up.
    """
    pick = (labels.select(F.col(id_col).cast("long").alias("id_"), F.col(label).cast("int").alias("y_"))
            .where(F.col("id_").isNotNull() & F.col("y_").isin(0, 1) & ~held_out(F.col("id_")))
            .orderBy(F.xxhash64("id_"), "id_", "y_").limit(rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"))
    table = texts.join(F.broadcast(pick), "id_").select("id_", "text_", "y_").toArrow()
    if not table.num_rows:
        return [], np.zeros(0)
    table = table.sort_by([("id_", "ascending"), ("y_", "ascending")])
    return utf8_list(table.column("text_").combine_chunks()), table.column("y_").to_numpy().astype(float)
