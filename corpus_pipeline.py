"""The corpus pipeline: five stages, each one of the operators, each on what the one before kept.

``run(spark, sf_dir)`` applies ``STAGES`` to ``documents``. A stage takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All stages but the last return the columns of ``docs`` as they are. Rows without a doc_id
stay in every stage; rows that repeat a doc_id share its decisions; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality, queries, simhash, substring, toxicity
from quarry.llm.common import scratch_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score stays below the threshold go."""
    model = quality.train_quality(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model, queries.QUALITY_THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    model = toxicity.train_toxicity(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, queries.TOXICITY_THRESHOLD)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    groups = simhash.simhash_near_dups(docs)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; texts that lose nothing stay as they are.

    A text that loses words becomes its kept words joined by one space, and n_chars follows it.
    """
    return substring.remove_repeats(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed: one row per piece, as in ``op3_best_fit_packing``, with the piece's ids."""
    return queries.packed(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage), ("toxicity", toxicity_stage), ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage), ("best-fit packing", packing_stage)]

# No SQL expresses the classifiers; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
