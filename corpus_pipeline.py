"""The corpus pipeline: five stages, each an operator of ``quillmark.llm``, applied to ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs`` with their values, whatever their names. Stages decide row
by row, also where doc_ids are null or repeated. Null, empty and blank texts are judged
like others; an empty table stays empty. The last stage adds its columns and replaces
earlier ones of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, minhash, mixing, quality, sharding
from quillmark.llm.common import ASCII_SPACE, drop_made, drop_settled, made, settle, table, unused

SHARD_BYTES = 1 << 20

#: SQL can express neither the classifier nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once so that it does not change, and the number's name."""
    (row,) = unused(docs, "__row")
    return settle(docs.withColumn(row, F.monotonically_increasing_id())), row


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learned from all labels, rejects."""
    rows, row = _numbered(docs)
    scored = quality.score_quality(rows, table(spark, sf_dir, "labels"), carry=(row,))
    return rows.join(scored.where("predicted = 0").select(row), row, "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id (null last), of each near-duplicate class; of a doc_id's rows without words, one."""
    rows, row = _numbered(docs)
    blank = ~F.coalesce(F.col("text").rlike(f"[^{ASCII_SPACE}]"), F.lit(False)) & F.col("doc_id").isNotNull()
    named = rows.select(F.col(row).alias("row"), "doc_id", blank.alias("blank"))
    classes = minhash.near_duplicates(rows, id_col=row).select(F.col(row).alias("row"), "class_id").join(named, "row")
    classes = classes.select("row", "doc_id", "blank", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("c"))
    first = classes.groupBy("blank", "c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first"))
    rest = classes.select("row").join(first.select("first.row"), "row", "left_anti").withColumnRenamed("row", row)
    return rows.join(rest, row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item within its edit budget."""
    (leaks,) = unused(docs, "__leaks")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), leaks)
    return found.where(F.size(leaks) == 0).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops or repeats documents so that sources reach their target words."""
    copies, nth = unused(docs, "__copies", "__nth")
    mixed = mixing.take_copies(docs, copies)
    return mixed.where(F.col(copies) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's shard."""
    return sharding.shard_by_bytes(docs, SHARD_BYTES)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for nth, (_, stage) in enumerate(STAGES):
        mark, before, docs = made(), docs, stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs = settle(docs)
            drop_made(spark, mark, docs)  # what the stage wrote for itself
            drop_settled(spark, before)
    return docs
