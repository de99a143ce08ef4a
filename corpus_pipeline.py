"""A training-data pipeline of five corpus operators.

Every stage works on all documents that the one before kept, and returns the columns of ``documents``; the last adds the
mix's columns to them. Stages handle what their operators handle: nulls in any column, empty and very long
texts, repeated rows, empty tables and further columns (see the operators' docstrings).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, minhash, mixing, quality_cnn
from textloom.llm.common import free_names
from textloom.storage import checkpoint_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more; the model is learned from the labelled documents among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_cnn.fit(docs, labels.where(quality_cnn.remainder(F.col("doc_id")) != 0))  # held-out labels stay unseen
    scored = quality_cnn.score_quality(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= 0.3).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those that lose every line go. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    removed = F.col(out.columns[-1])
    gone = (removed > 0) & (F.trim(F.regexp_replace("text", r"[\t-\r]", " ")) == "")
    out = out.where(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each near-duplicate group (five-word shingles, similarity 0.8 or more)."""
    groups = minhash.near_duplicates(docs)
    gone = groups.where("not kept").select("doc_id").distinct().alias("gone")
    return docs.alias("docs").join(gone, F.col("docs.doc_id").cast("long") == F.col("gone.doc_id"), "left_anti")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with how many copies of each the mix takes (size, source_size, target, copies) and of how many words (taken).

    Columns of these names among ``docs`` are replaced. Rows alike in doc_id, source and size have the same target; they
    are told apart by their numbers only.
    """
    plan = mixing.mix_sources(docs).withColumn("taken", F.col("copies") * F.col("size"))
    added = [c for c in plan.columns if c not in ("doc_id", "source")]
    names = free_names([*docs.columns, *plan.columns], "__mx_doc", "__mx_source", "__mx_size", "__mx_row", *(f"__mxr_{c}" for c in added))
    doc, source, size, row = names[:4]
    moved = dict(zip(added, names[4:]))
    key = {doc: F.col("doc_id").cast("long"), source: F.col("source").cast("string")}
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)).cast("long"), F.lit(0).cast("long"))
    alike = lambda order: F.row_number().over(Window.partitionBy(doc, source, size).orderBy(order))
    left = docs.withColumns(key | {size: words}).withColumn(row, alike(F.xxhash64("text")))
    right = plan.withColumns(key | {size: F.col("size")}).withColumn(row, alike("copies")).drop("doc_id", "source").withColumnsRenamed(moved)
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for c in (doc, source, size, row):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*(F.col(f"a.`{c}`") for c in docs.columns if c not in added), *(F.col(f"b.{m}").alias(c) for c, m in moved.items()))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmarks), ("source_mixing", mix)]

#: SQL cannot express a trained classifier; test_pipeline_stages holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again by the next."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
