"""A training-corpus pipeline over ``documents``: five stages, each one written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``, further ones included,
whatever their names.  An empty table goes through as one.  Very long texts are
worked on whole.  The stages set the session's Arrow batches to 1,000 rows, if
they are larger: they hand on whole texts, and their plans run when the caller
writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import fm, minhash, mixing, packing, secrets
from tabularium.llm.queries import tokenizer_path
from tabularium.llm.scratch import BATCH_ROWS, cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the factorization machine scores at 0.5 or more.

    Null and empty texts score the bias alone, below 0.5 where toxic documents are the
    rarer class; repeated rows share their fate; null ids are judged by their text.
    """
    _small_batches(spark)
    return fm.accepted(docs, fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates.

    Of rows with equal id and text one stays; rows of one id with different texts share
    their fate, and stay if one of them does.  Null and empty texts are near nothing and
    stay, and so do rows without an id.
    """
    _small_batches(spark)
    found = minhash.near_duplicates(docs).where("doc_id is not null")
    fate = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    fate = cut(fate.where("not kept or rows > 1"), "fate")
    rows = docs.join(fate.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = fate.where("kept").select("doc_id")
    if again.isEmpty():
        return rows
    return rows.join(again, "doc_id", "left_anti").select(docs.columns).union(rows.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; overlapping ones get one.  Null and empty texts, ids and repeated rows stay as they are."""
    _small_batches(spark)
    return _measured(secrets.redacted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, shortens or leaves out documents so that sources meet their target weights.

    Texts without words (null, empty, blank) have nothing to take and go; a null source
    is the last source; repeated rows are documents of their own; ties of the order
    within a source are broken by id, size and row.
    """
    return _measured(mixing.mixed_documents(docs))


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all token pieces into sequences: one row for each piece, null and empty texts being their end id."""
    return packing.packed_documents(docs, tokenizer_path()).drop("row")


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_pack", best_fit_pack),
]

#: No SQL says what the first, third, fourth and last stage do; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
