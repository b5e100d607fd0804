"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import decontam, langid, neardup, packing, secretscan
from feedlens.llm.queries import tokenizer_path
from feedlens.llm.shared import shared_dir, written

#: A text of whose trigrams its best language knows less is in no known language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language.

    Null and empty texts, and those without letters, are in none and go; so do all
    documents if none is labelled.  Each of repeated rows is judged alike.  An empty table
    stays empty; extra columns stay.
    """
    # columns of these names are the documents' own
    held = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c.lower() in ("lang_pred", "score")}
    found = langid.identify(docs.withColumnsRenamed(held), langid.train(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[kept[f"`{held.get(c, c)}`"].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each near-duplicate group (Jaccard 0.8 on five-word shingles).

    Of rows with equal doc_id and text one stays.  Documents without words or without a
    doc_id are in no group and stay.  An empty table stays empty; extra columns stay.
    """
    found = neardup.near_duplicates(docs, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    again = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("again_id")).agg(F.count("*").alias("times")).where("times > 1").select("again_id")
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    single = kept.join(again, kept["doc_id"] == again["again_id"], "left_anti")
    return single.unionByName(kept.join(again, kept["doc_id"] == again["again_id"], "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item.

    Null and empty texts contain none.  A document without a doc_id can't be named and
    stays; rows that share a doc_id go together.  An empty table stays empty; extra columns stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.contaminated(docs, items).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["hit_id"], "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts the secrets of the documents, and corrects n_chars where there is such a column.

    Null texts stay null.  Overlapping spans are one stretch.  All rows stay, repeated ones
    too; extra columns stay, whatever their names.
    """
    held = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c.lower() in ("blob_id", "spans")}
    own = docs.withColumnsRenamed(held)
    found = secretscan.findings(own, written(secretscan.scan(own), "ledger"))
    clean = found.withColumn("text", secretscan.redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*[clean[f"`{held.get(c, c)}`"].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; null and empty texts are their end mark alone, repeated rows count each."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: SQL can't express the language and packing stages; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
