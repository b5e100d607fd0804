"""Views of the supplied tables as articles and fetch logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.sources.html import html_text, html_title

#: All time-dependent queries take this as now (the events end on 2024-01-30).
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fetch_log(events: DataFrame) -> DataFrame:
    """(seq, source, fetch_status, collected_at, delay) from the event stream."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "timeout").otherwise("ok")
    source = F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string"))
    return events.select(
        F.col("event_id").alias("seq"), source.alias("source"), status.alias("fetch_status"), F.col("ts").alias("collected_at"), F.col("value").alias("delay")
    )


def doc_articles(documents: DataFrame) -> DataFrame:
    """Articles (link, source, category, title, summary, event_ts) from documents."""
    link = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return documents.select(
        "doc_id",
        link.alias("link"),
        "source",
        F.col("lang").alias("category"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        day.cast("timestamp_ntz").alias("event_ts"),
    )


def page_articles(pages: DataFrame) -> DataFrame:
    """Articles (page_id, link, source, category, title, summary) from raw web pages."""
    return pages.select(
        "page_id",
        F.col("url").alias("link"),
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("source"),
        F.regexp_extract("url", "://[^/]+/([^/?#]+)", 1).alias("category"),
        html_title(F.col("html"), F.col("url")).alias("title"),
        html_text(F.col("html")).alias("summary"),
    )


def align(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the missing columns as nulls of their types: old rows read null in new columns."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
