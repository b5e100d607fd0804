"""Data-quality checks, fused into one pass where they aggregate, and article validation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import plain_title
from feedlens.functions.urls import is_valid_url
from feedlens.operators.duplicates import sequence_ratio, url_host, url_path


def missing_fields(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """(field, missing, ratio in per cent) of SQL conditions, in one scan."""
    one = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.expr(c)).alias(f) for f, c in conditions.items()])
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("missing")) for f in conditions])
    found = one.select("_n", F.inline(parts))
    return found.select("field", "missing", F.when(F.col("_n") > 0, F.round(100.0 * F.col("missing") / F.col("_n"), 4)).alias("ratio"))


def duplicate_keys(rows: DataFrame, key: Column, limit: int = 20) -> DataFrame:
    counts = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(limit)


def text_lengths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, avg, min, max) of lengths, in one scan."""
    one = rows.agg(*[f(F.length(c)).alias(f"{k}_{c}") for c in columns for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.round(f"avg_{c}", 4).alias("avg_length"), F.col(f"min_{c}").alias("min_length"), F.col(f"max_{c}").alias("max_length"))
            for c in columns
        ]
    )
    return one.select(F.inline(parts))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def invalid_values(rows: DataFrame, column: str, allowed: list[str] | None) -> DataFrame:
    """Values that aren't allowed; null never is invalid, and without a list nothing is."""
    counts = value_counts(rows, column)
    return counts.where(F.lit(False)) if allowed is None else counts.where(F.col("value").isNotNull() & ~F.col("value").isin(*allowed))


def date_stats(rows: DataFrame, column: str, as_of: Column) -> DataFrame:
    return rows.agg(F.count_if(F.col(column) > as_of).alias("future"), F.min(column).alias("first"), F.max(column).alias("last"))


def run_all(rows: DataFrame, key: str, text: list[str], language: str, date: str, as_of: Column) -> DataFrame:
    """All checks as tidy rows (check, key, value), from one aggregate and one count of keys."""
    one = rows.agg(
        F.count("*").cast("double").alias("total"),
        F.count_if(F.col(date) > as_of).cast("double").alias("future"),
        F.countDistinct(language).cast("double").alias("languages"),
        *[F.count_if(F.col(c).isNull() | (F.col(c) == "")).cast("double").alias(f"missing_{c}") for c in text],
        *[F.round(F.avg(F.length(c)), 4).alias(f"length_{c}") for c in text],
    )
    names = one.columns
    tidy = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value")) for n in names])))
    dups = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").cast("double").alias("value"))
    return tidy.unionByName(dups.select(F.lit("duplicate_keys").alias("check"), "value"))


def quality_report(
    rows: DataFrame, conditions: dict[str, str], text: list[str], language: str, allowed: list[str] | None, key: str, date: str, as_of: Column, limit: int = 10
) -> DataFrame:
    """Everything that the checks tell, as tidy rows (check, key, metric, value).

    total; missing (each condition's count, and ratio in per cent, which is null without
    rows); duplicate (the most repeated keys); length (avg, min and max of each text);
    language (each value's count, null's too) and invalid (values that aren't allowed);
    date (future, and oldest and newest in seconds).  All that needs no grouping is one
    aggregate; keys and languages are one grouping each.
    """
    one = rows.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.expr(c)).alias(f"missing_{i}") for i, c in enumerate(conditions.values())],
        *[f(F.length(c)).alias(f"{k}_{i}") for i, c in enumerate(text) for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
        F.count_if(F.col(date) > as_of).alias("future"),
        F.unix_timestamp(F.min(date).cast("timestamp")).alias("oldest"),
        F.unix_timestamp(F.max(date).cast("timestamp")).alias("newest"),
    )

    def cell(check: str, key: str | None, metric: str, value: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(key).cast("string").alias("key"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    cells = [cell("total", None, "n", F.col("total"))]
    for i, name in enumerate(conditions):
        share = F.when(F.col("total") > 0, F.round(100.0 * F.col(f"missing_{i}") / F.col("total"), 4))
        cells += [cell("missing", name, "n", F.col(f"missing_{i}")), cell("missing", name, "ratio", share)]
    for i, name in enumerate(text):
        cells += [cell("length", name, "avg", F.round(f"avg_{i}", 4)), *[cell("length", name, k, F.col(f"{k}_{i}")) for k in ("min", "max")]]
    cells += [cell("date", date, k, F.col(k)) for k in ("future", "oldest", "newest")]

    def counted(check: str, found: DataFrame, key: str) -> DataFrame:
        return found.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), F.lit("n").alias("metric"), F.col("n").cast("double").alias("value"))

    parts = [one.select(F.inline(F.array(*cells))), counted("duplicate", duplicate_keys(rows, F.col(key), limit), "key")]
    parts += [counted("language", value_counts(rows, language), "value"), counted("invalid", invalid_values(rows, language, allowed), "value")]
    return functools.reduce(DataFrame.unionByName, parts)


def validation_errors() -> Column:
    """Messages of what is wrong with an article, in fixed order."""
    blank = lambda c: c.rlike(r"(?U)\A[\s\x1C-\x1F]*\z")

    def text(name: str) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | (c == ""), f"{name} is missing or not a string").when(blank(c), f"{name} is empty")

    def present(name: str) -> Column:
        return F.when(F.col(name).isNull() | (F.col(name) == ""), f"{name} is missing or not a string")

    link = F.when(F.col("link").isNull() | (F.col("link") == ""), F.lit("link is missing or not a string")).when(
        ~is_valid_url(F.col("link")), F.concat(F.lit("link has invalid URL format: "), "link")
    )
    return F.filter(F.array(text("title"), link, text("summary"), present("source"), present("category")), lambda e: e.isNotNull())


def similar_articles(pairs: DataFrame, title_at_least: float = 0.85, url_at_least: float = 0.8) -> DataFrame:
    """Pairs (title1, url1, title2, url2) that are the same article: similar titles, then equal hosts and similar paths."""
    near = pairs.where(url_host(F.col("url1")) == url_host(F.col("url2")))
    near = near.where(sequence_ratio(plain_title(F.col("title1")), plain_title(F.col("title2"))) >= title_at_least)
    paths = url_path(F.col("url1")), url_path(F.col("url2"))
    return near.where((paths[0] == paths[1]) | (sequence_ratio(*paths) >= url_at_least))
