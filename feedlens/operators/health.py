"""Source reliability, crawl health counters, throttle and breaker folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fetch statuses that are failures.
FAILURES = ("error", "timeout", "failure")


def reliability(log: DataFrame, as_of: Column) -> DataFrame:
    """Per source: articles, errors, success rate, days since the last success, and a score of 100."""
    failed = F.lower(F.coalesce("fetch_status", F.lit("success"))).isin(*FAILURES)
    stats = (
        log.where(F.coalesce("source", F.lit("")) != "")
        .groupBy("source")
        .agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"), F.max(F.when(~failed, F.col("collected_at"))).alias("last_seen"))
    )
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    stale = F.greatest(seconds / 86400.0, F.lit(0.0))
    rate = (F.col("total") - F.col("errors")) / F.col("total")
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(stale, F.lit(14.0)) / 14), F.lit(0.0))
    return stats.select(
        "source",
        (F.col("total") - F.col("errors")).alias("article_count"),
        "errors",
        F.round(rate, 4).alias("success_rate"),
        F.round(stale, 2).alias("staleness_days"),
        F.round(100 * (0.7 * rate + 0.3 * recency), 2).alias("score"),
    )


def ranked(log: DataFrame, as_of: Column) -> DataFrame:
    """Reliability with the best score first; equal scores in order of the sources' first rows (``seq``)."""
    first = log.groupBy("source").agg(F.min("seq").alias("_first"))
    return reliability(log, as_of).join(first, "source").orderBy(F.desc("score"), "_first").drop("_first")


def rate_band(rate: Column) -> Column:
    """Band of a success rate in per cent: good from 80, fair from 50, else poor; null has none."""
    return F.when(rate >= 80, "good").when(rate >= 50, "fair").when(rate.isNotNull(), "poor")


def counters(events: DataFrame, threshold: int = 10) -> DataFrame:
    """Per source: successes, failures, last delay, last error and whether it is disabled."""
    failed = F.lower("fetch_status").isin(*FAILURES)
    stats = events.groupBy("source").agg(
        F.count_if(~failed).alias("success_count"),
        F.count_if(failed).alias("failure_count"),
        F.max_by("delay", "seq").alias("last_delay"),
        F.max_by("fetch_status", F.when(failed, F.col("seq"))).alias("last_error"),
    )
    return stats.withColumn("disabled", F.col("failure_count") >= threshold)


def merge_counters(old: DataFrame | None, new: DataFrame, threshold: int = 10) -> DataFrame:
    """Adds new counters to a state; being disabled is for good."""
    if old is None:
        return new
    a, b = old.alias("a"), new.alias("b")
    failures = F.coalesce("a.failure_count", F.lit(0)) + F.coalesce("b.failure_count", F.lit(0))
    return a.join(b, F.col("a.source") == F.col("b.source"), "full_outer").select(
        F.coalesce("a.source", "b.source").alias("source"),
        (F.coalesce("a.success_count", F.lit(0)) + F.coalesce("b.success_count", F.lit(0))).alias("success_count"),
        failures.alias("failure_count"),
        F.coalesce("b.last_delay", "a.last_delay").alias("last_delay"),
        F.coalesce("b.last_error", "a.last_error").alias("last_error"),
        (F.coalesce("a.disabled", F.lit(False)) | (failures >= threshold)).alias("disabled"),
    )


def is_bypass(value: Column) -> Column:
    """Whether a setting says that a source is fetched even while it is disabled."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def active_sources(sources: DataFrame, health: DataFrame, bypass: Column | None = None) -> DataFrame:
    """Sources that are fetched: those that aren't disabled, and those that ``bypass`` lets through all the same."""
    kept = without_disabled(sources, health)
    if bypass is None:
        return kept
    return without_disabled(sources.where(~is_bypass(bypass)), health).unionByName(sources.where(is_bypass(bypass)))


def without_disabled(rows: DataFrame, health: DataFrame) -> DataFrame:
    return rows.join(health.where("disabled").select("source"), "source", "left_anti")


def totals(health: DataFrame, limit: int = 20) -> DataFrame:
    """The sources with most attempts and their rate of success in per cent."""
    total = F.col("success_count") + F.col("failure_count")
    rows = health.withColumn("total", total).where("total > 0")
    return rows.select("source", "total", F.round(100 * F.col("success_count") / F.col("total"), 1).alias("rate")).orderBy(F.desc("total"), "source").limit(limit)


def throttle_fold(events: DataFrame, low: float = 0.5, high: float = 60.0, success: float = 0.9, failure: float = 2.0, width: int = 4096) -> DataFrame:
    """The delay of each source after its events in order of ``seq``: failures multiply it, successes take a fixed step off.

    A source's events are folded by stretches of ``width`` numbers, in parallel, from the
    least and from the greatest delay.  No step turns two delays' order round, so where both
    end alike, every delay does, and what came before doesn't matter.  Only the events after
    a source's last such stretch are then replayed in order, streaming through one task, and
    the result is that of one fold over all.  Numbers are unique within a source (``width``
    bounds what one group holds); a status of null is a success.
    """
    step = low * (1.0 - success)
    rows = events.select("source", "seq", F.coalesce(F.lower("fetch_status").isin(*FAILURES), F.lit(False)).alias("bad"))
    rows = rows.withColumn("part", F.floor(F.col("seq") / width))

    def replayed(start: float) -> Column:
        return F.aggregate(
            "events",
            F.lit(float(start)),
            lambda x, e: F.when(e["bad"], F.greatest(F.lit(low), F.least(F.lit(high), x * failure))).otherwise(F.greatest(F.lit(low), x - step)),
        )

    parts = rows.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "bad"))).alias("events"))
    parts = parts.select("source", "part", F.size("events").alias("n"), replayed(low).alias("least"), replayed(high).alias("most"))
    settled = F.max(F.when(F.col("least") == F.col("most"), F.struct("part", F.col("least").alias("delay")))).alias("settled")
    known = parts.groupBy("source").agg(F.sum("n").alias("n_events"), settled)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, delay, any_yet = None, low, False
        for batch in batches:
            out = []
            for own, bad, start in zip(batch["source"], batch["bad"], batch["start"], strict=True):
                if not any_yet or own != source:
                    if any_yet:
                        out.append((source, delay))
                    source, delay, any_yet = own, start, True
                delay = max(low, min(high, delay * failure)) if bad else max(low, delay - step)
            yield pd.DataFrame(out, columns=["source", "delay"])
        if any_yet:
            yield pd.DataFrame([(source, delay)], columns=["source", "delay"])

    begun = known.select(F.col("source").alias("own"), F.col("settled.part").alias("until"), F.coalesce("settled.delay", F.lit(low)).alias("start"))
    rest = rows.join(begun, F.col("source").eqNullSafe(F.col("own"))).where("until is null or part > until").select("source", "seq", "bad", "start")
    ordered = rest.repartition("source").sortWithinPartitions("source", "seq")
    last = ordered.mapInPandas(fold, "source string, delay double").select(F.col("source").alias("own"), F.col("delay").alias("last"))
    found = known.join(last, F.col("source").eqNullSafe(F.col("own")), "left")
    return found.select("source", F.coalesce("last", "settled.delay").alias("delay"), "n_events")


def breaker_fold(events: DataFrame, fail_max: int = 5, reset_seconds: float = 60.0, successes: int = 2) -> DataFrame:
    """The circuit breaker's state of each source after its events in order of time: calls while open are refused."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source", "state", "refused", "opened"]
        source, state, fails, good, since, refused, opened = None, "closed", 0, 0, 0.0, 0, 0
        for part in parts:
            out = []
            for own, bad, at in zip(part["source"], part["bad"], part["at"], strict=True):
                if own != source:
                    if source is not None:
                        out.append((source, state, refused, opened))
                    source, state, fails, good, since, refused, opened = own, "closed", 0, 0, 0.0, 0, 0
                if state == "open":
                    if at - since < reset_seconds:
                        refused += 1
                        continue
                    state, good = "half-open", 0
                if bad:
                    fails += 1
                    if state == "half-open" or fails >= fail_max:
                        state, since, opened = "open", at, opened + 1
                elif state == "half-open":
                    good += 1
                    if good >= successes:
                        state, fails = "closed", 0
                else:
                    fails = 0
            yield pd.DataFrame(out, columns=names)
        if source is not None:
            yield pd.DataFrame([(source, state, refused, opened)], columns=names)

    rows = events.select(
        "source", "seq", F.unix_micros(F.col("collected_at").cast("timestamp")).cast("double").alias("us"), F.lower("fetch_status").isin(*FAILURES).alias("bad")
    ).withColumn("at", F.col("us") / 1e6)
    ordered = rows.repartition("source").sortWithinPartitions("source", "at", "seq")
    return ordered.select("source", "bad", "at").mapInPandas(fold, "source string, state string, refused long, opened long")


def interval_violations(log: DataFrame, seconds: float) -> DataFrame:
    """Fetches of a source that follow the one before too soon."""
    gap = F.unix_micros(F.col("collected_at").cast("timestamp")) - F.unix_micros(F.lag("collected_at").over(Window.partitionBy("source").orderBy("collected_at", "seq")).cast("timestamp"))
    return log.withColumn("gap", gap / 1e6).where(F.col("gap") < seconds)


def retry_after(value: Column, as_of: Column, low: float, high: float) -> Column:
    """Delay that a Retry-After header asks for: seconds or an HTTP date, within bounds."""
    number = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    later = (F.unix_seconds(date) - F.unix_seconds(as_of.cast("timestamp"))).cast("double")
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(number, later, F.lit(low))))


def freshness(log: DataFrame, as_of: Column, sla_hours: float) -> DataFrame:
    """Per source whether its last success is recent enough."""
    failed = F.lower("fetch_status").isin(*FAILURES)
    last = log.groupBy("source").agg(F.max(F.when(~failed, F.col("collected_at"))).alias("last_seen"))
    hours = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))) / 3600.0
    status = F.when(F.col("last_seen").isNull(), "missing").when(hours <= sla_hours, "fresh").otherwise("stale")
    return last.select("source", F.round(hours, 2).alias("age_hours"), status.alias("status"))


def sla_summary(sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row of how many sources (source, tracked) there are, are tracked, and are fresh, stale, missing or not tracked.

    A tracked source of which ``fresh`` (source, status) says nothing is missing.
    """
    known = fresh.select("source", "status")
    status = F.when(~F.coalesce("tracked", F.lit(False)), "not_tracked").otherwise(F.coalesce("status", F.lit("missing")))
    rows = sources.join(known, "source", "left").select(status.alias("status"))
    kinds = ("fresh", "stale", "missing", "not_tracked")
    return rows.agg(
        F.count("*").alias("total_sources"),
        F.count_if(F.col("status") != "not_tracked").alias("tracked_sources"),
        *[F.count_if(F.col("status") == k).alias(f"{k}_sources") for k in kinds],
    )
