"""Article store operators: keyed merge, recent rows, retention, raw log, evolution."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.plans.versions import Versions

#: Of a conflicting link, the stored row keeps these.
FIRST_WINS = ("category", "source", "cluster_id")
LINEAGE = {
    "run_id": "string",
    "collector_version": "string",
    "fetch_status": "string",
    "fetched_at": "timestamp_ntz",
    "ontology_json": "string",
    "cluster_id": "string",
}


def upsert(stored: DataFrame | None, staged: DataFrame, key: str = "link", seq: str = "seq") -> DataFrame:
    """Merges staged rows into stored ones by key: the last row's values, but the first one's category and source.

    One shuffle on the key with partial aggregation; ``seq`` orders the staged rows.
    """
    rows = staged.withColumn("_at", F.struct(F.lit(1).alias("gen"), F.col(seq).alias("seq")))
    if stored is not None:
        old = stored.withColumn("_at", F.struct(F.lit(0).alias("gen"), F.lit(0).cast(staged.schema[seq].dataType).alias("seq")))
        rows = old.unionByName(rows, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in (key, seq, "_at")]
    keep = [c for c in names if c in FIRST_WINS]
    rest = [c for c in names if c not in FIRST_WINS]
    first = F.min_by(F.struct(*keep), "_at").alias("_first") if keep else F.lit(None).alias("_first")
    merged = rows.groupBy(key).agg(first, F.max_by(F.struct(*rest), "_at").alias("_last"))
    return merged.select(key, *[F.col(f"_first.{c}") for c in keep], *[F.col(f"_last.{c}") for c in rest])


def require_links(staged: DataFrame, key: str = "link") -> DataFrame:
    """Fails the whole write if any key is null."""
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit("article without a link"))).otherwise(F.col(key))
    return staged.withColumn(key, checked)


def merge_stored(table: Versions, staged: DataFrame, seq: str = "seq") -> int | None:
    """Merges staged rows into a stored table as one new version; a row without a key fails the batch, and the old version stays.

    Only buckets with a staged key are read and rewritten.
    """

    def merged(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        return upsert(None if old is None else old.drop("bucket"), rows, table.key, seq)

    return table.change(require_links(staged, table.key), merged)


def recent(articles: DataFrame, as_of: Column, days: int, limit: int, category: str | None = None, ts: str = "event_ts", tie: str = "link") -> DataFrame:
    """The newest articles of the last days (a top-k, no full sort)."""
    rows = articles.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows.orderBy(F.desc(ts), tie).limit(limit)


def survivors(rows: DataFrame, as_of: Column, days: int, ts: str) -> DataFrame:
    """Rows that retention keeps; a null time is kept."""
    return rows.where(~F.coalesce(F.col(ts) < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)))


def retention_count(rows: DataFrame, as_of: Column, days: int, ts: str) -> DataFrame:
    old = F.col(ts) < as_of - F.expr(f"INTERVAL {days} DAYS")
    return rows.agg(F.count_if(old).alias("deleted"), F.count_if(~F.coalesce(old, F.lit(False))).alias("kept"))


def unlogged(staged: DataFrame, logged: DataFrame, key: str = "link") -> DataFrame:
    """Staged rows with links that the raw log doesn't hold yet, one a link."""
    return staged.join(logged.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def write_raw_log(rows: DataFrame, path: str) -> None:
    """JSON lines by day and file-safe source."""
    safe = F.translate("source", "/\\", "__")
    rows.withColumn("day", F.to_date("logged_at")).withColumn("source_file", safe).write.mode("append").partitionBy("day", "source_file").json(path)


def is_expired_report(name: Column, today: Column, keep_days: int) -> Column:
    """Whether a report file's date (8 digits at the end of its stem, or an ISO stem) is too old; index.html never is."""
    stem = F.regexp_replace(name, r"\.html$", "")
    digits = F.try_to_date(F.regexp_extract(stem, r"(\d{8})$", 1), "yyyyMMdd")
    day = F.coalesce(digits, F.try_to_date(F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd"))
    return F.coalesce((name != "index.html") & (day < F.date_sub(today, keep_days)), F.lit(False)) if keep_days >= 0 else F.lit(False)


def is_expired_folder(name: Column, today: Column, keep_days: int) -> Column:
    """Whether a dated folder is too old; names of other forms never are, and a negative number of days keeps all."""
    return F.coalesce(F.try_to_date(name, "yyyy-MM-dd") < F.date_sub(today, keep_days), F.lit(False)) if keep_days >= 0 else F.lit(False)


def retention_policy(files: DataFrame, today: Column, raw_days: int, report_days: int, snapshot_days: int = 30, run_id: str | None = None, version: str | None = None) -> DataFrame:
    """One row of what retention removes from a listing (kind, name): raw_removed, report_removed, snapshots_removed.

    With a run's id or version, the row tells them as run_id and collector_version.
    """
    name = F.col("name")
    old = {
        "raw_removed": (F.col("kind") == "raw") & is_expired_folder(name, today, raw_days),
        "report_removed": (F.col("kind") == "report") & is_expired_report(name, today, report_days),
        "snapshots_removed": (F.col("kind") == "snapshot") & is_expired_folder(name, today, snapshot_days),
    }
    told = {n: F.lit(v) for n, v in (("run_id", run_id), ("collector_version", version)) if v is not None}
    return files.agg(*[F.count_if(c).alias(n) for n, c in old.items()]).withColumns(told)


def stamped(articles: DataFrame, at: Column, run_id: str | None = None, version: str | None = None, status: str | None = None) -> DataFrame:
    """Articles with their run's columns; fetched_at is set only if the run says anything of itself."""
    told = any(v is not None for v in (run_id, version, status))
    given = {"run_id": run_id, "collector_version": version, "fetch_status": status}
    rows = articles.withColumns({n: F.lit(v).cast("string") for n, v in given.items()})
    return rows.withColumn("fetched_at", at.cast("timestamp_ntz") if told else F.lit(None).cast("timestamp_ntz"))


def make_run_id(at: datetime, prefix: str, run: str | None = None) -> str:
    """The id of a scheduler's run where there is one, else one of the time (UTC) and a random part."""
    return f"{prefix}-gh-{run}" if run else f"{prefix}-{at:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def write_snapshot(articles: DataFrame, root: str, day: date) -> str:
    """Writes the store as it is under a folder of the day, and returns its path."""
    path = f"{root.rstrip('/')}/snapshots/{day.isoformat()}"
    articles.write.mode("overwrite").parquet(path)
    return path


def source_shares(articles: DataFrame, limit: int = 15) -> DataFrame:
    """What stands in for a crawl's health: the largest sources (source, success, failure, total, rate), all of it successes."""
    counts = articles.where("source <> ''").groupBy("source").agg(F.count("*").alias("success")).orderBy(F.desc("success"), "source").limit(limit)
    return counts.select("source", "success", F.lit(0).cast("long").alias("failure"), F.col("success").alias("total"), F.lit(100.0).alias("rate"))
