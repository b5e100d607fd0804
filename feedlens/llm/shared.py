"""Shared storage, range buckets and connected components for the operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Range buckets at most, so that their bounds and sums stay small; larger inputs have larger buckets, which are sorted on disk.
MOST_BUCKETS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where that is unset, a local session (tests) has a new folder; a cluster has no
    folder that all executors see, so this raises an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; it can be removed when the application's results are stored."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the rows as a compressed table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key(rows: DataFrame, name: str = "doc_id") -> DataFrame:
    """Casts an id column to long and moves its nulls into a column no_id.

    pandas holds a column of longs with a null as floats, which rounds ids above 2**53;
    without nulls it holds them exactly.
    """
    key = F.col(name).cast("long")
    return rows.withColumns({"no_id": key.isNull(), name: F.coalesce(key, F.lit(0).cast("long"))})


def without_key(rows: DataFrame, name: str = "doc_id") -> DataFrame:
    """Undoes with_key."""
    return rows.withColumn(name, F.when(~F.col("no_id"), F.col(name))).drop("no_id")


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` increasing cut values of a long column, from approximate quantiles.

    What comes to the driver is bounded by the number of buckets.
    """
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * buckets)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_bucket(column: Column, bounds: list[int], names: np.ndarray | None = None) -> Column:
    """The number of bounds at or below the value (null is in bucket 0), or what ``names`` calls that bucket."""
    cuts = np.asarray(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = np.zeros(len(values), dtype=np.int32)
        out[known] = np.searchsorted(cuts, values[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out if names is None else names[out].astype(np.int32))

    return place(column)


def bucket_count(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Buckets of about ``rows_each`` rows, enough of them for the session's partitions, and MOST_BUCKETS at most."""
    return max(1, min(max(session_partitions(spark), math.ceil(rows / rows_each)), math.ceil(rows / 32), MOST_BUCKETS))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, component) with the smallest node.

    Alternates large-star and small-star steps (each node links its larger, then its
    smaller neighbours to its least neighbour) until nothing changes; every step is one
    shuffle and is checkpointed in the shared folder.  A hub's neighbours are never
    gathered: the least neighbour is an aggregate that is joined back.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = now.checkpoint()
    before = _digest(now)
    while True:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        down = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = down.join(least, "a").select(F.inline(linked)).where("a <> b").distinct().checkpoint()
        after, now = _digest(small), small
        if before == after:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
