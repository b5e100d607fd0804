"""A keyed table in versions: a batch appears whole or not at all, and only buckets with a change are rewritten.

Rows lie in buckets by a hash of their key.  A version is a list of buckets and the folders
that hold them, appended to the table's manifest as one file after all data is written;
readers resolve the manifest first, so each of them sees one version.  A batch that fails
leaves files that no version names.  There is one writer at a time; readers are free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, bucket int, folder string"


@dataclass(frozen=True)
class Versions:
    """The folder of a table of rows with a key."""

    path: str
    key: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession) -> list[tuple[int, int, str]]:
        """(version, bucket, folder) of all versions; a row a rewritten bucket."""
        try:
            return [tuple(r) for r in spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").collect()]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def version(self, spark: SparkSession) -> int | None:
        """The latest version; None before the first."""
        return max((v for v, _, _ in self.manifest(spark)), default=None)

    def folders(self, spark: SparkSession, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket in a version, the latest one unless it is given."""
        found: dict[int, str] = {}
        for number, bucket, folder in sorted(self.manifest(spark)):
            if version is None or number <= version:
                found[bucket] = folder
        return found

    def read(self, spark: SparkSession, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, of some buckets if they are given; None if there are none."""
        held = self.folders(spark, version)
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(held.items()) if folder and (only is None or b in only)]
        return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None  # later versions may have more columns

    def _commit(self, rows: DataFrame, touched: list[int]) -> int:
        spark = rows.sparkSession
        number = 1 + (self.version(spark) or 0)
        folder = f"data/v{number}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = spark.read.schema("bucket int").parquet(f"{self.path}/{folder}")
        filled = {r["bucket"] for r in made.select("bucket").distinct().collect()}
        told = [(number, b, folder if b in filled else "") for b in touched]
        spark.createDataFrame(told, _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return number

    def replace(self, rows: DataFrame) -> int:
        """Makes the rows the whole table; returns the new version."""
        return self._commit(rows, list(range(self.buckets)))

    def change(self, rows: DataFrame, merged: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int | None:
        """Rewrites the buckets of the given rows' keys as ``merged`` makes them of the stored and the given rows.

        Other buckets keep their files.  What comes to the driver is bounded by the number
        of buckets.  Without rows there is no new version and the result is None.
        """
        spark = rows.sparkSession
        touched = sorted(r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())
        if not touched:
            return None
        return self._commit(merged(self.read(spark, only=touched), rows), touched)
