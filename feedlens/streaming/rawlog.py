"""The raw log of a stream of articles, each batch exactly once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACES = ["day", "source_file", "run_id", "batch"]
#: What stands for a log without a run.
NO_RUN = "none"


def log_batch(rows: DataFrame, batch: int, path: str, run_id: str | None = None) -> None:
    """Writes a batch (link, source, logged_at, ...) under its day, file-safe source, run and number.

    A repeated batch overwrites the folders that it wrote before, so it adds nothing.
    With a run, a link that an earlier batch of the run has logged for its day and
    source is left out, and each link of the batch stands once; without one all rows stay.
    """
    keys = ["link", "day", "source_file"]
    placed = rows.withColumns(
        {
            "day": F.date_format("logged_at", "yyyy-MM-dd"),
            "source_file": F.translate("source", "/\\", "__"),
            "run_id": F.lit(run_id or NO_RUN),
            "batch": F.lit(batch).cast("long"),
        }
    )
    if run_id is not None:
        earlier = logged(rows, path)
        placed = placed.dropDuplicates(keys)
        if earlier is not None:
            earlier = earlier.where((F.col("run_id") == run_id) & (F.col("batch") < batch))
            placed = placed.join(earlier.select(*keys), keys, "left_anti")
    placed.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*_PLACES).json(path)


def logged(rows: DataFrame, path: str) -> DataFrame | None:
    """What the log holds, with the columns of ``rows`` and its places; None before the first batch."""
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "day string", "source_file string", "run_id string", "batch long"])
    try:
        return rows.sparkSession.read.schema(kinds).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def log_stream(stream: DataFrame, path: str, checkpoint: str, run_id: str | None = None):
    """Logs every batch of a stream; batches that are replayed after a failure add nothing."""
    write = stream.writeStream.foreachBatch(lambda rows, number: log_batch(rows, number, path, run_id))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
