"""The run log as a stream: outcomes by window, and appends of runs that aren't stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.runs import new_runs


def outcomes(runs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs of each window and status. Rows (id, at timestamp, status) that are later than `late` are not counted; a
    repeated id within that time counts once."""
    once = runs.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"]) if runs.isStreaming else runs.dropDuplicates(["id"])
    return once.groupBy(F.window("at", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("runs")).select(F.col("w.start").alias("start"), "status", "runs")


def append_new(path: str, schema: str):
    """A foreachBatch function that appends the runs (id, arrived, ...) that `path` doesn't hold yet."""

    def write(batch: DataFrame, _: int) -> None:
        stored = batch.sparkSession.read.schema(schema).parquet(path) if _exists(batch, path) else batch.limit(0)
        fresh, _rejected = new_runs(stored, batch)
        fresh.write.mode("append").parquet(path)

    return write


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(place)
