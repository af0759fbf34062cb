"""Session helpers: building a session, reading tables, writing intermediate tables that survive lost executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine); removed when Python ends.
LOCAL_CHECKPOINTS = f"/tmp/checkpoints/quillstack-{os.getpid()}"
#: Rows and bytes (as JSON) up to which a table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000
#: Rows of a file of a small table.
FILE_ROWS = 300_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillstack")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's tables: below spark.checkpoint.dir, or a local one where that is unset, on a
    local master only (elsewhere executors would write to disks of their own)."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/quillstack-{spark.sparkContext.applicationId}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    atexit.register(shutil.rmtree, LOCAL_CHECKPOINTS, ignore_errors=True)
    return LOCAL_CHECKPOINTS


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if it has at most `rows` rows of `most_bytes` in all, as measured; a larger one is
    left to Spark's own join."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most_bytes else df


def materialize(df: DataFrame, label: str = "table", rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back.

    Cuts the lineage with files that outlive executors, and lets later joins plan from real sizes:
    both sides then get their own exchange, which AQE can split where a key is hot. Where the caller knows about how many
    `rows` there are, they go to files of FILE_ROWS each, so that small tables aren't many small files.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove every table that this application has written, once its results are stored elsewhere."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
