"""Lines of text files with their numbers, however Spark splits the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.session import materialize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 1 on in each file.

    Spark reads a large file in blocks. Lines are numbered within their block as they are read, blocks of a file are
    counted, and the counts before a block are added; only the counts (a row a block) are put in order.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "lines")  # written, so that numbers stay as they are
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("file", "block", "least", before.alias("before")), ["file", "block"]).select("file", (F.col("at") - F.col("least") + F.col("before") + 1).alias("line"), "value")
