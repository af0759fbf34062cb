"""The stored state: versioned chunks and term statistics as partitioned Parquet tables that an ingest changes in part.

Partitions are dealt by a hash. Spark writes the changed ones into a staging folder of the table and puts them in place
when all tasks are done, so a job that fails leaves the old state. Nothing else is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.session import materialize, remove

#: Partitions of a table; a state of 100 TB wants some tens of thousands. Tasks, so files, of a partition of chunks at most.
PARTS, SLICES = 16, 8


def part(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def put(rows: DataFrame, path: str, dealt: bool = False) -> None:
    """Replace the partitions (`part`) of the table that `rows` has; the others stay. Rows that are `dealt` by partitions
    already stay in their tasks. `rows` may read the table: what it had is replaced when all tasks are done."""
    rows = rows if dealt else rows.repartition("part")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part int").parquet(path)


HISTORY = "document_id string, id string, text string, version string, ordinal long, superseded boolean"


def save(drafts: DataFrame, path: str, first: bool = False, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """Bring the table of chunks at `path` to the snapshot `drafts` (document_id, id, text, version, ordinal). Returns what
    was current and isn't now, and what is now and wasn't: what `update_stats` takes. Both read the table, so they are
    for use before the next save.

    Partitions are of documents. Those in which no document changed aren't written: a part is told by the sum of the
    hashes of its current rows, so only two numbers of each are compared. Of the changed ones the snapshot's and the
    stored rows are dealt once, by partition and a second hash of the document, and written from there, so a text moves
    once. A row says (`was`) whether it was current before its partition was last written.
    """
    spark = drafts.sparkSession
    columns = [c.split()[0] for c in HISTORY.split(", ")]
    new = drafts.withColumn("part", part("document_id", parts)).withColumn("superseded", F.lit(False)).select(*columns, "part")
    history = None if first else read(spark, path, HISTORY)
    rows = new.withColumn("new", F.lit(True))
    if history is not None:
        mark = F.sum(F.xxhash64("id", "version", "ordinal").cast("decimal(38, 0)")).alias("mark")
        was, is_ = history.where("not superseded").groupBy("part").agg(mark), new.groupBy("part").agg(mark.alias("to"))
        changed = [r.part for r in was.join(is_, "part", "full").where(~F.col("mark").eqNullSafe(F.col("to"))).select("part").collect()]  # numbers of partitions
        rows = rows.unionByName(history.withColumn("new", F.lit(False))).where(F.col("part").isin(changed))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("document_id", F.lit(1)), F.lit(SLICES))).repartition("part", "slice")
    if history is None:
        rows = rows.withColumn("was", F.lit(False))
    else:  # the rule of `ingest.apply`: what the snapshot has is current, other versions stay, superseded
        same = Window.partitionBy("part", "slice", "id", "version")
        current = ~F.col("new") & ~F.col("superseded")
        rows = rows.withColumn("was", F.max(current).over(same)).withColumn("kept", ~F.max("new").over(same))
        rows = rows.where("new or kept").withColumn("was", F.when(F.col("new"), F.col("was")).otherwise(current)).withColumn("superseded", ~F.col("new"))
    put(rows.select(*columns, "was", "part"), path, dealt=True)
    after = read(spark, path, f"{HISTORY}, was boolean")
    after = after if history is None else after.where(F.col("part").isin(changed))
    return after.where("was and superseded").drop("was"), after.where("not was and not superseded").drop("was")


TERMS = "term string, df long"


def _df(chunks: DataFrame, sign: int) -> DataFrame:
    return chunks.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"), F.lit(sign).alias("d"))


def _totals(chunks: DataFrame, sign: int) -> DataFrame:
    return chunks.agg((F.count(F.lit(1)) * sign).alias("chunks"), (F.coalesce(F.sum(F.size(T.tokens(F.col("text")))), F.lit(0)) * sign).alias("length"))


def update_stats(before: DataFrame, now: DataFrame, path: str, parts: int = PARTS) -> None:
    """Change the stored statistics by what left (`before`) and what came (`now`): signed counts for each term, then only
    the partitions of terms that changed. What is in both cancels out. Terms that no chunk has any more keep a row with
    df 0."""
    spark = now.sparkSession
    change = _df(before, -1).union(_df(now, 1)).groupBy("term").agg(F.sum("d").alias("d")).where("d <> 0")
    change = materialize(change.withColumn("part", part("term", parts)), "change")
    try:
        old = read(spark, f"{path}/terms", TERMS)
        totals = spark.read.schema("chunks long, length long").parquet(f"{path}/totals")
        old.isEmpty()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old, totals = spark.createDataFrame([], f"{TERMS}, part int"), spark.createDataFrame([], "chunks long, length long")
    touched = change.select("part").distinct()
    merged = old.join(F.broadcast(touched), "part", "left_semi").select("term", "df", "part").union(change.select("term", "d", "part"))  # `parts` rows at most
    merged = merged.repartition("part").groupBy("part", "term").agg(F.sum("df").alias("df")).select("term", "df", "part")
    sums = totals.union(_totals(before, -1)).union(_totals(now, 1)).agg(F.sum("chunks").alias("chunks"), F.sum("length").alias("length"))
    sums = materialize(sums, "totals")
    put(merged, f"{path}/terms", dealt=True)
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")  # one row
    remove(change, sums)


def stored_terms(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, f"{path}/terms", TERMS).where("df > 0").select("term", "df")


def stored_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row: chunks and their average length; null without chunks."""
    return spark.read.parquet(f"{path}/totals").select("chunks", F.try_divide(F.col("length").cast("double"), "chunks").alias("avg_length"))
