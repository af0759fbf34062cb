"""An approximate index of vectors: coarse centroids, an inverted list for each, and a search that widens until it has
enough readable rows.

Centroids and the number of lists to probe are fitted on a bounded sample of the vectors; every vector is indexed. The
lists are a table partitioned by list, so a probe reads its lists alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.operators import ranking
from quillstack.operators.retrieval import LIMIT, VECTOR_PLACES, top
from quillstack.session import materialize, shared_dir

#: Vectors that centroids are fitted on at most, lists at most, rounds of the fit, and the share of near vectors that the sample must find.
SAMPLE, LISTS, ROUNDS, SHARE = 20_000, 1024, 12, 0.97


@dataclass
class Index:
    """Unit centroids; how many lists a search probes first; where the lists are (list, id, embedding: unit vectors)."""

    centroids: np.ndarray
    probes: int
    path: str
    kind: str = "long"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.kind}, embedding array<float>, list int").parquet(self.path)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one: null, empty and zero vectors and odd components have none."""
    rows = column.to_pylist()
    ok = np.array([bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows], bool)
    x = np.array([v for v, good in zip(rows, ok, strict=True) if good], np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x), ok


def fit_centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors; a list that loses all its vectors starts again at one that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        for k in np.flatnonzero(np.bincount(own, minlength=len(c)) == 0):
            sums[k] = x[(worst := int(fit.argmin()))]
            fit[worst] = 2
        c = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, share: float, asked: int = 200) -> int:
    """How many lists some of the sample must probe to find `share` of their k nearest in the sample, on average."""
    q = x[: min(asked, len(x))]
    k = min(k, len(x))
    true = np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]
    own = (x @ c.T).argmax(1)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)  # of each list in a query's order
    need = np.sort(np.take_along_axis(place, own[true], 1).ravel())
    return int(need[min(int(np.ceil(share * len(need))), len(need)) - 1]) + 1


def _assigned(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, ok = _matrix(batch.column(1))
                if len(x):
                    own = (x @ c.T).argmax(1)
                    ids = batch.column(0).filter(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array(own.astype(np.int32))], names=["id", "embedding", "list"])

    return run


def build(vectors: DataFrame, path: str | None = None, lists: int = LISTS, sample: int = SAMPLE, k: int = LIMIT, share: float = SHARE) -> Index:
    """Index all `vectors` (id, embedding). Vectors without a direction aren't in it: no query is near them."""
    spark = vectors.sparkSession
    # The smallest hashes are a sample that doesn't depend on partitions.
    drawn = vectors.where("embedding is not null").orderBy(F.xxhash64("id", "embedding")).limit(sample).select("embedding")
    x, _ = _matrix(drawn.toArrow().column("embedding").combine_chunks())  # at most `sample` rows
    c = fit_centroids(x, max(1, min(lists, len(x) // 16))) if len(x) else np.zeros((1, 1))
    probes = probes_for(x, c, k, share) if len(x) else 1
    kind = vectors.schema["id"].dataType.simpleString()
    path = path or f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    rows = vectors.select("id", "embedding").mapInArrow(_assigned(spark.sparkContext.broadcast(c)), f"id {kind}, embedding array<float>, list int")
    rows.repartition("list").sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(path)
    return Index(c, probes, path, kind)


def _ordered(held):
    """(qid, query, list, place): each query's lists from the nearest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, ok = _matrix(batch.column(1))
                if len(x):
                    order = np.argsort(-(x @ c.T), axis=1, kind="stable").astype(np.int32)
                    ids = batch.column(0).filter(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float64())), pa.array(list(order), pa.list_(pa.int32()))], names=["qid", "query", "lists"])

    return run


def search(index: Index, queries: DataFrame, k: int = LIMIT, readable: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k nearest of `queries` (qid, query) by cosine among the lists that are probed.

    The scope (`readable`: id) is applied before ranking. Queries that have found fewer than k readable rows probe twice
    as many lists, and so on to all lists: each round joins only such queries, with only the lists they haven't read.
    """
    spark = queries.sparkSession
    kind = queries.schema["qid"].dataType.simpleString()
    table = index.table(spark)
    if readable is not None:
        table = table.join(readable.select("id"), "id", "left_semi")
    order = materialize(queries.select("qid", "query").mapInArrow(_ordered(spark.sparkContext.broadcast(index.centroids)), f"qid {kind}, query array<double>, lists array<int>"), "order")
    found, done, upto = None, 0, probes or index.probes
    todo = order
    while True:
        asked = todo.select("qid", "query", F.slice("lists", done + 1, upto - done).alias("lists"))
        probed = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]  # numbers of lists, LISTS at most
        near = ranking.nearest(asked, table.where(F.col("list").isin(probed)), k, VECTOR_PLACES)
        part = materialize(top(near.withColumn("score", F.round("score", VECTOR_PLACES)), k, F.desc("score"), F.asc("id")).drop("rank"), "near")
        found = part if found is None else found.unionByName(part)
        done, upto = upto, 2 * upto
        if done >= len(index.centroids):
            break
        enough = found.groupBy("qid").count().where(F.col("count") >= k)
        todo = materialize(todo.join(enough, "qid", "left_anti"), "todo")
        if todo.isEmpty():
            break
    return found.select("qid", "id", "score", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("long").alias("rank")).where(F.col("rank") <= k)
