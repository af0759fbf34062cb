"""Ingestion as set operations over versioned chunks: differences, new states, reports, and sources that fail alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.session import materialize


def diff(drafts: DataFrame, history: DataFrame) -> DataFrame:
    """What a snapshot does to the stored versions: a row (id, version, ordinal, action, replaced) an id.

    same, moved (another ordinal), fresh (a version never stored) and revived (a version stored before); stale for a
    current chunk that the snapshot lacks. `replaced` is the current version that a new one takes the place of. `drafts` is (id, version, ordinal), `history` also has `superseded`.
    """
    current = history.where("not superseded").select("id", F.col("version").alias("old_version"), F.col("ordinal").alias("old_ordinal"))
    past = history.where("superseded").select("id", "version").distinct().withColumn("was", F.lit(True))
    both = drafts.join(past, ["id", "version"], "left").join(current, "id", "full_outer")
    action = (
        F.when(F.col("version").isNull(), "stale").when(F.col("version").eqNullSafe(F.col("old_version")) & (F.col("ordinal") == F.col("old_ordinal")), "same")
        .when(F.col("version").eqNullSafe(F.col("old_version")), "moved").when(F.col("was"), "revived").otherwise("fresh")
    )
    return both.select("id", F.coalesce("version", "old_version").alias("version"), F.coalesce("ordinal", "old_ordinal").alias("ordinal"), action.alias("action"), F.when(action.isin("fresh", "revived"), F.col("old_version")).alias("replaced"))


def apply(drafts: DataFrame, history: DataFrame) -> DataFrame:
    """The history after a snapshot: old versions stay, superseded; a revived version is current again."""
    changes = diff(drafts, history)
    now = changes.where("action <> 'stale'").select("id", "version", "ordinal", F.lit(False).alias("superseded"))
    kept = history.join(now.select("id", "version"), ["id", "version"], "left_anti").select("id", "version", "ordinal", F.lit(True).alias("superseded"))
    return now.unionByName(kept)


def supersede_missing(history: DataFrame, source: str, present: DataFrame) -> DataFrame:
    """Current chunks of the source whose documents the snapshot `present` (document_id) lacks."""
    return history.where((F.col("source") == source) & ~F.col("superseded")).join(present, "document_id", "left_anti")


def supersede_other_models(history: DataFrame, model: str) -> DataFrame:
    """The history with current chunks of other models superseded; a null model is another one."""
    return history.withColumn("superseded", F.col("superseded") | ~F.col("model").eqNullSafe(model))


def report(changes: DataFrame) -> DataFrame:
    """New versions and superseded chunks of each source of changes (source, action, replaced); moved and same chunks are
    neither, and a version of a chunk that wasn't current supersedes none."""
    old = (F.col("action") == "stale") | F.col("replaced").isNotNull()
    return changes.groupBy("source").agg(F.count_if(F.col("action").isin("fresh", "revived")).alias("new_versions"), F.count_if(old).alias("superseded"))


def faults(drafts: DataFrame) -> DataFrame:
    """(reader, fault) of the readers whose documents can't be stored: one that belongs to another source, or that has a
    locator twice. `drafts` is (reader, source, document_id, id); of several faults the first by document is told."""
    foreign = drafts.where(~F.col("source").eqNullSafe(F.col("reader"))).select("reader", "document_id", F.lit("foreign document").alias("what"))
    twice = drafts.groupBy("reader", "document_id", "id").count().where("count > 1").select("reader", "document_id", F.lit("duplicate locator").alias("what"))
    first = foreign.union(twice).groupBy("reader").agg(F.min(F.struct("document_id", "what")).alias("f"))
    return first.select("reader", F.concat_ws(" ", "f.what", "f.document_id").alias("fault"))


def ingest(drafts: DataFrame, history: DataFrame, readers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, history) after the snapshots of some `readers` (reader), each of one source.

    A reader with a fault is rejected alone and whole: its source's chunks stay as they are, missing ones too. `drafts`
    is (reader, source, document_id, id, version, ordinal), `history` (source, id, version, ordinal, superseded). The
    report is (reader, fault, documents, new_versions, superseded) of each reader, one that read nothing too.
    """
    bad = materialize(faults(drafts), "faults")  # a row a reader at most
    sound = readers.join(bad, "reader", "left_anti").select(F.col("reader").alias("source"))
    taken = drafts.join(sound, "source", "left_semi").where(F.col("reader") == F.col("source"))
    mine = history.join(sound, "source", "left_semi")
    changes = diff(taken.select("id", "version", "ordinal"), mine)
    of = taken.select("id", "source").union(mine.select("id", "source")).distinct()
    counts = report(changes.join(of, "id"))
    read = taken.groupBy("source").agg(F.count_distinct("document_id").alias("documents"))
    told = readers.join(bad, "reader", "left").join(counts.withColumnRenamed("source", "reader"), "reader", "left").join(read.withColumnRenamed("source", "reader"), "reader", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    after = apply(taken.select("id", "version", "ordinal"), mine).join(of, "id").select("source", "id", "version", "ordinal", "superseded")
    return told.select("reader", "fault", none("documents"), none("new_versions"), none("superseded")), after.unionByName(history.join(sound, "source", "left_anti").select(*after.columns))


def embed_runs(chunks: DataFrame, size: int = 64, most_tokens: int = 50_000, reject: bool = False) -> DataFrame:
    """(document_id, run, texts, longest): the texts of each document in order, packed for a model by the rule of `batches`.

    Only the lengths of texts move. Documents stream through a task in order, many of them in a batch of rows.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["document_id", "run", "texts", "longest"]
        document, place, run, texts, longest, most = object(), 0, 0, 0, 0, 0
        for rows in frames:
            done = []
            for of, n, tokens, start in zip(rows.document_id, rows.n.tolist(), rows.tokens.tolist(), rows.start, strict=True):
                place = place + 1 if of == document else 0
                if reject and tokens > most_tokens:
                    raise ValueError(f"text {place} is about {tokens} tokens, over {most_tokens}; it starts {start!r}")
                if of != document or texts == size or max(most, tokens) * (texts + 1) > most_tokens:
                    if texts:
                        done.append((document, run, texts, longest))
                    run = run + 1 if of == document else 0
                    document, texts, longest, most = of, 0, 0, 0
                texts, longest, most = texts + 1, max(longest, n), max(most, tokens)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if texts:
            yield pd.DataFrame([(document, run, texts, longest)], columns=columns)

    start = F.left("text", F.lit(80)) if reject else F.lit("")
    rows = chunks.select("document_id", "ordinal", F.char_length("text").alias("n"), T.token_estimate(F.col("text")).alias("tokens"), start.alias("start"))
    return rows.repartition("document_id").sortWithinPartitions("document_id", "ordinal").mapInPandas(pack, "document_id string, run long, texts long, longest long")
