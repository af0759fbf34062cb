"""A training-data pipeline of five of the llm operators: each stage takes what its predecessor kept.

Every stage but the last returns the columns of `documents`, with n_chars brought up to date where texts change.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import bpe, decontaminate, jaccard, line_dedup, quality
from quillstack.session import materialize, remove, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold go. Texts without words, null ones too, have the mean score and stay; texts of
    any length are scored whole, rows that repeat one another alike; an empty table stays empty."""
    scored = quality.score_quality(docs, quality.fit(quality.training_rows(spark, sf_dir)), keep=list(COLUMNS))
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go but in the smallest document; so do documents of which no text is left by that. Null and empty
    texts have no line to lose and stay; rows that share an id are one document; an empty table stays empty."""
    kept = line_dedup.dedup_lines(docs, keep=list(COLUMNS)).where((F.col("n_dropped") == 0) | (F.col("kept_text") != ""))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, 0.8 alike or more, one stays: that of the smallest id, or, where none has
    an id or some repeat it, of the smallest hash of its text. Of rows with one id and one text, one stays. Texts without
    words all stay, and an empty table stays empty."""
    found = jaccard.shingle_groups(docs, shingle=5, num=80, den=100).where("n > 0")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    found = materialize(found.groupBy("id", "mark").agg(F.min(own).alias("stays"), F.count(F.lit(1)).alias("rows")).where("rows > 1 or not stays"), "copies")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    same = lambda gone: docs["doc_id"].eqNullSafe(gone["id"]) & (mark == gone["mark"])
    kept = docs.join(found, same(found), "left_anti").select(*COLUMNS)
    twice = found.where("stays")
    if not twice.isEmpty():
        again = docs.join(twice, same(twice), "left_semi").withColumn("mark", mark)
        kept = kept.unionByName(again.dropDuplicates(["doc_id", "mark"]).select(*COLUMNS))
    return kept


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts have no words and stay; rows that repeat one another
    are judged alike; an empty table stays empty."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=list(COLUMNS))
    return found.where(F.size("items") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; n_tokens and digests of the ids and of the bytes that they decode to go along. Null and
    empty texts have no ids; every row has its own; an empty table stays empty."""
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], as_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "token_ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("byte BPE", encode),
]

#: SQL can express neither the classifier nor the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), "stage")
        remove(docs)  # the stage before, of which nothing is read any more
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
