"""The corpus as tables: documents, line chunks with labels and history, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.session import table

#: Embedding model of the corpus: id and version.
MODEL = ("fixture", "1")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, source, external_id, title, url, text, acl, sensitivity, authoritative."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.concat_ws(":", "source", "doc_id")
    acl = F.when(F.col("lang") == "fr", F.array(F.lit("role:fr"))).when(F.col("lang") == "de", F.array(F.lit("role:de"))).when(F.col("lang") == "es", F.array(F.lit("user:ana"))).otherwise(F.array().cast("array<string>"))
    sensitivity = F.when(F.col("toxic") == 1, "confidential").when(F.col("quality").isNull() | (F.col("quality") == 0), "internal").otherwise("public")
    return docs.join(labels, "doc_id", "left").select(
        key.alias("document_id"), "source", F.col("doc_id").cast("string").alias("external_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), key.alias("url"),
        "text", acl.alias("acl"), sensitivity.alias("sensitivity"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("authoritative"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line with text, numbered densely from 0: id, document_id, ordinal, heading, title, url, text, labels.

    Lines are filtered within the row, so numbering needs no shuffle.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = documents(spark, sf_dir).select("document_id", "source", "title", "url", "acl", "sensitivity", "authoritative", F.posexplode(lines).alias("ordinal", "text"))
    return rows.select(F.concat(F.col("document_id"), F.lit("#l"), F.col("ordinal").cast("string")).alias("id"), F.col("ordinal").cast("long").alias("ordinal"), F.lit(None).cast("string").alias("heading"), *[c for c in rows.columns if c != "ordinal"])


def chunk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with an older version, superseded, of every fifth of a document; older ones were made with another model."""
    now = chunks(spark, sf_dir).withColumn("version", F.sha2("text", 256)).withColumn("superseded", F.lit(False)).withColumn("model", F.lit(MODEL[0]))
    old = now.where("ordinal % 5 = 0").withColumn("text", F.concat("text", F.lit(" (old)")))
    old = old.withColumn("version", F.sha2("text", 256)).withColumn("superseded", F.lit(True)).withColumn("model", F.lit("older"))
    return now.unionByName(old)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


#: The same views for DuckDB.
SQL = """docs AS (
 SELECT d.source || ':' || d.doc_id AS document_id, d.source, d.doc_id::VARCHAR AS external_id, 'Document ' || d.doc_id AS title, d.source || ':' || d.doc_id AS url, d.text,
  CASE d.lang WHEN 'fr' THEN ['role:fr'] WHEN 'de' THEN ['role:de'] WHEN 'es' THEN ['user:ana'] ELSE []::VARCHAR[] END AS acl,
  CASE WHEN l.toxic = 1 THEN 'confidential' WHEN l.quality IS NULL OR l.quality = 0 THEN 'internal' ELSE 'public' END AS sensitivity,
  coalesce(l.quality = 1, false) AS authoritative
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
lined AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM docs),
numbered AS (SELECT * EXCLUDE (text, lines), unnest(lines) AS text, unnest(range(len(lines))) AS ordinal FROM lined),
chunks AS (SELECT document_id || '#l' || ordinal AS id, ordinal, NULL::VARCHAR AS heading, document_id, source, title, url, acl, sensitivity, authoritative, text FROM numbered),
history AS (
 SELECT *, sha256(text) AS version, false AS superseded, 'fixture' AS model FROM chunks
 UNION ALL SELECT * EXCLUDE (text), text || ' (old)' AS text, sha256(text || ' (old)'), true, 'older' FROM chunks WHERE ordinal % 5 = 0),
questions AS (SELECT item_id AS qid, text AS question FROM benchmark)"""
