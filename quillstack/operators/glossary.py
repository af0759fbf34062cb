"""Glossary entries that questions name, and the terms they add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = r"[^\p{IsAlphabetic}\p{N}]+"


def words(text: str) -> Column:
    """The lower-cased words of a question; those with an ASCII digit are identifiers and are left out."""
    return F.transform(F.filter(F.split(text, _PARTS), lambda x: (x != "") & ~x.rlike("[0-9]")), F.lower)


def match(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, entry, matched): entries with a key that the question holds, and the first such key.

    An entry's keys are its phrases, then its acronyms. Runs of a question's words, of just the lengths that the phrases
    have, meet the phrases in an equal join. Acronyms meet the question's words of two capitals or more and no more
    small letters, whatever the case of either.
    """
    # One row: as many numbers as phrases have different lengths.
    lengths = entries.select(F.explode("phrases").alias("p")).where("p <> ''").agg(F.collect_set(F.size(F.split("p", " "))).alias("lengths"))
    rows = questions.select("qid", "question", words("question").alias("w")).crossJoin(F.broadcast(lengths))
    runs = F.flatten(F.transform("lengths", lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    count = lambda x, kind: F.char_length(F.regexp_replace(x, f"[^\\p{{{kind}}}]", ""))
    short = F.filter(F.split("question", _PARTS), lambda x: (count(x, "Lu") >= 2) & (count(x, "Lu") >= count(x, "Ll")))
    asked = rows.select("qid", F.explode(F.concat(F.transform(runs, lambda x: F.struct(F.lit("phrase").alias("kind"), x.alias("key"))), F.transform(short, lambda x: F.struct(F.lit("acronym").alias("kind"), F.lower(x).alias("key"))))).alias("k"))
    asked = asked.select("qid", "k.*").distinct()
    named = lambda name, kind, first: F.transform(name, lambda x, i: F.struct((i + first).alias("place"), F.lit(kind).alias("kind"), F.lower(x).alias("key")))
    keys = entries.select("entry", F.inline(F.concat(named("phrases", "phrase", F.lit(0)), named("acronyms", "acronym", F.size("phrases")))))
    return asked.join(keys, ["kind", "key"]).groupBy("qid", "entry").agg(F.min_by("key", "place").alias("matched"))


def expand(questions: DataFrame, entries: DataFrame, most: int = 16) -> DataFrame:
    """(qid, terms, expanded): the first `most` unseen terms of the matched entries in register order, after the question."""
    hits = match(questions, entries).select("qid", "entry")
    added = hits.join(entries.select("entry", F.posexplode("terms").alias("place", "term")), "entry").groupBy("qid", "term").agg(F.min(F.struct("entry", "place")).alias("first"))
    added = added.join(questions.select("qid", words("question").alias("own")), "qid").where(~F.array_contains("own", F.col("term")))
    kept = added.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).where(F.col("n") <= most)
    terms = kept.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("t")).select("qid", F.transform("t", lambda x: x["term"]).alias("terms"))
    found = F.coalesce("terms", F.array().cast("array<string>"))
    return questions.join(terms, "qid", "left").select("qid", found.alias("terms"), F.when(F.size(found) > 0, F.concat_ws(" ", "question", F.array_join(found, " "))).otherwise(F.col("question")).alias("expanded"))
