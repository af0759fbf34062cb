"""Importance resampling towards a target distribution (operator 13), in DataFrame functions only.

Hashed n-gram features of all documents and of all target texts are counted in buckets. A bucket's gain is the logarithm
of the two smoothed shares; a document weighs the mean gain of its features. Gumbel noise from the document's id makes
the best of weight plus noise a draw without replacement, and one distributed sort ranks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.textcore import quoted, without
from quillstack.session import materialize, remove, table

#: Buckets; the most and the least words of a feature; words that a document must have to be drawn; share drawn, in per cent.
BUCKETS, LEAST_RUN, MOST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 1, 20, 10, "2024"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = (1 << 33) - 1


def words(text: Column) -> Column:
    """Runs of small ASCII letters, digits and anything beyond ASCII, after A-Z are lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _SMALL), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def features(w: Column, least: int = LEAST_RUN, most: int = MOST_RUN) -> Column:
    """All runs of `least` to `most` consecutive words, joined by one space, with repeats."""
    if most == 1:
        return w
    runs = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: i + (n - 1) <= F.size(w)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.concat(*[runs(n) for n in range(least, most + 1)])


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucketed(docs: DataFrame, text: str, keep: list[str], buckets: int, least: int, most: int) -> DataFrame:
    """The kept columns as `row`, n_words, and the buckets of all features."""
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("_")).alias("row")
    split = docs.select(row, words(quoted(text)).alias("w"))
    return split.select("row", F.size("w").alias("n_words"), F.transform(features(F.col("w"), least, most), lambda x: bucket(x, buckets)).alias("buckets"))


def counted(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how many features fall into each; at most as many rows as there are buckets."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain long): 1000 times the logarithm of the target's smoothed share over that of the documents, floored."""
    s, t = counted(docs, "s"), counted(target, "t")
    both = s.join(t, "bucket", "left").select("bucket", F.col("s").cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    totals = s.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t")))  # two single rows
    shares = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(shares)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the SHA-256 of seed and id; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` with `place` from 1 on by an order without ties: a range exchange, a sort of each part, and the parts' offsets.

    The parts are counted (one row a part); no row but these goes through one task.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_ROW)).alias("_row")).drop("_at"), "sorted")
    parts = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    offsets = parts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))  # a row a part
    return sorted_.join(F.broadcast(offsets), "_part").withColumn("place", F.col("before") + F.col("_row") + 1).drop("_part", "_row", "before")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None,
    buckets: int = BUCKETS, least: int = LEAST_RUN, most: int = MOST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """`keep` columns (all by default) with n_features, weight, score and rank (long); rank is null for what isn't drawn.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) of the highest scores are drawn; ties go to
    the smaller id, nulls first, and equal ids to any. Null and empty texts have no features, weigh 0 and count in no
    bucket; texts of any length are read whole; repeated rows keep their rows and are counted and ranked each. Without
    target texts all gains compare with an even distribution; an empty table stays empty. Columns with the names of new
    ones, in either case, give way to them; `doc_id` itself need not be kept.
    """
    new = ["n_features", "weight", "score", "rank"]
    keep = without(docs.columns if keep is None else keep, new)
    rows = bucketed(docs.withColumn("_id", quoted(doc_id)), text, ["_id", *keep], buckets, least, most)
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "buckets")  # written, so that `at` stays as it is
    wanted = materialize(gains(rows, bucketed(target, target_text, [], buckets, least, most), buckets), "gains", buckets)
    sums = rows.select("at", F.explode("buckets").alias("bucket")).join(F.broadcast(wanted), "bucket").groupBy("at").agg(F.sum("gain").alias("total"))  # a row a bucket
    n = F.size("buckets")
    weighed = rows.select("at", "row", n.cast("long").alias("n_features"), (F.col("n_words") >= least_words).alias("able")).join(sums, "at", "left")
    exact = F.expr("(total - pmod(total, n_features)) div n_features")  # of integers, towards minus infinity
    scored = weighed.select("at", "row", "n_features", "able", F.when(F.col("n_features") > 0, exact).otherwise(F.lit(0)).cast("long").alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("row.c0"), seed)).withColumn("id", F.col("row.c0"))
    placed = ranked(scored, F.desc("able"), F.desc("score"), F.asc_nulls_first("id"), F.asc("at"))
    drawn = rows.agg(F.floor(F.count_if(F.col("n_words") >= least_words) * percent / 100).alias("drawn"))
    out = placed.crossJoin(F.broadcast(drawn))  # one row
    rank = F.when(F.col("able") & (F.col("place") <= F.col("drawn")), F.col("place")).cast("long")
    return out.select(*[F.col(f"row.c{i + 1}").alias(c) for i, c in enumerate(keep)], "n_features", "weight", "score", rank.alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
