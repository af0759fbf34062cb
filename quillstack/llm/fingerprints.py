"""Document fingerprints: bottom-k sketches of shingle hashes (operator 2), in DataFrame functions only.

A sketch is the K smallest of the distinct hashes of a text's five-word shingles, 52 bits each, in ascending order.
Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance, containment and the
number of distinct shingles; a sketch of fewer than K hashes is the whole set, and its answers are exact.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.textcore import quoted
from quillstack.session import table

#: Hashes of a sketch, words of a shingle, bits of a hash and hexadecimal digits of one.
K, SHINGLE, BITS, DIGITS = 128, 5, 52, 13
#: Ranges of ids that texts are dealt into to meet their next text: at least, bytes of text in each beyond that, at most.
RANGES, RANGE_BYTES, MOST_RANGES = 512, 1 << 26, 1 << 16


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Sketch of a text, array<long>. Words are lower-cased runs without white space; fewer than a shingle are one
    shingle; without words, and for null, it is empty."""
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))
    short = lambda h: F.shiftrightunsigned(h, 64 - BITS)

    def shingles(w: Column) -> Column:
        runs = F.transform(F.slice(w, 1, F.size(w) - shingle + 1), lambda h, i: short(F.xxhash64(h, *[F.get(w, i + j) for j in range(1, shingle)])))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < shingle, F.array(short(F.xxhash64(w)))).otherwise(runs)

    def smallest(h: Column) -> Column:
        # Of many hashes few can be among the k smallest: those under a bound, if it leaves k of them.
        bound = F.lit(float(2**BITS) * 3 * k) / F.size(h)
        low = lambda x: F.slice(F.sort_array(F.array_distinct(x)), 1, k)
        under = lambda x: F.when(F.size(x) == k, x).otherwise(low(h))
        return F.when(F.size(h) < 6 * k, low(h)).otherwise(_let(low(F.filter(h, lambda x: x < bound)), under))

    return _let(_let(words, shingles), smallest)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """Sketch of all rows of each group; each task ranks its own hashes before the shuffle. Nulls are empty."""
    hashes = sketches.select(*by, F.explode_outer(column).alias("_h")).distinct()
    ranked = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("_h")))).where(F.col("_n") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles, 0 to 1. Two empty sketches are alike (1); an empty and another aren't (0)."""

    def likeness(whole: Column) -> Column:
        both = F.array_intersect(F.array_intersect(whole, a), b)
        return F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(F.size(both).cast("double") / F.greatest(F.size(whole), F.lit(1)))

    union = F.array_union(a, b)
    return _let(F.when((F.size(a) < k) & (F.size(b) < k), union).otherwise(F.slice(F.sort_array(union), 1, k)), likeness)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = (F.element_at(a, -1) + 1).cast("double") / float(2**BITS)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; null for an empty a."""
    whole = distinct_shingles(merge(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), whole / distinct_shingles(a, k)))


def encode(a: Column) -> Column:
    """A sketch as text: DIGITS lowercase hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), "")


def decode(text: Column) -> Column:
    starts = F.sequence(F.lit(0), (F.length(text) / DIGITS).cast("int") - 1)
    hashes = F.transform(starts, lambda i: F.conv(F.substring(text, (i * DIGITS + 1).cast("int"), F.lit(DIGITS)), 16, 10).cast("long"))
    return F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(hashes)


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the value: first among every 256th, then in the 256 after it."""
    runs = [bounds[i : i + 256] for i in range(0, len(bounds), 256)]
    heads, runs = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>"), F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    under = lambda of: F.size(F.filter(of, lambda b: b <= value))
    return _let(under(heads), lambda n: F.when(n == 0, F.lit(0)).otherwise((n - 1) * 256 + under(F.get(runs, n - 1))))


def with_next(docs: DataFrame, doc_id: str, value: str, ranges: int | None = None, add=lambda df: df, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each row's next row by descending id: `value` and `carried` of it as next_<name>; after the last: the first.

    Ids are cut into `ranges` at their quantiles, as many as the bytes of `value` ask for. The first row of a range is
    also sent to the range before, as an end mark, so that no range needs another one and no task gets all rows. `add`
    adds columns after the exchange. Rows without an id come last, in ranges of the hashes of their values; rows that
    share an id go by the hash of their value.
    """
    spark = docs.sparkSession
    size, without_id = docs.agg(F.sum(F.octet_length(value)), F.count_if(F.col(doc_id).isNull())).first()
    ranges = ranges or min(MOST_RANGES, max(RANGES, (size or 0) // RANGE_BYTES))
    bounds = docs.agg(F.percentile_approx(doc_id, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []  # `ranges` ids
    block = _range_of(F.col(doc_id), sorted(set(bounds))) if bounds else F.lit(0)
    order = F.col(doc_id)
    if without_id:  # their ranges go down from -1
        bits = max(1, ranges.bit_length() - 1)
        place = F.xxhash64(value)
        block = F.when(order.isNull(), -1 - (F.shiftright(place, 64 - bits) + 2 ** (bits - 1)).cast("int")).otherwise(block)
        order = F.coalesce(order, place)
    rows = docs.withColumn("_block", block).withColumn("_order", order)
    first = F.when(F.col("_block") < 0, F.min("_order")).otherwise(F.max("_order"))
    tops = sorted(((r["_block"], r["top"]) for r in rows.groupBy("_block").agg(first.alias("top")).collect()), reverse=True)  # one a range
    kind = "_top long, _none boolean, _before int"
    marks = spark.createDataFrame([(top, at < 0, tops[i - 1][0]) for i, (at, top) in enumerate(tops)], kind)
    same = (F.col("_order") == F.col("_top")) & ((F.col("_block") < 0) == F.col("_none"))
    rows = rows.join(F.broadcast(marks), same, "left").drop("_top", "_none", "_order")  # at most two for each range
    places = F.array(F.struct(F.col("_block").alias("at"), F.lit(0).alias("mark")), F.struct(F.col("_before").alias("at"), F.lit(1).alias("mark")))
    rows = rows.select("*", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("_p")).withColumn("_at", F.col("_p.at")).withColumn("_mark", F.col("_p.mark")).drop("_block", "_before", "_p")
    n = max(1, min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = add(rows.repartition(n, "_at"))
    order = Window.partitionBy("_at").orderBy("_mark", F.desc_nulls_last(doc_id), F.xxhash64(value), value)
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in (value, *carried)])
    return rows.where("_mark = 0").drop("_at", "_mark")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next text.

    The edited text ends in the beginning of the next text by descending id, half of the code points long. Null
    texts are empty. Other columns are not read. Rows without an id come after all others; rows that share an id
    each have a next row. A single row is next to itself; an empty table stays empty. Two texts without words have
    a likeness of 1. `n_distinct` is the estimated number of the text's shingles, `held_edited` the estimated share of
    them that the edited text holds (null without words). Texts of any length count whole.
    """
    slim = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    pairs = with_next(slim, "doc_id", "text", add=lambda df: df.withColumn("sketch", sketch(F.col("text"))), carried=("sketch",))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "sketch", "next_sketch")
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited")))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encode(F.col("sketch")).alias("fingerprint"), encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_distinct"), containment(F.col("sketch"), F.col("edited_sketch")).alias("held_edited"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
