"""Language-model scores by Brown classes (operator 8).

Counts of all words of the training texts are gathered by word. Exchange clustering runs over the most frequent
words, whose number grows with the vocabulary as that of the classes does; every other word takes the class that fits
the classes beside its own occurrences best. A text's probability is the product of class transitions and of word
emissions in their classes. Frequent words have their counts and classes in a broadcast of fixed size; the others
meet theirs in a join, for the table of transitions as well as for the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.textcore import SPACED, Words, map_texts, quoted, slices, small_batches, text_buffers, without
from quillstack.session import materialize, table

_U = np.uint64
#: Words with broadcast counts, at most; types that are clustered by exchange, the end among them, and classes, at least.
HEAD, TOP, CLASSES = 1 << 17, 768, 32
#: Added to word counts and to transition counts.
EMIT, MOVE = 1.0, 0.1
_END = _U(0x5EED0FE17D0C0DE5)


def sizes(distinct: int) -> tuple[int, int]:
    """Types that exchange clusters and classes, for a vocabulary of so many words."""
    types = max(TOP, int(4 * distinct**0.4))
    return types, max(CLASSES, int(types**0.5))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the texts' offsets."""
    words = Words(*text_buffers(batch.column(batch.num_columns - 1)), SPACED)
    return np.insert(words.hash, words.doc[1:], _END), words.doc + np.arange(len(words.doc))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 0, 3_000_000):
            word, n = np.unique(_tokens(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


@dataclass
class Vocabulary:
    """Head words in order of their hashes, the end always among them, with counts and types (-1: none yet)."""

    word: np.ndarray
    n: np.ndarray
    kind: np.ndarray

    @classmethod
    def of(cls, head: pa.Table) -> Vocabulary:
        word, n = (head.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
        word = word.view(_U)
        if _END not in word:
            word, n = np.append(word, _END), np.append(n, 0)
        order = np.argsort(word)
        return cls(word[order], n[order], np.arange(len(word)))

    def ranked(self, types: int) -> Vocabulary:
        """The most frequent words as types 1 and on, the end as type 0."""
        kind = np.full(len(self.word), -1)
        rank = np.lexsort((self.word, -self.n))
        rank = rank[self.word[rank] != _END][: types - 1]
        kind[rank] = 1 + np.arange(len(rank))
        kind[self.word == _END] = 0
        return Vocabulary(self.word, self.n, kind)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Places of words in the head; -1 for those it lacks."""
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at, -1)

    def kinds(self, h: np.ndarray) -> np.ndarray:
        at = self.look_up(h)
        return np.where(at >= 0, self.kind[at], -1)


def _before(c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What stands before each token; the end (0) stands before each text."""
    before = np.zeros(len(c), c.dtype)
    before[1:] = c[:-1]
    before[offsets[:-1]] = 0
    return before


def _each(work):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 3_000_000):
                yield work(*_tokens(batch))

    return run


def _moves(held, types: int):
    def work(h, offsets):
        kind = held.value.kinds(h)
        before = _before(kind, offsets)
        pair, n = np.unique((before * types + kind)[(kind >= 0) & (before >= 0)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return _each(work)


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    left, i = np.unique(a, return_inverse=True)
    right, j = np.unique(b, return_inverse=True)
    key, n = np.unique(i * max(len(right), 1) + j, return_counts=True)
    return left[key // max(len(right), 1)], right[key % max(len(right), 1)], n


def _beside(h: np.ndarray, c: np.ndarray, before: np.ndarray, classes: int):
    """(word, slot, n) of words without a class: slots are classes before it and, from `classes` on, after it."""
    rare = np.flatnonzero(c < 0)  # never the end, so a token follows
    after = c[rare + 1]
    word, slot = np.concatenate([h[rare], h[rare]]), np.concatenate([before[rare], np.where(after >= 0, classes + after, -1)])
    return _counted(word[slot >= 0], slot[slot >= 0])


def _sides(held, classes: int):
    def work(h, offsets):
        c = held.value.kinds(h)
        word, slot, n = _beside(h, c, _before(c, offsets), classes)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(slot.astype(np.int32)), pa.array(n)], names=["word", "slot", "n"])

    return _each(work)


def _turns(held, classes: int):
    """Transitions: by classes (word null); of a word outside the head and a class (slot); of two such words (other)."""

    def work(h, offsets):
        c = held.value.kinds(h)
        before = _before(c, offsets)
        pair, n = np.unique((before * classes + c)[(c >= 0) & (before >= 0)], return_counts=True)
        word, slot, m = _beside(h, c, before, classes)
        at = np.flatnonzero((c < 0) & (before < 0))
        a, b, k = _counted(h[at - 1], h[at])
        long = lambda x: pa.array(x.view(np.int64))
        none = lambda x, kind: pa.nulls(len(x), kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([none(pair, pa.int64()), long(word), long(a)]), pa.concat_arrays([none(pair, pa.int64()), none(word, pa.int64()), long(b)]),
                pa.concat_arrays([pa.array(pair.astype(np.int32)), pa.array(slot.astype(np.int32)), none(a, pa.int32())]), pa.array(np.concatenate([n, m, k])),
            ],
            names=["word", "other", "slot", "n"],
        )

    return _each(work)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(moves: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each type: types move to the class with the highest likelihood of the class bigrams until none does.

    Type 0, the end, keeps class 0 to itself. Each move raises the likelihood by more than rounding can, so it ends.
    """
    i, j = np.nonzero(moves)
    return _exchange(i, j, moves[i, j].astype(np.float64), len(moves), classes)


def _exchange(i: np.ndarray, j: np.ndarray, count: np.ndarray, size: int, classes: int) -> np.ndarray:
    """exchange() of `count` bigrams of types `i` and `j`, each pair once."""
    total = np.bincount(i, count, size) + np.bincount(j, count, size)
    order = np.argsort(-total, kind="stable")
    order = order[(order != 0) & (total[order] > 0)]
    own = np.zeros(size, np.int64)
    own[1:] = 1 + np.arange(size - 1) % (classes - 1)
    own[order] = 1 + np.arange(len(order)) % (classes - 1)
    same = np.zeros(size)
    same[i[i == j]] = count[i == j]
    rows, columns = np.argsort(i, kind="stable"), np.argsort(j, kind="stable")
    after, n_after, from_ = j[rows], count[rows], np.searchsorted(i[rows], np.arange(size + 1))
    before, n_before, into_ = i[columns], count[columns], np.searchsorted(j[columns], np.arange(size + 1))
    n = np.bincount(own[i] * classes + own[j], count, classes * classes).reshape(classes, classes)
    least = 1e-9 + 1e-13 * _f(count.sum())
    moved = True
    while moved:
        moved = False
        for w in order:
            a, s = own[w], same[w]
            # Moves to itself count by the word alone, so they are taken out and put in apart.
            right = np.bincount(own[after[from_[w] : from_[w + 1]]], n_after[from_[w] : from_[w + 1]], classes)
            left = np.bincount(own[before[into_[w] : into_[w + 1]]], n_before[into_[w] : into_[w + 1]], classes)
            right[a] -= s
            left[a] -= s
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= s
            r, q = np.flatnonzero(right), np.flatnonzero(left)
            gain = (_f(n[:, r] + right[r]) - _f(n[:, r])).sum(1) + (_f(n[q] + left[q, None]) - _f(n[q])).sum(0)
            d = np.diag(n)
            gain += _f(d + right + left + s) - _f(d + right) - _f(d + left) + _f(d)
            out, into = n.sum(1) + left, n.sum(0) + right  # these come back wherever the word goes
            gain -= _f(out + right.sum() + s) - _f(out) + _f(into + left.sum() + s) - _f(into)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            moved |= b != a
            own[w] = b
            n[b] += right
            n[:, b] += left
            n[b, b] += s
    return own


def _fitting(n: np.ndarray):
    """(word, class): the likeliest class of words by (word, seen array<struct<slot, n>>) against class bigrams `n`."""
    m = n + MOVE
    after, before = np.log(m / m.sum(1, keepdims=True)).T, np.log(m / m.sum(0))
    fit_ = np.concatenate([before, after])
    fit_[:, 0] = -1e18  # the end's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                seen = batch.column(1)
                cuts = seen.offsets.to_numpy() - seen.offsets[0].as_py()
                slot, times = (x.to_numpy(zero_copy_only=False) for x in seen.flatten().flatten())
                value = np.add.reduceat(fit_[slot] * times[:, None], cuts[:-1])  # no list is empty
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value.argmax(1).astype(np.int32))], names=["word", "class"])

    return run


@dataclass
class Model:
    """Logarithms, base ten: of class transitions, and of what word counts are divided by in each class.

    `own` has the classes of the vocabulary's types, each head word one of its own; `other` is the class of new words.
    """

    vocabulary: Vocabulary
    own: np.ndarray
    move: np.ndarray
    under: np.ndarray
    tokens: int
    distinct: int
    other: int


def fit(texts: DataFrame, head: int = HEAD, types: int | None = None, classes: int | None = None) -> tuple[Model, DataFrame]:
    """The model of the column `text`, and the counts (word, n, class) of all its words. Counts cover all rows.

    `types` words are clustered by exchange into `classes` (by default as `sizes` says); as many types as there are words
    cluster the whole vocabulary, and the head is then as large. The bigrams of types, at most as many as types squared
    or tokens, go to the driver, which exchanges.
    Words that stand beside no clustered word, and new ones, take the class of the most words outside the clustering.
    """
    spark = texts.sparkSession
    small_batches(spark)
    send = spark.sparkContext.broadcast
    counts = materialize(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head, usual = max(head, types or 0), sizes(distinct)
    types, classes = min(types, distinct + 1) if types else usual[0], classes or usual[1]
    step = F.floor(F.log2("n") * 64)  # counts below 92 each have a step of their own
    least, room = 2**62, head
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 64 * 63 rows
        if (room := room - r["count"]) < 0:
            break
        least = r["step"]
    in_head = (step >= least) | (F.col("word") == int(_END.view(np.int64)))
    vocabulary = Vocabulary.of(counts.where(in_head).toArrow()).ranked(types)  # at most `head` rows and the end

    pairs = texts.mapInArrow(_moves(send(vocabulary), types), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    i, j = np.divmod(pairs.column("pair").to_numpy().astype(np.int64), types)
    n = pairs.column("n").to_numpy().astype(np.float64)
    of_type = _exchange(i, j, n, int(vocabulary.kind.max()) + 1, classes)
    table_ = np.bincount(of_type[i] * classes + of_type[j], n, classes * classes).reshape(classes, classes)
    clustered = vocabulary.kind >= 0
    vocabulary = Vocabulary(vocabulary.word, vocabulary.n, np.where(clustered, of_type[vocabulary.kind], -1))

    # One exchange by word: runs of texts are counted already, and both groupings and the classes need it alone.
    sides = texts.mapInArrow(_sides(send(vocabulary), classes), "word long, slot int, n long").repartition("word")
    seen = sides.groupBy("word", "slot").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("seen"))
    fitted = materialize(seen.mapInArrow(_fitting(table_), "word long, class int"), "fitted")
    by = sorted(fitted.groupBy("class").count().collect(), key=lambda r: (-r["count"], r["class"]))
    other = by[0]["class"] if by else 1
    named = spark.createDataFrame(pa.table({"word": vocabulary.word[clustered].view(np.int64), "class": vocabulary.kind[clustered].astype(np.int32)}))
    counts = materialize(counts.join(fitted.unionByName(named), "word", "left").select("word", "n", F.coalesce("class", F.lit(other)).alias("class")), "classes")

    of_head = counts.where(in_head).toArrow()
    vocabulary = Vocabulary.of(of_head)
    own = np.zeros(len(vocabulary.word), np.int64)
    own[vocabulary.look_up(of_head.column("word").to_numpy().astype(np.int64).view(_U))] = of_head.column("class").to_numpy()
    n = _transitions(texts, Vocabulary(vocabulary.word, vocabulary.n, own), counts, classes)
    move = np.log10((n + MOVE) / (n + MOVE).sum(1, keepdims=True))
    under = np.full(classes, EMIT)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        under[r["class"]] = r["n"] + EMIT * (r["words"] + 1)
    return Model(vocabulary, own, move, np.log10(under), tokens, distinct, other), counts


def _transitions(texts: DataFrame, vocabulary: Vocabulary, counts: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams of all tokens, those of words outside the head by joins."""
    turns = texts.mapInArrow(_turns(texts.sparkSession.sparkContext.broadcast(vocabulary), classes), "word long, other long, slot int, n long")
    turns = materialize(turns, "turns")
    kinds = counts.select("word", "class")
    n = np.zeros((classes, classes))
    for r in turns.where("word is null").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        n[divmod(r["slot"], classes)] += r["n"]
    one = turns.where("word is not null and other is null").join(kinds, "word")
    for r in one.groupBy("class", "slot").agg(F.sum("n").alias("n")).collect():
        n[(r["slot"], r["class"]) if r["slot"] < classes else (r["class"], r["slot"] - classes)] += r["n"]
    two = turns.where("other is not null").join(kinds, "word").select(F.col("class").alias("first"), F.col("other").alias("word"), "n").join(kinds, "word")
    for r in two.groupBy("first", "class").agg(F.sum("n").alias("n")).collect():
        n[r["first"], r["class"]] += r["n"]
    return n


def _local(model):
    """What a text's probability has without the words outside the head, and those words with the classes beside them."""

    def work(batch: pa.RecordBatch) -> list:
        m = model.value
        h, offsets = _tokens(batch)
        at = m.vocabulary.look_up(h)
        n, c = np.where(at >= 0, m.vocabulary.n[at], 0), np.where(at >= 0, m.own[at], -1)
        before = _before(c, offsets)
        part = np.where(c >= 0, np.log10(n + EMIT) - m.under[c], 0) + np.where((c >= 0) & (before >= 0), m.move[before, c], 0)
        total = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        rare = np.flatnonzero(c < 0)
        ends = np.searchsorted(rare, offsets)
        rows = pa.StructArray.from_arrays([pa.array(x) for x in (h[rare].view(np.int64), rare.astype(np.int32), before[rare].astype(np.int32), c[rare + 1].astype(np.int32))], ["word", "place", "before", "after"])
        rows = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)
        return [np.diff(offsets), total((n > 0).astype(np.int64)), total(part), total(np.log10(n + 1.0)), rows]

    return work


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with n_tokens, n_known long, base_score and score double (log10).

    A null or empty text is its end alone. Equal texts have equal scores up to rounding; repeated rows keep their
    rows; texts of any length are scored whole; an empty table stays empty. Columns with the names of new ones, in
    either case, give way to them.
    """
    new = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    keep = without(docs.columns if keep is None else keep, new)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("_")).alias("row"), F.monotonically_increasing_id().alias("at"), quoted(text).alias("txt"))
    out = "n_tokens long, head long, part double, base double, rare array<struct<word: long, place: int, before: int, after: int>>"
    rows = materialize(map_texts(rows, "txt", ["row", "at"], out, lambda: _local(held)), "parts")
    rare = rows.select("at", F.explode("rare").alias("r")).select("at", "r.*").join(counts.select("word", "n", "class"), "word", "left")
    rare = rare.select("at", "place", "before", "after", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(model.other)).alias("class"))
    # A word outside the head right before this one is the row before it.
    first = F.when(F.col("before") < 0, F.lag("class").over(Window.partitionBy("at").orderBy("place"))).otherwise(F.col("before"))
    rare = rare.withColumn("before", first)
    tables = docs.sparkSession.createDataFrame([(model.move.ravel().tolist(), model.under.tolist())], "move array<double>, under array<double>")
    move = lambda a, b: F.get("move", F.col(a) * len(model.under) + F.col(b))
    part = F.log10(F.col("n") + EMIT) - F.get("under", F.col("class")) + move("before", "class") + F.when(F.col("after") >= 0, move("class", "after")).otherwise(0.0)
    rare = rare.crossJoin(F.broadcast(tables)).select("at", "n", part.alias("part"))  # tables: one row
    rare = rare.groupBy("at").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_base"), F.sum("part").alias("rare_part"), F.sum(F.when(F.col("n") > 0, 1)).alias("rare_known"))
    none = lambda c: F.coalesce(c, F.lit(0))
    under = float(np.log10(model.tokens + model.distinct + 1))
    done = rows.drop("rare").join(materialize(rare, "rare"), "at", "left").select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", (F.col("head") + none("rare_known")).cast("long").alias("n_known"),
        (F.col("base") + none("rare_base") - under * F.col("n_tokens")).alias("base_score"), (F.col("part") + none("rare_part")).alias("score"),
    )
    return done.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text modulo `by`; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % by, F.lit(0))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    model, counts = fit(docs.where(~F.col("held_out")).select(F.coalesce("text", F.lit("")).alias("text")))
    scored = score_texts(docs, model, counts, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
