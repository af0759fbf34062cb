"""Byte-level BPE encoding and decoding (operator 1).

A run of documents is split into words by the vocabulary's pattern and its distinct words become one array of byte
arrays. Spark higher-order functions then fold the ranked merges over each of them, with the ranks as a literal,
and look the ids' bytes up for decoding. Documents are put together from the ids and bytes of their words. Runs are
bounded in bytes, so nothing is shuffled and no vocabulary of words is gathered anywhere.

The literal says, for each two tokens whose bytes together are a token, that token's rank. It is a sparse table
with displaced rows: the entry of (a, b) is at place shift[a] + b, where owner[place] = a + 1 says that it is there.
"""

from __future__ import annotations

import base64
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.textcore import quoted, release, slices, small_batches, without
from quillstack.session import materialize, remove, table

#: Text of one run of documents.
RUN_BYTES = 2_000_000
#: Bytes of a piece of a word that is longer. The fold takes time in the square of its word, so long words are folded
#: in pieces and joined afterwards.
PIECE_BYTES = 256
#: Words encoded ahead of all runs, at most, and rows among which they are looked for, about.
AHEAD_WORDS, AHEAD_DOCS = 1 << 18, 1 << 14
_NONE, _REST = 2**31 - 1, 2**30


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """The literals of a rank file, and the tokens that their own bytes don't merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        rows: dict[int, dict[int, int]] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    rows.setdefault(a, {})[b] = rank
        size = 1 << max(8, int(4 * sum(map(len, rows.values())) + 2 * top).bit_length() - 1)
        shift, owner, value, draw = np.zeros(top, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), random.Random(7)
        for a in sorted(rows, key=lambda a: -len(rows[a])):
            columns = np.array(sorted(rows[a]))
            at = columns
            while owner[at].any() or not shift[a]:
                shift[a] = draw.randrange(1, size - top)
                at = columns + shift[a]
            owner[at], value[at] = a + 1, [rows[a][c] for c in columns.tolist()]
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.shift, self.owner, self.value = (x.astype(np.int32) for x in (shift, owner, value))
        self.single, self.tokens = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32), tokens
        self.apart = {token: rank for token, rank in ranks.items() if _folded(token, ranks) != [rank]}


def _folded(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold in Python: for the vocabulary's own tokens, and for a few bytes around a cut."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        least, at = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if least == _NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


def _fits(a: bytes, b: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether two tokens stay as they are when they stand side by side. Ids of a text are those of its encoding if and
    only if each two neighbours fit."""
    return _folded(a + b, ranks) == [ranks[a], ranks[b]]


def join_pieces(pieces: list[list[int]], tokens: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word from those of its pieces: around each cut as many tokens are encoded anew as it takes for the
    neighbours to fit, so the work for a cut doesn't grow with the word."""
    out: list[int] = []
    for ids in pieces:
        if not out or not ids:
            out += ids
            continue
        n = 0
        while True:
            left, right = max(0, len(out) - n), min(n, len(ids))
            middle = _folded(b"".join(tokens[i] for i in [*out[left:], *ids[:right]]), ranks)
            row = [*out[left - 1 : left], *middle, *ids[right : right + 1]] if left else [*middle, *ids[right : right + 1]]
            edges = [(row[0], row[1]), (row[-2], row[-1])] if len(row) > 1 else []
            if all(_fits(tokens[a], tokens[b], ranks) for a, b in edges):
                break
            n = max(1, 2 * n)
        out[left:] = [*middle, *ids[right:]]
    return out


@cache
def merges(path: str) -> Merges:
    return Merges(read_ranks(path))


def _let(value: Column, body) -> Column:
    """Evaluate `value` once for all its uses in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(spark: SparkSession, path: str) -> Column:
    """The merges of a rank file as one value: shift, owner, value and single (ids of the bytes), and the tokens by id.

    It is given as a scalar, which Spark puts into the plan as a literal of packed arrays when the query starts. Written
    out in the plan itself, the text of each plan would hold it, several times over.
    """
    known = merges(path)
    parts = {x: pa.array(getattr(known, x), pa.int32()) for x in ("shift", "owner", "value", "single")} | {"tokens": pa.array(known.tokens, pa.binary())}
    value = pa.StructArray.from_arrays([_one(x) for x in parts.values()], list(parts))
    return spark.createDataFrame(pa.table({"merges": value})).scalar()


def encode_word(word: Column, table: Column, path: str) -> Column:
    """Token ids, array<int>, of a word's bytes (array<int>): the lowest rank merges first, the leftmost of equals.

    `table` is literal(spark, path), bound once for all the words.
    """

    def rank(a: Column, b: Column) -> Column:  # beyond the ends a or b is null, and there is no rank
        place = F.get(table["shift"], a) + b
        return F.when(F.get(table["owner"], place) == a + 1, F.get(table["value"], place)).otherwise(F.lit(_NONE))

    # The state is the pieces and the ranks: of each piece joined to the next, with none before and after all.
    def merge(s: Column, _: Column) -> Column:
        pieces, ranks = s["pieces"], s["ranks"]

        def at(k: Column) -> Column:
            new = F.get(ranks, k)
            fewer = F.transform(F.filter(pieces, lambda _, i: i != k), lambda p, i: F.when(i == k - 1, new).otherwise(p))
            left, right = rank(F.get(pieces, k - 2), new), rank(new, F.get(pieces, k + 1))
            around = F.transform(F.filter(ranks, lambda _, i: i != k), lambda r, i: F.when(i == k - 1, left).when(i == k, right).otherwise(r))
            return F.when(new == _NONE, s).otherwise(F.struct(fewer.alias("pieces"), around.alias("ranks")))

        return _let(F.array_position(ranks, F.array_min(ranks)).cast("int") - 1, at)

    def fold(pieces: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: rank(F.get(pieces, i - 1), F.get(pieces, i)))
        return F.aggregate(F.slice(pieces, 2, _REST), F.struct(pieces.alias("pieces"), pairs.alias("ranks")), merge, lambda s: s["pieces"])

    ids = F.when(F.size(word) == 0, F.array().cast("array<int>")).otherwise(_let(F.transform(word, lambda b: F.get(table["single"], b)), fold))
    for token, number in merges(path).apart.items():
        ids = F.when(word == F.array(*[F.lit(b) for b in token]), F.array(F.lit(number))).otherwise(ids)
    return ids


def decode_ids(ids: Column, table: Column) -> Column:
    """The bytes of token ids, one piece after another."""
    return F.aggregate(ids, F.lit(b""), lambda out, i: F.concat(out, F.get(table["tokens"], i)))


def code_words(df: DataFrame, words: str, path: str) -> DataFrame:
    """`df` with the array of words (each an array<int> of bytes) in the column `words` as array<struct<ids, bytes>>."""

    def coded(table: Column) -> Column:
        return F.transform(words, lambda w: _let(encode_word(w, table, path), lambda ids: F.struct(ids.alias("ids"), decode_ids(ids, table).alias("bytes"))))

    rest = [c for c in df.columns if c != words]
    return df.select("*", literal(df.sparkSession, path).alias("_merges")).select(*rest, _let(F.col("_merges"), coded).alias(words))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _coded(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


def _bytes(words: pa.Array) -> pa.Array:
    ends = _ends(words)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(_content(words).astype(np.int32)))


class _Numbers(dict):
    """Numbers of a run's distinct words, in order; a word of more than PIECE_BYTES has -1 less its place among the
    `long` ones, and its pieces have numbers."""

    def __init__(self):
        self.words: list[bytes] = []
        self.long: list[list[int]] = []
        self.pieces: dict[bytes, int] = {}

    def __missing__(self, word: str) -> int:
        coded = _coded(word)
        if len(coded) > PIECE_BYTES:
            self.long.append([self.piece(coded[i : i + PIECE_BYTES]) for i in range(0, len(coded), PIECE_BYTES)])
            at = -len(self.long)
        else:
            at = len(self.words)
            self.words.append(coded)
        self[word] = at
        return at

    def piece(self, coded: bytes) -> int:
        if coded not in self.pieces:
            self.pieces[coded] = len(self.words)
            self.words.append(coded)
        return self.pieces[coded]

    def cut(self, at: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """A document's numbers with long words as their pieces, and the places of pieces that go on a word."""
        out, cuts = [], []
        for x in at.tolist():
            mine = [x] if x >= 0 else self.long[-x - 1]
            cuts += range(len(out) + 1, len(out) + len(mine))
            out += mine
        return np.array(out, np.int32), cuts


class _Split:
    """Runs of documents: each one's words as numbers, first in `ahead`, then in the run's own distinct words. Words of
    more than PIECE_BYTES give a number for each piece; `joins` are the places of pieces that go on a word."""

    def __init__(self, pattern: str, ahead):
        self.pattern, self.ahead = pattern, ahead

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = regex.compile(self.pattern).findall, self.ahead.value
        for whole in batches:
            for batch in slices(whole, 1, RUN_BYTES):
                numbers, each, joins = _Numbers(), [], []
                for text in batch.column(1).to_pylist():
                    found = words(text)
                    at = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                    cuts = []
                    if at.min(initial=0) < 0:
                        at, cuts = numbers.cut(at)
                    each.append(at)
                    joins.append(cuts)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                coded = pa.array(numbers.words, pa.binary())
                at_known = pc.index_in(coded, known).fill_null(-1).to_numpy(zero_copy_only=False)
                new = at_known < 0
                number = np.where(new, len(known) + np.cumsum(new) - 1, at_known).astype(np.int32)
                at = number[np.concatenate([np.zeros(0, np.int32), *each])]
                at = pa.ListArray.from_arrays(pa.array(ends), pa.array(at))
                docs = pa.StructArray.from_arrays([batch.column(0), at, pa.array(joins, pa.list_(pa.int32()))], ["row", "at", "joins"])
                yield pa.RecordBatch.from_arrays([_one(docs), _one(_bytes(coded.filter(pa.array(new))))], names=["docs", "words"])
                del numbers, each, at, docs, coded
        release()


@dataclass
class Codes:
    """Ids and bytes of the words encoded before the others, and the ranks, for the assembling side."""

    ids: pa.ListArray
    data: pa.BinaryArray
    ranks: dict[bytes, int]


def _content(values: pa.Array) -> np.ndarray:
    ends = _ends(values)
    return np.frombuffer((values.buffers()[2] if len(values) else None) or b"", np.uint8)[ends[0] : ends[-1]]


class _Assemble:
    """Ids, as numbers or as text, and decoded bytes of each document of a run, from those of its words."""

    def __init__(self, ahead, as_text: bool):
        self.ahead, self.as_text = ahead, as_text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = self.ahead.value
        top = max(known.ranks.values(), default=-1) + 1
        token = [b""] * top
        for content, number in known.ranks.items():
            token[number] = content
        names = pa.array([b"%d " % i for i in range(top)], pa.binary())
        for batch in batches:
            for n in range(batch.num_rows):
                docs, words = batch.column(0).slice(n, 1).flatten(), batch.column(1).slice(n, 1).flatten()
                row, at = docs.field(0), docs.field(1)
                doc_ends, at = _ends(at) - _ends(at)[0], at.flatten()
                coded = pa.concat_arrays([known.ids, words.field(0)]).take(at)
                ids, to = coded.flatten(), _ends(coded)
                to = to - to[0]
                data = pa.concat_arrays([known.data, words.field(1)]).take(at)
                ends = _ends(data)[doc_ends]
                decoded = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), data.buffers()[2]]) if len(data) else pa.array([b""] * len(row), pa.binary())
                size = to[doc_ends]
                cuts = _ends(docs.field(2))
                if cuts[-1] > cuts[0]:
                    joins = {int(d): docs.field(2)[d].as_py() for d in np.flatnonzero(np.diff(cuts))}
                    ids, size = _joined(joins, ids.to_numpy(), to, doc_ends, token, known.ranks)
                    ids = pa.array(ids)
                if self.as_text:
                    text = names.take(ids)
                    ends = _ends(text)[size]
                    joined = np.delete(_content(text), ends[1:][np.diff(size) > 0] - 1 - ends[0])  # the space after a document's last id
                    ends = ends - ends[0] - np.concatenate([[0], np.cumsum(np.diff(size) > 0)])
                    tokens = pa.StringArray.from_buffers(len(row), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(joined))
                else:
                    tokens = pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([row, pa.array(np.diff(size)), tokens, decoded], names=["row", "n_tokens", "token_ids", "decoded"])
        release()


def _joined(joins: dict[int, list[int]], ids: np.ndarray, to: np.ndarray, doc_ends: np.ndarray, tokens: list[bytes], ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All ids with the pieces of long words put together, and where each document's ids end."""
    parts = []
    for d, (a, b) in enumerate(zip(doc_ends, doc_ends[1:], strict=False)):
        if d not in joins:
            parts.append(ids[to[a] : to[b]])
            continue
        goes_on, at, mine = set(joins[d]), 0, []
        while at < b - a:
            end = at + 1
            while end in goes_on:
                end += 1
            if end == at + 1:
                mine.append(ids[to[a + at] : to[a + end]])
            else:
                pieces = [ids[to[a + k] : to[a + k + 1]].tolist() for k in range(at, end)]
                mine.append(np.array(join_pieces(pieces, tokens, ranks), ids.dtype))
            at = end
        parts.append(np.concatenate(mine))
    size = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return np.concatenate([np.zeros(0, ids.dtype), *parts]), size


def _ends(values: pa.Array) -> np.ndarray:
    if not len(values):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_list(values.type) or pa.types.is_large_binary(values.type)
    return np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def frequent_words(texts: DataFrame, pattern: str, path: str, words: int, sample_docs: int) -> pa.Table:
    """The most frequent words of about `sample_docs` texts, encoded. Only a saving: any words give the same results."""
    every = max(1, texts.count() // max(1, sample_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = regex.compile(pattern).findall
        for batch in (part for whole in batches for part in slices(whole, 0, 2_000_000)):
            n = Counter(w for t in batch.column(0).to_pylist() for w in found(t))
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in n], pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counted = materialize(some.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.octet_length("word").between(1, PIECE_BYTES)), "words")
    most = counted.orderBy(F.desc("n"), "word").limit(words)
    most = materialize(most.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism, "word"), "words")
    code = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.conv(F.hex(F.substring(F.col("word"), i, F.lit(1))), 16, 10).cast("int"))
    coded = code_words(most.select("word", F.array(code).alias("c")), "c", path).select("word", F.element_at("c", 1).alias("c")).select("word", "c.ids", "c.bytes")
    found = coded.toArrow()  # at most `words` rows
    remove(counted, most)
    return found


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None,
    ahead_words: int = AHEAD_WORDS, ahead_docs: int = AHEAD_DOCS, as_text: bool = False,
) -> DataFrame:
    """`keep` columns (all by default) with n_tokens long, token_ids and decoded binary. token_ids is array<int>, or with
    `as_text` a string of the ids joined by spaces.

    Each match of `pattern` is encoded by itself by the ranks of the file at `path`; no string is special. Null and
    empty texts have no ids and no bytes; an empty table stays empty. Texts and words of any length are taken whole,
    in time that grows with their bytes. Of equal ranks the leftmost merges. Every row has its own result, whatever
    rows repeat. Columns with the names of new ones, in either case, give way to them. Of the words, `ahead_words` at most, found among about
    `ahead_docs` rows, are encoded once for all runs and broadcast; the rest are encoded by each run that has them.
    """
    small_batches(docs.sparkSession)
    keep = without(docs.columns if keep is None else keep, ["n_tokens", "token_ids", "decoded"])
    rows = docs.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("_")).alias("row"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    first = frequent_words(rows.select("text"), pattern, path, ahead_words, ahead_docs)
    word, ids, data = (first.column(c).combine_chunks() for c in ("word", "ids", "bytes"))
    context = docs.sparkSession.sparkContext
    ahead, codes = context.broadcast(word), context.broadcast(Codes(ids, data, read_ranks(path)))
    del first, word, ids, data
    release()
    kind = rows.schema["row"].dataType.simpleString()
    runs = rows.mapInArrow(_Split(pattern, ahead), f"docs array<struct<row: {kind}, at: array<int>, joins: array<int>>>, words array<array<int>>")
    coded = code_words(runs, "words", path).select("docs", "words")
    done = coded.mapInArrow(_Assemble(codes, as_text), f"row {kind}, n_tokens long, token_ids {'string' if as_text else 'array<int>'}, decoded binary")
    return done.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "token_ids", "decoded")


def digest(encoded: DataFrame) -> DataFrame:
    """Of encode_documents(as_text=True)."""
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return digest(encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], as_text=True))
