"""Exact Jaccard self-join of shingle sets and its components, by count vectors (operator 5).

A document's shingles are hashed into groups and the group counts are its point. Points that may link are found in two
levels. Two sets at least as similar as asked differ in few shingles, so among slightly more groups than those, one
group is the same in both: sets with an equal group (count and content) share a cell, by an equal join, which deals the
points out to any number of machines. Over the points of each cell a tree is bulk-loaded: its nodes keep the largest
count of each group, the sum of the smaller counts of two nodes bounds the overlap of any two sets below them, and
the walk leaves out pairs of nodes whose bound is too low. Pairs of points that remain are verified on the sets.

Only connected components are wanted, so a set is first tried against one of the first members of its cells; other
pairs are tried when they are not yet connected. No link between different components is lost, and a group of
thousands of near copies costs one pair a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.components import components
from quillstack.llm.textcore import SPACED, Words, map_texts, mix, quoted, release, shingle_sets, text_buffers
from quillstack.session import materialize, remove, table

_U = np.uint64
#: Coordinates of a point, at least and at most (powers of two), and shingles for each coordinate, about: the longer the
#: set, the finer its point, since counts of unlike sets differ by the root of their means only.
LEAST_GROUPS, MOST_GROUPS, PER_GROUP = 64, 4096, 8
#: Points of a leaf. Shingles of a block: a cell of more is cut in blocks, and each two blocks meet in a cell of their own.
LEAF, BLOCK = 64, 1 << 20
#: Pairs of points that are bounded at once, and pairs held before they are verified.
PAIRS, HELD = 20_000, 100_000
#: Rows (four longs each) of the tables of sets to verify and of their cells, up to which they are broadcast.
BROADCAST_ROWS = 300_000
#: Places in which a task keeps what it has seen last.
SEEN = 1 << 19


class Cells:
    """Which group signatures sets of each size give, for links where den * overlap >= num * union.

    A link whose smaller set has n shingles has at most slack(n) shingles in one set only. Sizes are dealt into
    bands so that linked sets lie in the same or in neighbouring bands; a set gives the groups of its own band and
    of the one below. Of `groups` groups at least `groups - slack` agree, so a non-empty one does, unless as many
    as that are empty: then the empty ones are given too. Where the slack is one shingle, the larger set gives
    itself less each shingle instead, and where it is none only equal sets link.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        n = 1
        while self.slack(n) < 2:
            n += 1
        self.low = [n]

    def slack(self, n):
        return n * (self.den - self.num) // self.num

    def band(self, n: np.ndarray) -> np.ndarray:
        """Band of each size; -1 below the first."""
        while len(n) and self.low[-1] <= n.max():
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return np.searchsorted(np.array(self.low), n, "right") - 1

    def groups(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of groups of a band, and how many empty ones are too many to leave out."""
        while len(self.low) < band.max(initial=0) + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        slack = self.slack(np.array(self.low)[band + 1] - 1)
        return slack + 2 + slack // 8, 2 + slack // 8

    def signatures(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of each set and their owners; h: sorted hashes, at: offsets."""
        n = np.diff(at)
        owner = np.repeat(np.arange(len(n)), n)
        m = mix(h + _U(0x5851F42D4C957F2D))
        total = _sums(m, at)
        out, who = [], []
        one, below = (self.slack(n) == 1) & (n > 0), (self.slack(n - 1) == 1) & (n > 1)
        if one.any():
            out.append(mix(total[one] + n[one].astype(_U)))
            who.append(np.flatnonzero(one))
        if below.any():
            each = np.flatnonzero(below[owner])
            out.append(mix(total[owner[each]] - m[each] + (n[owner[each]] - 1).astype(_U)))
            who.append(owner[each])
        own = self.band(n)
        for band in (own, own - 1):
            mine = np.flatnonzero(band >= 0)
            if not len(mine):
                continue
            groups, limit = self.groups(band[mine])
            first = np.concatenate([[0], np.cumsum(groups)])
            place = np.full(len(n), -1)
            place[mine] = np.arange(len(mine))
            here = place[owner] >= 0
            p = place[owner[here]]
            slot = first[p] + (m[here] % groups[p].astype(_U)).astype(np.int64)
            sums = np.zeros(first[-1], _U)
            np.add.at(sums, slot, m[here])
            empty = np.bincount(slot, minlength=first[-1]) == 0
            of = np.repeat(np.arange(len(mine)), groups)
            many = np.add.reduceat(empty, first[:-1]) >= limit
            give = ~empty | many[of]
            number = np.arange(first[-1]) - first[of]
            sig = mix(sums + mix(band[mine][of].astype(_U) * _U(1_000_003) + number.astype(_U) + _U(1)))
            out.append(sig[give])
            who.append(mine[of[give]])
        if not out:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        sig, who = np.concatenate(out), np.concatenate(who)
        order = np.argsort(who, kind="stable")
        return sig[order], who[order]


def _sums(m: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m) + 1, _U)
    np.cumsum(m, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, at = shingle_sets(Words(*text_buffers(batch.column(batch.num_columns - 1)), SPACED), k)
    key = mix(_sums(mix(h + _U(77)), at) + np.diff(at).astype(_U))
    return h, at, key


class _Seen:
    """The last value seen for each of many keys, in a table of fixed size: a key may be forgotten, never mistaken."""

    def __init__(self):
        self.keys, self.values = np.zeros(SEEN, _U), np.zeros(SEEN, _U)
        self.hits = np.zeros(SEEN, np.uint8)

    def first(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each of the distinct `keys`: as seen before, or else `values`, which are kept from now on where
        the place isn't held by a key that has come again."""
        at = (keys & _U(SEEN - 1)).astype(np.int64)
        known = (self.keys[at] == keys) & (keys != 0)
        self.hits[at[known]] = np.minimum(self.hits[at[known]], 254) + 1
        free = ~known & (self.hits[at] == 0)
        self.hits[at[~known & ~free]] -= 1
        out = np.where(known, self.values[at], values)
        self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
        return out


def _sizes(k: int):
    def work(batch: pa.RecordBatch) -> list:
        _, at, key = _sets(batch, k)
        n = np.diff(at)
        return [n, pa.array(key.view(np.int64), pa.int64(), mask=n == 0)]

    return work


def widths(n: np.ndarray) -> np.ndarray:
    """Coordinates of the points of sets of `n` shingles."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / PER_GROUP)).astype(np.int64).clip(0), LEAST_GROUPS, MOST_GROUPS)


def points(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group counts of each set and their offsets. Groups go by leading bits, so adjacent counts add up to coarser ones."""
    n = np.diff(at)
    width = widths(n)
    ends = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(n)), n)
    bits = (64 - np.log2(width).astype(np.int64)).astype(_U)
    place = ends[owner] + (mix(h) >> bits[owner]).astype(np.int64)
    return np.bincount(place, minlength=ends[-1]), ends


def packed(counts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Points as bytes: a byte a count, or four where a point has counts above 255."""
    width = np.diff(ends)
    wide = np.maximum.reduceat(counts, ends[:-1]) > 255 if len(width) else np.zeros(0, bool)
    to = np.concatenate([[0], np.cumsum(np.where(wide, 4 * width, width))])
    out, own = np.zeros(to[-1], np.uint8), np.repeat(wide, width)
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], width)
    out[np.repeat(to[:-1], width)[~own] + place[~own]] = counts[~own]
    four = counts[own].astype("<i4").view(np.uint8).reshape(-1, 4)
    out[(np.repeat(to[:-1], width)[own] + 4 * place[own])[:, None] + np.arange(4)] = four
    return pa.BinaryArray.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out)])


def _points(k: int):
    def make():
        seen = _Seen()

        def work(batch: pa.RecordBatch) -> list:
            h, at, key = _sets(batch, k)
            wanted = key == batch.column(0).to_numpy().view(_U)
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            mine = np.flatnonzero(wanted & once)
            token = np.arange(1, len(mine) + 1).astype(_U) + _U(seen.values.max())
            mine = mine[seen.first(key[mine], token) == token]  # copies that this task has given already
            keep = np.zeros(len(key), bool)
            keep[mine] = True
            n = np.diff(at)
            h, at = h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])
            counts, ends = points(h, at)
            each = np.searchsorted(mine, np.arange(len(key) + 1))
            point = packed(counts, ends)
            hashes = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            rows = pa.StructArray.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(n[keep]), point, hashes], ["key", "n", "point", "hashes"])
            return [pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), rows)]

        return work

    return make


class _Emit:
    """Signatures of the sets of one task. `head` is the first set of the task with that signature, as far as a table of
    fixed size remembers; sets and signatures that it forgets come again, and meet in the exchange."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.cells, self.sets, self.heads, self.batch = k, Cells(num, den), _Seen(), _Seen(), 0

    def __call__(self, batch: pa.RecordBatch) -> list:
        h, at, key = _sets(batch, self.k)
        n = np.diff(at)
        self.batch += 1
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        mine = np.flatnonzero(first & (n > 0))
        mine = mine[self.sets.first(key[mine], np.full(len(mine), self.batch, _U)) == _U(self.batch)]
        new = np.zeros(len(key), bool)
        new[mine] = True
        sig, who = self.cells.signatures(h[np.repeat(new, n)], np.concatenate([[0], np.cumsum(n[new])]))
        who = mine[who]
        value, one, which = np.unique(sig, return_index=True, return_inverse=True)
        head = self.heads.first(value, key[who[one]])[which]
        at_row = np.searchsorted(who, np.arange(len(key) + 1))
        signed = [pa.array(x.view(np.int64), pa.int64()) for x in (sig, np.ascontiguousarray(key[who]), np.ascontiguousarray(head))]
        return [pa.LargeListArray.from_arrays(pa.array(at_row, pa.int64()), pa.StructArray.from_arrays(signed, ["sig", "key", "head"]))]


@dataclass
class Node:
    """A node of the tree: its points (of a leaf), what bounds them, and its two parts."""

    rows: np.ndarray
    top: np.ndarray
    low: int
    high: int
    roots: tuple[int, int]
    parts: tuple[Node, Node] | None = None


class Tree:
    """Bulk-loaded tree over the rows `at` of a matrix of points. Halves go apart by size as long as sizes of a node are
    too different to link, then along the coordinate that varies most."""

    def __init__(self, matrix: np.ndarray, n: np.ndarray, root: np.ndarray, num: int, den: int):
        self.matrix, self.n, self.root, self.num, self.den = matrix, n, root, num, den

    def build(self, at: np.ndarray) -> Node:
        n, root = self.n[at], self.root[at]
        node = Node(at, None, int(n.min()), int(n.max()), (int(root.min()), int(root.max())))
        if len(at) <= LEAF:
            node.top = self.matrix[at].max(0)
            return node
        by = n if node.high * self.num > node.low * self.den else self.matrix[at, self.matrix[at].var(0).argmax()]
        order = at[np.argsort(by, kind="stable")]
        half = len(at) // 2
        node.parts = self.build(order[:half]), self.build(order[half:])
        node.top = np.maximum(node.parts[0].top, node.parts[1].top)
        return node

    def may_link(self, u: Node, v: Node) -> bool:
        if u.roots == v.roots and u.roots[0] == u.roots[1] or u.high * self.den < self.num * v.low or v.high * self.den < self.num * u.low:
            return False
        return int(np.minimum(u.top, v.top).sum(dtype=np.int64)) * (self.den + self.num) >= self.num * (u.low + v.low)

    def pairs(self, u: Node, v: Node) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of pairs of leaves that may link; with itself (u is v) each pair once."""
        stack = [(u, v)]
        while stack:
            u, v = stack.pop()
            if not self.may_link(u, v):
                continue
            if u.parts is None and v.parts is None:
                if u is v:
                    i, j = np.triu_indices(len(u.rows), 1)
                    yield u.rows[i], u.rows[j]
                else:
                    yield np.repeat(u.rows, len(v.rows)), np.tile(v.rows, len(u.rows))
            elif u is v:
                a, b = u.parts
                stack += [(a, a), (a, b), (b, b)]
            elif v.parts is None or u.parts is not None and len(u.rows) >= len(v.rows):
                stack += [(x, v) for x in u.parts]
            else:
                stack += [(u, x) for x in v.parts]


#: Sides of the rows of a cell: all pairs of it, pairs with the head only (the keys and the head); others are blocks,
#: and only rows of different blocks are compared.
_ALL, _KEY, _HEAD = -1, -2, -3


class _Within:
    """Links within cells that join different roots, as many as join all that link. Rows come sorted by cell.

    Pairs are bounded by their points, then verified from the nearest on, unless links have joined them already.
    Without `verify` the rows have no sets, and what comes out are pairs that join all that may link.
    """

    def __init__(self, num: int, den: int, verify: bool = True):
        self.num, self.den, self.verify = num, den, verify

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() == cell[-1]:
                held.append(batch)  # one cell goes on; its rows are at most two blocks
                continue
            last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
            yield from _Compare(self, [*held, batch.slice(0, last)]).links()
            held = [batch.slice(last)]
        yield from _Compare(self, held).links()
        del held
        release()


class _Compare:
    """The cells of some batches."""

    def __init__(self, of: _Within, batches: list[pa.RecordBatch]):
        self.num, self.den, self.verify = of.num, of.den, of.verify
        rows = pa.Table.from_batches(batches) if batches else None
        self.rows = rows.num_rows if rows else 0
        if not self.rows:
            return
        self.cell, self.side, self.key, self.root, self.n = (rows.column(i).to_numpy() for i in range(5))
        point = rows.column(5).combine_chunks()
        wide = 8 if pa.types.is_large_binary(point.type) else 4
        self.ends = np.frombuffer(point.buffers()[1], f"<i{wide}")[point.offset : point.offset + len(point) + 1].astype(np.int64)
        self.counts, self.width = np.frombuffer(point.buffers()[2], np.uint8), widths(self.n)
        if self.verify:
            hashes = rows.column(6).combine_chunks()
            self.set_ends, self.hashes = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        self.joined = self.root if self.verify else self.key
        self.up: dict[int, int] = {}
        self.held: list[np.ndarray] = []
        self.many = 0
        self.found: tuple[list[int], list[int]] = [], []

    def links(self) -> Iterator[pa.RecordBatch]:
        if self.rows < 2:
            return
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.cell)) + 1, [self.rows]])
        size = np.diff(cuts)
        least = np.minimum.reduceat(self.width, cuts[:-1])
        for width in np.unique(least[size > 1]).tolist():
            self.of_width(width, cuts, np.flatnonzero((least == width) & (size > 1)))
        self.settle()
        if self.found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.found], names=["a", "b"])

    def of_width(self, width: int, cuts: np.ndarray, cells: np.ndarray) -> None:
        """The cells whose coarsest points have `width` counts; finer ones are added up to as many."""
        size = np.diff(cuts)[cells]
        at = np.repeat(cuts[cells] - np.cumsum(size) + size, size) + np.arange(size.sum())
        own, size_of = self.width[at], np.diff(self.ends)[at]
        matrix = np.zeros((len(at), width), np.int32)
        for w in np.unique(own).tolist():
            for kind, bytes_ in (("u1", w), ("<i4", 4 * w)):
                some = np.flatnonzero((own == w) & (size_of == bytes_))
                if len(some):
                    counts = np.ascontiguousarray(self.counts[self.ends[at[some], None] + np.arange(bytes_)]).view(kind)
                    matrix[some] = counts.reshape(len(some), width, w // width).sum(2, dtype=np.int32)
        n, root, side = self.n[at], self.root[at], self.side[at]
        tree = Tree(matrix, n, root, self.num, self.den)
        start = np.concatenate([[0], np.cumsum(size)])
        plain = np.add.reduceat(side != _ALL, start[:-1]) == 0

        def test(x: np.ndarray, y: np.ndarray) -> None:
            step = max(1, PAIRS * LEAST_GROUPS // width)
            for k in range(0, len(x), step):
                p, q = x[k : k + step], y[k : k + step]
                ok = root[p] != root[q]
                p, q = p[ok], q[ok]
                bound = np.minimum(matrix[p], matrix[q]).sum(1, dtype=np.int64)
                ok = bound * (self.den + self.num) >= self.num * (n[p] + n[q])
                self.hold(bound[ok], at[p[ok]], at[q[ok]])

        for s in np.unique(size[plain & (size <= LEAF)]):  # cells of one leaf, all of a size at once
            i, j = np.triu_indices(s, 1)
            of = start[:-1][plain & (size == s)]
            for part in np.array_split(of, max(1, len(of) * len(i) // 200_000)):
                test((part[:, None] + i).ravel(), (part[:, None] + j).ravel())
        for c in np.flatnonzero(~plain | (size > LEAF)).tolist():
            mine = np.arange(start[c], start[c + 1])
            if plain[c]:
                whole = tree.build(mine)
                two = whole, whole
            elif (side[mine] < _ALL).any():
                heads, keys = mine[side[mine] == _HEAD], mine[side[mine] == _KEY]
                if len(heads) and len(keys):
                    test(np.repeat(heads[:1], len(keys)), keys)
                continue
            else:
                parts = [mine[side[mine] == s] for s in np.unique(side[mine])]
                if len(parts) < 2:
                    continue
                two = tree.build(parts[0]), tree.build(parts[1])
            for x, y in tree.pairs(*two):
                test(x, y)

    def hold(self, bound: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        if not len(x):
            return
        self.held.append(np.stack([bound / (self.n[x] + self.n[y]), x, y], 1))
        self.many += len(x)
        if self.many > HELD:
            self.settle()

    def settle(self) -> None:
        """Verify the pairs held, the nearest first, unless links have joined them by now."""
        near = np.concatenate(self.held) if self.held else np.zeros((0, 3))
        self.held, self.many = [], 0
        for x, y in near[np.argsort(-near[:, 0], kind="stable"), 1:].astype(np.int64).tolist():
            u, v = _top(self.up, int(self.joined[x])), _top(self.up, int(self.joined[y]))
            if u != v and (not self.verify or self.linked(x, y)):
                self.up[u] = v
                self.found[0].append(int(self.key[x]))
                self.found[1].append(int(self.key[y]))

    def linked(self, x: int, y: int) -> bool:
        both = len(np.intersect1d(*(self.hashes[self.set_ends[z] : self.set_ends[z + 1]] for z in (x, y)), assume_unique=True))
        return both * (self.den + self.num) >= self.num * int(self.n[x] + self.n[y])


def _top(up: dict[int, int], x: int) -> int:
    while x in up:
        if up[x] in up:
            up[x] = up[up[x]]
        x = up[x]
    return x


def _within_cells(members: DataFrame, sets: DataFrame, num: int, den: int, most: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the different roots within each `sig` of `members` (sig, key, root, n), written.

    Of cells with the same members one is taken. Points alone part the sets into groups of those that may link, and
    only there the sets are compared. `most`: rows of the members, about.
    """
    prints = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"print{i}") for i in (0, 1)]
    cells = members.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("weight"), *prints)
    cells = cells.where("low < high").groupBy("print0", "print1").agg(F.min("sig").alias("sig"), F.max("weight").alias("weight"))
    cells = materialize(cells.select(F.col("sig").alias("group"), _blocks("weight", block)), "open", most)
    rows = members.withColumnRenamed("sig", "group").join(cells, "group")
    near = materialize(_compared(_in_blocks(rows), sets, num, den, most, verify=False), "near")
    remove(cells)
    if near.isEmpty():
        return near
    tight = components(near).select(F.col("node").alias("key"), F.col("root").alias("group"))
    rows = materialize(tight.join(members.select("key", "root", "n").distinct(), "key"), "tight", most)
    cells = rows.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), _blocks(F.sum("n"), block)).where("low < high")
    links = materialize(_compared(_in_blocks(rows.join(cells.select("group", "blocks"), "group")), sets, num, den, most), "links")
    remove(near, tight, rows)
    return links


def _blocks(weight: Column | str, block: int) -> Column:
    return F.ceil((weight if isinstance(weight, Column) else F.col(weight)) / block).cast("long").alias("blocks")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Cells (cell, side, key, root) of rows (key, root, group, blocks): each two blocks of a group are a cell."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when((F.col("own") == F.col("other")), F.lit(_ALL)).otherwise(F.col("own"))
    return rows.select(cell.alias("cell"), side.cast("long").alias("side"), "key", "root")


def _compared(rows: DataFrame, sets: DataFrame, num: int, den: int, most: int, verify: bool = True) -> DataFrame:
    """Pairs (a, b) within the cells of rows (cell, side, key, root); a set goes along once for each of its cells. Up to
    BROADCAST_ROWS rows are sent to the sets; beyond that the sets are shuffled to them.
    `most`: rows, about."""
    columns = ["n", "point", "hashes"] if verify else ["n", "point"]
    rows = materialize(rows, "rows", most)
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    rows = sets.select("key", *columns).join(rows, "key").select("cell", "side", "key", "root", *columns)
    rows = rows.repartition("cell").sortWithinPartitions("cell", "side", "n")
    return rows.mapInArrow(_Within(num, den, verify), "a long, b long")


def _with_heads(live: DataFrame, sets: DataFrame, num: int, den: int, most: int, block: int = BLOCK) -> DataFrame:
    """Links of each key to the head that most of its cells have. The keys of a head are dealt into cells, and the head
    goes to each. What the other heads link is left to the comparison of roots. `most`: rows of `live`."""
    shared = live.where("key != head").groupBy("key", "head").agg(F.count(F.lit(1)).alias("cells"))
    best = shared.groupBy("key").agg(F.max(F.struct("cells", "head"))["head"].alias("head"))
    pairs = materialize(best.join(sets.select("key", "n"), "key"), "pairs", most)
    blocks = pairs.groupBy("head").agg(_blocks(F.sum("n"), block))
    cell = lambda part: F.xxhash64("head", part).alias("cell")
    keys = pairs.join(blocks, "head").select(cell(F.pmod(F.xxhash64("key"), F.col("blocks"))), F.lit(_KEY).cast("long").alias("side"), "key")
    heads = blocks.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part")).select(cell("part"), F.lit(_HEAD).cast("long").alias("side"), F.col("head").alias("key"))
    links = materialize(_compared(keys.union(heads).withColumn("root", F.col("key")), sets, num, den, most), "links")
    remove(pairs)
    return links


def _sets_of(slim: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(key, n, point, hashes) of the wanted (of, id, mark), once each, written."""
    few = wanted.count() <= BROADCAST_ROWS  # beyond that the texts are shuffled
    mine = slim.join(F.broadcast(wanted) if few else wanted, slim["id"].eqNullSafe(wanted["id"]) & (slim["mark"] == wanted["mark"])).select("of", "txt")
    kind = "sets array<struct<key: long, n: long, point: binary, hashes: array<long>>>"
    sets = materialize(map_texts(mine, "txt", ["of"], kind, _points(shingle)).select(F.inline("sets")), "hashes")
    if sets.groupBy("key").count().where("count > 1").isEmpty():
        return sets
    numbered = sets.withColumn("at", F.monotonically_increasing_id())  # of files, so it stays the same
    one = materialize(numbered.groupBy("key").agg(F.min("at").alias("at")), "once")
    return numbered.join(one, ["key", "at"], "left_semi").drop("at")


def shingle_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """(id, mark, n long, first struct<none, id, mark>) for each row: `mark` hashes the text, n counts the shingles, and
    `first` is the least row of the component, by id (none last) and then by mark; null without words.

    See jaccard_components for what links.
    """
    slim = docs.select(quoted(doc_id).cast("long").alias("id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("txt")).withColumn("mark", F.xxhash64("txt"))
    sized = materialize(map_texts(slim, "txt", ["id", "mark"], "n long, key long", lambda: _sizes(shingle)), "sets")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    first = materialize(sized.where("key is not null").groupBy("key").agg(F.min(row).alias("first")), "first")

    # Cells: rows that are the first of their task meet under the signature; others already have their first.
    rows = map_texts(slim, "txt", [], "sigs array<struct<sig: long, key: long, head: long>>", lambda: _Emit(shingle, num, den)).select(F.inline("sigs"))
    apart = F.when(F.col("key") == F.col("head"), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.col("key"), F.lit(1024)))
    cell = Window.partitionBy("sig", "apart")
    rows = rows.select("sig", "key", "head", apart.cast("int").alias("apart")).select("*", F.min("key").over(cell).alias("low"), F.max("key").over(cell).alias("high"))
    live = rows.where("apart > 0 or low < high").select("sig", "key", F.when(F.col("apart") > 0, F.col("head")).otherwise(F.col("low")).alias("head"))
    live = materialize(live, "cells")
    most = live.count()

    wanted = live.select("key").union(live.select("head")).distinct()
    wanted = materialize(first.join(wanted, "key").select(F.col("key").alias("of"), "first.id", "first.mark"), "wanted", most)
    sets = _sets_of(slim, wanted, shingle)
    links = _with_heads(live, sets, num, den, most, block)
    root = components(links)
    member = live.select("sig", "key").union(live.select("sig", F.col("head").alias("key"))).distinct().join(sets.select("key", "n"), "key")
    member = member.join(root.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", "n", F.coalesce("root", "key").alias("root"))
    member = materialize(member, "members", 2 * most)
    more = _within_cells(member, sets, num, den, 2 * most, block)
    if not more.isEmpty():
        root = components(links.union(more))

    low = first.join(root.withColumnRenamed("node", "key"), "key").groupBy("root").agg(F.min("first").alias("low"))
    named = root.join(low, "root").select(F.col("node").alias("key"), "low")
    named = materialize(first.join(named, "key", "left").select("key", F.coalesce("low", "first").alias("first")), "named")
    remove(first, live, wanted, sets, links, root, member, more)
    return sized.join(named, "key", "left").select("id", "mark", "n", "first")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100, block: int = BLOCK
) -> DataFrame:
    """(doc_id, n_shingles long, component_id long) for each row.

    Words are runs without white space, A-Z lower-cased; a set is the distinct `shingle`-word runs, or the whole
    sequence if it is shorter. Sets link when den * overlap >= num * union. Rows without words (null and empty
    texts) have n_shingles 0 and link with nothing. Equal texts are one set, so any number of copies costs no
    pairs. Repeated ids keep their rows. A row without an id links as any other; it takes the smallest id of its
    component, or none. Ties change nothing. An empty table gives no rows; texts of any length are taken whole.
    Other columns are not read. Sets are told apart by 64-bit hashes of their 64-bit shingle hashes. Sets of `block`
    shingles in all are compared by one task with as many others.
    """
    found = shingle_groups(docs, doc_id, text, shingle, num, den, block)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)
