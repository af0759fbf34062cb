"""Embedding near-dedup by int8 tile products (operator 11).

Equal vectors of a label are one point with a weight, so that a large group of copies costs no pairs. Points of a label
are dealt into tiles by their digests; each two tiles meet in one task. There a point is a scale, an int8 code and the
exact length of what the code leaves out. The product of two codes, which is exact, tells the cosine within a bound that
these lengths give; only pairs that the bound leaves open are computed again in double precision. A task returns a row a
point (its links, and the smallest point it reaches), never pairs; components join the tasks' rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillstack.llm.components import components
from quillstack.llm.textcore import quoted, small_batches, without
from quillstack.session import broadcast_small, materialize, remove, table

#: Least cosine of a link; points of a tile, on average.
LEAST, TILE = 0.93, 4096
#: Rows of a tile that are multiplied at once, pairs that are computed again at once, dimensions whose int8 products add up
#: exactly in 32-bit floats, and what rounding in double precision may add to a bound.
_ROWS, _PAIRS, _EXACT, _SLACK = 512, 1 << 16, 1024, 1e-9
_POINT = "label string, dim int, key binary, vec binary"


def _points(kind: type, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept row, the label, and dimension, digest and bytes of vectors that can link; nulls for the others."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            vectors, label = batch.column(2), batch.column(1)
            flat = vectors.flatten()
            bad = flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            bad |= ~np.isfinite(x)
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            faults = np.concatenate([[0], np.cumsum(bad | (x == 0))])
            broken = np.concatenate([[0], np.cumsum(bad)])
            known = label.is_valid().to_numpy(zero_copy_only=False)
            x[x == 0] = 0  # no negative zeros: they would be other bytes
            dim, key, vec = [], [], []
            for n, e, ok in zip(size.tolist(), ends.tolist(), known.tolist(), strict=True):
                s = e - n
                fine = ok and n and broken[e] == broken[s] and faults[e] - faults[s] < n
                v = x[s:e].tobytes() if fine else None
                dim.append(n if fine else None)
                key.append(xxhash.xxh3_128_digest(v) if fine else None)
                vec.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array(dim, pa.int32()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["row", "label", "dim", "key", "vec"])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors (as 32-bit floats, for the product), scales, lengths of the decoded vectors, and lengths
    of what the codes leave out."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None])
    back = code * scale[:, None]
    return code.astype(np.float32), scale, np.sqrt((back * back).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes, exact: sums of 1,024 products stay below 2^24."""
    if a.shape[1] <= _EXACT:
        return (a @ b.T).astype(np.float64)
    return sum((a[:, k : k + _EXACT] @ b[:, k : k + _EXACT].T).astype(np.float64) for k in range(0, a.shape[1], _EXACT))


def linked(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, j, how many were computed again) in runs of rows: places of pairs of x and y with a cosine of `least` or more.

    `same`: x is y, and each pair is found once. For unit vectors u = s c + e the cosine of two differs from the scaled
    product of their codes by at most |e1| |s2 c2| + |e2|.
    """
    x, y = unit(x), unit(y) if not same else None
    y = x if same else y
    cx, sx, _, ex = quantise(x)
    cy, sy, ny, ey = quantise(y)
    for at in range(0, len(x), _ROWS):
        rows = slice(at, at + _ROWS)
        about = _products(cx[rows], cy) * sx[rows, None] * sy
        bound = ex[rows, None] * ny + ey + _SLACK
        near = about + bound >= least
        if same:
            near &= np.arange(len(y)) > np.arange(at, min(at + _ROWS, len(x)))[:, None]
        i, j = np.nonzero(near)
        sure = about[i, j] - bound[i, j] >= least
        open_ = np.flatnonzero(~sure)
        i += at
        for k in range(0, len(open_), _PAIRS):
            part = open_[k : k + _PAIRS]
            sure[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= least
        yield i[sure], j[sure], len(open_)


def _settle(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Every place of `root` gets the smallest place that the links (i, j) and former roots reach."""
    while len(i):
        a, b = root[i], root[j]
        if not (other := a != b).any():
            return
        i, j, a, b = i[other], j[other], a[other], b[other]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _meet(least: float, kind: type):
    def work(pair: pa.Table) -> pa.Table:
        dim = pair.column("dim")[0].as_py()
        order = np.lexsort((pair.column("node").to_numpy(), pair.column("tile").to_numpy()))
        pair = pair.take(pa.array(order))
        node, tile, rows = (pair.column(c).to_numpy() for c in ("node", "tile", "rows"))
        vec = np.frombuffer(b"".join(pair.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
        same = pair.column("a")[0].as_py() == pair.column("b")[0].as_py()
        cut = int(np.searchsorted(tile, pair.column("a")[0].as_py(), "right"))
        x, y, shift = (vec, vec, 0) if same else (vec[:cut], vec[cut:], cut)
        rank = np.argsort(np.argsort(node))  # places by node, so that the smallest place is the smallest node
        root, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        if len(x) and len(y):
            for i, j, _ in linked(x, y, least, same):
                j = j + shift
                links += np.bincount(i, rows[j], len(node)).astype(np.int64) + np.bincount(j, rows[i], len(node)).astype(np.int64)
                _settle(root, rank[i], rank[j])
        has = np.flatnonzero(links)
        by = np.sort(node)
        return pa.table({"node": pa.array(node[has]), "root": pa.array(by[root[rank[has]]]), "links": pa.array(links[has])})

    return work


def group_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, keep: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """`keep` columns (all by default) with n_links long, component_id, kept boolean.

    Rows are compared where labels are equal and not null. Vectors that are null, empty, zero, or that hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are linked, repeated rows
    too, each being a row of its own. component_id is the smallest id reachable, nulls left out; a row without an id that
    reaches none has a null one. kept: the id is the component's. An empty table stays empty. Columns with the names of
    new ones, in either case, give way to them. Tiles of a label are its points over `tile`, rounded up; each two meet,
    so the work is quadratic in a label's different vectors, spread over tasks of twice `tile` points.
    """
    small_batches(df.sparkSession)
    keep = without(df.columns if keep is None else keep, ["n_links", "component_id", "kept"])
    row = F.struct(quoted(vec_id).alias("id"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    held = df.select(row, quoted(label).cast("string").alias("label"), quoted(vector).alias("vector"))
    kind = np.float32 if held.schema["vector"].dataType.elementType == FloatType() else np.float64
    points = materialize(held.mapInArrow(partial(_points, kind), f"row {held.schema['row'].dataType.simpleString()}, {_POINT}"), "points")
    mine = points.where("key is not null").groupBy("label", "dim", "key").agg(F.min("row.id").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("vec").alias("vec"))
    mine = materialize(mine.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so that nodes stay as they are
    # Labels of one tile need no row here, so the table has at most one row for each `tile` points.
    wide = mine.groupBy("label", "dim").count().where(F.col("count") > tile).select("label", "dim", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = mine.join(broadcast_small(wide), ["label", "dim"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = dealt.select("label", "dim", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "node", "rows", "vec")
    met = materialize(pairs.groupBy("label", "dim", "a", "b").applyInArrow(_meet(least, kind), "node long, root long, links long"), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = mine.select("node", "label", "dim", "key", "first", "rows").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = materialize(found, "found")
    least_id = found.groupBy("root").agg(F.min("first").alias("component"))
    of = materialize(found.join(least_id, "root").select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), "component"), "groups")
    back = points.select("row", "label", "dim", "key").join(of, ["label", "dim", "key"], "left")
    remove(met, found)
    out = back.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("row.id").alias("_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("row.id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False))).drop("_id")


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
