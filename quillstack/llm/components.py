"""Connected components of a table of links, as joins; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.session import materialize, remove

#: Links of a part that one task contracts.
PART_LINKS = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for each node of a part's links: its smallest reachable node within the part, itself if it is that."""
    links = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches]
    if not links:
        return
    node, at = np.unique(np.concatenate(links, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(node))  # places are in the order of the nodes
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    for k in range(0, len(node), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (node, node[root])], names=["a", "b"])


def components(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """(node, root) for each node of `links` (a, b); root is the smallest node reachable.

    Links are dealt into parts of `part_links`, and each task contracts its part. One part is all; of more, rounds of
    joins put the parts together: each round hooks every node to its smallest neighbour, follows the hooks to their
    ends, and puts the ends in place of the nodes of the links, so that every component at least halves its nodes.
    No links: no rows.
    """
    links = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rows = links.count()
    parts = 1 + rows // part_links
    stars = materialize(links.coalesce(1).mapInArrow(_contract, "a long, b long") if parts == 1 else links.repartition(parts).mapInArrow(_contract, "a long, b long"), "stars")
    remove(links)
    if parts == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = materialize(stars.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    links = materialize(stars.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", 2 * rows)
    remove(stars)
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y"))
        hook, moved = materialize(hook, "hooks", rows), True
        while moved:  # two hooks further at once
            far = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            end = far.select(F.col("y").alias("z"), F.col("z").alias("end"))
            further = materialize(hook.join(far, "y").join(end, "z").select("x", F.col("end").alias("y"), (F.col("end") != F.col("y")).alias("moved")), "hooks", rows)
            moved = not further.where("moved").isEmpty()
            remove(hook)
            hook = further
        up = hook.select(F.col("x").alias("root"), F.col("y").alias("to"))
        old = label, links
        label = materialize(label.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", rows)
        a, b = hook.select(F.col("x").alias("a"), F.col("y").alias("ra")), hook.select(F.col("x").alias("b"), F.col("y").alias("rb"))
        left = links.join(a, "a").join(b, "b").where("ra != rb")
        links = materialize(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links", rows)
        remove(*old, hook)
    remove(links)
    return label
