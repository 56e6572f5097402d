"""Connected components of a table of links: local forests, then alternating large-star and small-star rounds.

Each task first replaces its links by a forest of stars (no link is lost by that, and no shuffle is needed). A round
then replaces each node's links by links to the least node of its neighbourhood; aggregation comes before every shuffle,
nothing is gathered on the driver but one number a round, and each round starts from a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, free

#: Links that a task gathers before it replaces them by their forest.
HELD = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the links u-v, for every node but the least ones."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        # hook the greater root of each link onto the lesser one, then let all labels jump to their roots
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def forest(links: DataFrame) -> DataFrame:
    """(u, v), u > v: links with those of each partition replaced by stars; links: two columns of longs."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > HELD:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                # stars of n nodes have less than n links: keep on if they don't shrink any more
                size = 0
        if held:
            u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def star(links: DataFrame, large: bool) -> DataFrame:
    """(u, v, moved) of links (u, v), u > v. Large: each node's greater neighbours go to its least one; small: its smaller ones do."""
    both = links.union(links.select(F.col("v"), F.col("u"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
    # a node's link to its least neighbour stays, every other neighbour is linked to that one
    stays = F.col("v") == F.col("m")
    return joined.select(F.when(stays, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (~stays).alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; links: two columns of node ids, in either order.

    component is the least node that can be reached. Null and self links are left out. The rounds end when no star moves
    a link: then no node has both a lesser and a greater neighbour, and none has two lesser ones.
    """
    a, b = (F.col(c).cast("long") for c in links.columns)
    now = cut(forest(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")))
    moved = not now.isEmpty()  # of an empty plan nothing would be observed
    while moved:
        step, seen = now, []
        for large in (True, False):
            seen.append(Observation())
            step = star(step, large).observe(seen[-1], F.count_if("moved").alias("n")).select("u", "v")
        new = cut(forest(step))
        free(now)
        now, moved = new, any(s.get["n"] for s in seen)
    # copies of a link may be left in different partitions
    now = now.groupBy("u").agg(F.min("v").alias("v"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
