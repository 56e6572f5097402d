"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Equal vectors of a label are one class. The classes of a label are dealt into blocks of about BLOCK vectors; each
block's cover tree has nested levels with halving radii, and each pair of blocks of a label is one task that walks two
trees at once: a node pair whose balls lie too far apart is left out, one whose balls lie wholly within reach is
linked as a whole, and only what remains is compared vector by vector in double precision. A task returns one row for
each linked vector (its number of links there, and a link to a spanning forest), never the pairs.

Vectors that are null, zero, or hold null or non-finite components, rows without a label, and vectors of another
dimension link with nothing. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .components import components

#: The least cosine of a link, vectors in a block, vectors in a leaf, and the slack of distance bounds.
COSINE, BLOCK, LEAF, SLACK = 0.93, 2048, 32, 1e-9


class Node:
    """A ball: the index of its centre, its radius, its points, and children (none in a leaf)."""

    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def build(x: np.ndarray, points: np.ndarray, reach: float = 2.0) -> Node:
    """The cover tree of x[points]: children are a greedy net of half the level's radius.

    Where a net needs a child for every fourth point, halving tells nothing apart and the node stays a leaf, which is
    then compared as a whole.
    """
    centre = x[points[0]]
    radius = float(np.sqrt(np.maximum(((x[points] - centre) ** 2).sum(1), 0)).max())
    while reach > radius and reach > 1e-12:
        reach /= 2
    children: list[np.ndarray] = []
    if len(points) > LEAF and radius > 0:
        left = points
        while len(left) and len(children) <= len(points) // 4:
            near = ((x[left] - x[left[0]]) ** 2).sum(1) <= reach * reach
            near[0] = True
            children.append(left[near])
            left = left[~near]
        if len(left) or len(children) < 2:
            children = []
    return Node(centre, radius, points, [build(x, c, reach / 2) for c in children])


class Links:
    """Link counts and a spanning forest of one task."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.weight, self.cosine = x, weight, cosine
        self.far = math.sqrt(2 - 2 * cosine)
        self.count, self.root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        self.walked = 0

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def unite(self, pairs) -> None:
        for i, j in pairs:
            a, b = self.find(int(i)), self.find(int(j))
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All pairs of two leaves, in strips of rows."""
        for at in range(0, len(a), 512):
            rows = a[at : at + 512]
            linked = self.x[rows] @ self.x[b].T >= self.cosine
            if same:
                linked[np.arange(len(rows)), at + np.arange(len(rows))] = False
            self.count[rows] += linked @ self.weight[b]
            if not same:
                self.count[b] += self.weight[rows] @ linked
            # unite along one link of each row between different trees until none is left
            while linked.any():
                i = np.flatnonzero(linked.any(1))
                self.unite(zip(rows[i], b[linked[i].argmax(1)], strict=True))
                tree = lambda p: np.array([self.find(int(q)) for q in p])
                linked &= tree(rows)[:, None] != tree(b)[None, :]

    def walk(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.walked += 1
            same = a is b
            apart = 0.0 if same else float(np.sqrt(((a.centre - b.centre) ** 2).sum()))
            if apart - a.radius - b.radius > self.far + SLACK:
                continue
            if apart + a.radius + b.radius < self.far - SLACK:
                wa, wb = self.weight[a.points].sum(), self.weight[b.points].sum()
                if same:
                    self.count[a.points] += wa - self.weight[a.points]
                else:
                    self.count[a.points] += wb
                    self.count[b.points] += wa
                self.unite((a.points[0], p) for p in (a.points if same else np.concatenate([a.points, b.points])))
            elif same and a.children:
                c = a.children
                todo += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
            elif a.children and (a.radius >= b.radius or not b.children):
                todo += [(c, b) for c in a.children]
            elif b.children:
                todo += [(a, c) for c in b.children]
            else:
                self.compare(a.points, b.points, same)


def join_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """One task: columns i, j, block, rep, n, embedding. Returns rep, links, root for linked vectors."""
    group = group.sort_values("rep", kind="stable")
    x = np.array([np.asarray(v, dtype=np.float64) for v in group["embedding"]])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rep, block = group["rep"].to_numpy(), group["block"].to_numpy()
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    links = Links(x, group["n"].to_numpy().astype(np.int64), COSINE)
    sides = [np.flatnonzero(block == k) for k in (i, j)]
    if len(sides[0]) and len(sides[1]):
        one = build(x, sides[0])
        links.walk(one, one if i == j else build(x, sides[1]))
    at = np.flatnonzero(links.count > 0)
    return pd.DataFrame({"rep": rep[at], "links": links.count[at], "root": rep[[links.find(int(p)) for p in at]] if len(at) else rep[:0]})


def usable(vectors: DataFrame) -> DataFrame:
    """Only the rows that can link, with the dimension; components as they are."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(ok).withColumn("dim", F.size("embedding"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: n_links, component_id (least vec_id within reach), kept."""
    if cosine != COSINE:
        raise ValueError(f"the link threshold is {COSINE}")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = usable(vectors)
    classes = cut(good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block b meets every block k of its label in the task (least, greatest)
    k = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")
    met = dealt.select("label", "dim", "block", "rep", "n", "embedding", k)
    met = met.select("label", "dim", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "rep", "n", "embedding")
    found = cut(met.groupBy("label", "dim", "i", "j").applyInPandas(join_blocks, "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select("rep", "root"))
    facts = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    facts = facts.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", "label", "embedding").join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    ok = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    alone = vectors.where(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ok)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
