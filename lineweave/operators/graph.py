"""Graph queries over edge relations (src, dst): closures, distances, chops, callers, components, cycles.

Unbounded closures are loops over the frontier without what was reached before; each round is cut, and the
loop stops at an empty frontier. All starts travel in one loop, 64 of them as the bits of a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, free


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def numbered(origins: DataFrame) -> DataFrame:
    """(origin, word, bit): a bit for each origin, 64 to a word. Origins that follow each other in order share a word, as
    they often reach the same nodes."""
    own = cut(origins.select("origin").distinct().orderBy("origin").withColumn("id", F.monotonically_increasing_id()))
    # the upper bits of an id are its partition: what stands in those before it is added up, one row a partition
    part = F.shiftright("id", 33)
    before = own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)
    out = own.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", place)
    return cut(out.select("origin", F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, int(place % 64))").alias("bit")))


def walk(edges: DataFrame, starts: DataFrame, numbers: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(word, node, bits, hop): the origins that have their least number of hops to a node, as the bits of numbered().

    A node that many origins reach in one hop is one row for 64 of them, and so is each edge that they pass.
    """
    frontier = starts.select("origin", "node").join(numbers, "origin").groupBy("word", "node").agg(F.bit_or("bit").alias("bits"))
    frontier = cut(frontier.withColumn("hop", F.lit(0).cast("long")))
    reached, hop, none = frontier, 0, F.lit(0).cast("long")
    while max_hops is None or hop < max_hops:
        hop += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("word", F.col("dst").alias("node"), F.col("bits").alias("come"), none.alias("seen"))
        both = step.unionByName(reached.select("word", "node", none.alias("come"), F.col("bits").alias("seen")))
        met = both.groupBy("word", "node").agg(F.bit_or("come").alias("come"), F.bit_or("seen").alias("seen"))
        met = met.select("word", "node", F.col("come").bitwiseAND(F.bitwise_not("seen")).alias("bits"), F.lit(hop).cast("long").alias("hop"))
        frontier = cut(met.where("bits <> 0"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def spelled(packed: DataFrame, numbers: DataFrame) -> DataFrame:
    """packed (word, bits) with a row for each origin among its bits."""
    words = numbers.groupBy("word").agg(F.collect_list(F.struct("bit", "origin")).alias("own"))
    held = F.filter("own", lambda o: o["bit"].bitwiseAND(F.col("bits")) != 0)
    return packed.join(words, "word").withColumn("o", F.explode(held)).select(F.col("o.origin").alias("origin"), *[c for c in packed.columns if c not in ("word", "bits")])


def packed(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """walk() and the numbers of its origins; starts: (origin, node)."""
    # every hop reads the edges again: they are written once, whatever they were made from
    edges, starts = cut(edges.select("src", "dst")), cut(starts.select("origin", "node").distinct())
    numbers = numbered(starts)
    found = walk(edges, starts, numbers, max_hops)
    free(edges, starts)
    return found, numbers


def distances(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(origin, node, hop): the least number of hops from each origin; starts: (origin, node). Origins have hop 0."""
    return spelled(*packed(edges, starts, max_hops)).select("origin", "node", "hop")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(origin, node) with a path from the origin; an origin itself is left out even on a cycle."""
    return distances(edges, starts).where("hop > 0").select("origin", "node")


def has_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) with a path from src to dst; a node has one to itself."""
    found, numbers = packed(edges, pairs.select(F.col("src").alias("origin"), F.col("src").alias("node")))
    asked = pairs.select("src", "dst").distinct().join(numbers.select(F.col("origin").alias("src"), F.col("word").alias("w"), "bit"), "src")
    met = (F.col("w") == F.col("word")) & (F.col("dst") == F.col("node")) & (F.col("bit").bitwiseAND(F.col("bits")) != 0)
    return asked.join(found, met, "left_semi").select("src", "dst")


def paths_between(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """has_path() of every source with every sink, without a row for each pair. sources, sinks: (node)."""
    found, numbers = packed(edges, sources.select(F.col("node").alias("origin"), "node"))
    ends = found.join(sinks.select("node").distinct(), "node", "left_semi")
    return spelled(ends, numbers).select(F.col("origin").alias("src"), F.col("node").alias("dst"))


def chop(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node) on some path from a source to a sink, ends included. sources, sinks: (node)."""
    ahead = distances(edges, sources.select(F.lit(0).alias("origin"), "node")).select("node")
    behind = distances(reverse(edges), sinks.select(F.lit(0).alias("origin"), "node")).select("node")
    return ahead.intersect(behind)


def callers(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, node, depth): callers up to depth; targets: (node). The target itself is left out."""
    found = distances(reverse(edges), targets.select(F.col("node").alias("origin"), "node"), depth)
    return found.where("hop > 0").select(F.col("origin").alias("target"), "node", F.col("hop").alias("depth"))


def callees(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    return callers(reverse(edges), targets, depth)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more; component is the least node.

    Nodes without an edge in or out are trimmed; then each round sends the least id forwards and backwards and takes
    out the nodes where both agree (they are one component).
    """
    left, found = cut(edges.where("src <> dst").select("src", "dst").distinct()), None
    while not left.isEmpty():
        # trim: a node on a cycle has an edge in and an edge out
        while True:
            n = left.count()
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if left.count() == n:
                break
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        least = spread(left, nodes.withColumn("mark", F.col("node")))
        same = left.join(least.select(F.col("node").alias("src"), F.col("mark").alias("ms")), "src").join(least.select(F.col("node").alias("dst"), F.col("mark").alias("md")), "dst").where("ms = md")
        back = spread(reverse(same.select("src", "dst")), nodes.join(least, "node").withColumn("mark", F.when(F.col("node") == F.col("mark"), F.col("mark"))))
        part = cut(least.join(back.select("node", F.col("mark").alias("back")), "node").where("mark = back").select("node", F.col("mark").alias("component")))
        found = part if found is None else found.unionByName(part)
        left = cut(left.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    many = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(many, "component", "left_semi").select("node", "component")


def spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(node, mark): the least mark among a node's own and those of all nodes that reach it."""
    marks = cut(marks.select("node", "mark"))
    while True:
        come = edges.join(marks, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("mark").alias("come"))
        new = marks.join(come, F.col("node") == F.col("dst"), "left").select("node", F.least("mark", "come").alias("mark"), (F.coalesce(F.col("come") < F.col("mark"), F.col("come").isNotNull() & F.col("mark").isNull())).alias("moved"))
        new = cut(new)
        marks = new.select("node", "mark")
        if new.where("moved").isEmpty():
            return marks


def gradient(edges: DataFrame, starts: DataFrame, decay: float = 0.6, cutoff: float = 0.1, max_hops: int = 5) -> DataFrame:
    """(node, hop, score): decay**hop from the nearest start, as long as it is at least cutoff. starts: (node)."""
    found = distances(edges, starts.select(F.lit(0).alias("origin"), "node"), max_hops)
    return found.select("node", "hop", F.pow(F.lit(decay), F.col("hop")).alias("score")).where(F.col("score") >= cutoff)
