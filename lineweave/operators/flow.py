"""Queries that follow flows: callee resolution, taint, left and full flow, conditioned, relevant, vertical, quantum and echo slices.

Flow edges are (file, def_line, use_line) as flow_edges() gives them; a line that a flow reaches passes it on to what it
defines, so walks go from line to line. Every range join has the file as its equi-key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables
from ..plans.lineage import cut, free
from .graph import distances, numbered, reverse, spelled, spread, walk
from .slices import enclosing_functions, mark
from .taint import any_of


def stem(path: Column) -> Column:
    """The text before the first dot of a path's last component."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def resolve_callees(sites: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """sites (file, line, callee, qualifier) with callee_file, one row a candidate.

    A static function of the caller's own file comes first and alone; then functions whose file the qualifier's module
    names; then all but the statics of other files. functions: (file, name, is_static); imports: (file, alias, module).

    Which of the three holds is found out before the candidates, so these leave the last join as they are made: where
    many functions have one name, they are too many to deal out again. Their files stand in lists of at most CANDIDATES.
    """
    key = ["file", "line", "callee", "qualifier"]
    sites = sites.select(*key).distinct()
    there = functions.groupBy(F.col("name").alias("callee"), F.col("file").alias("callee_file")).agg(F.max("is_static").alias("is_static")).withColumn("module", stem(F.col("callee_file")))
    modules = imports.select("file", F.col("alias").alias("qualifier"), stem(F.col("module")).alias("module")).distinct()
    own = there.where("is_static").select("callee", F.col("callee_file").alias("file"))
    named = there.where("module is not null").select("callee", "module").distinct()
    asked = sites.join(own.withColumn("own", F.lit(True)), ["file", "callee"], "left")
    known = asked.where("own is null").join(modules, ["file", "qualifier"], "left").join(named.withColumn("named", F.lit(True)), ["callee", "module"], "left")
    known = known.groupBy(*key).agg(F.collect_set(F.when(F.col("named"), F.col("module"))).alias("modules"))
    first = asked.where("own").select(*key, F.col("file").alias("callee_file"))
    second = known.where("size(modules) > 0").withColumn("module", F.explode("modules"))
    third = known.where("size(modules) = 0")
    return first.unionByName(candidates(second, there, ["callee", "module"])).unionByName(candidates(third, there.where("not is_static"), ["callee"]))


#: Candidates in one row at most, and the parts into which the sites of one name are dealt.
CANDIDATES, PARTS = 4096, 16


def candidates(sites: DataFrame, there: DataFrame, by: list[str]) -> DataFrame:
    """sites with the callee_file of each function that has their by; a file is listed once for all sites."""
    spread_over = F.pmod(F.hash("callee_file"), F.lit(1 << 30))
    size = there.groupBy(*by).agg(F.ceil(F.count("*") / CANDIDATES).alias("chunks"))
    lists = there.join(size, by).groupBy(*by, (spread_over % F.col("chunks")).alias("chunk")).agg(F.collect_list("callee_file").alias("files"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = sites.withColumn("part", F.pmod(F.hash("file", "line"), F.lit(PARTS)))
    return dealt.join(lists, [*by, "part"]).select("file", "line", "callee", "qualifier", F.explode("files").alias("callee_file"))


def line_graph(edges: DataFrame) -> DataFrame:
    """(src, dst) over nodes {file, line}."""
    node = lambda c: F.struct("file", F.col(c).alias("line"))
    return edges.select(node("def_line").alias("src"), node("use_line").alias("dst")).distinct()


def forward(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line): the lines and all that their definitions flow to."""
    starts = lines.select(F.lit(0).alias("origin"), F.struct("file", "line").alias("node"))
    return distances(cut(line_graph(edges)), starts).select("node.file", "node.line").distinct()


def taint(sources: DataFrame, sinks: DataFrame, edges: DataFrame, functions: DataFrame, cleansers: DataFrame) -> DataFrame:
    """(file, sink_line, source_line): sinks that a source's flow reaches on a later line, with the last such source.

    Sources whose innermost function holds a cleanser line are cleansed. All but edges and functions: (file, line).
    """
    spans = enclosing_functions(sources.select("file", "line").distinct(), functions)
    c = cleansers.select(F.col("file").alias("c_file"), F.col("line").alias("c_line"))
    cleansed = spans.join(c, (F.col("file") == F.col("c_file")) & F.col("c_line").between(F.col("start_line"), F.col("end_line")), "left_semi").select("file", "line")
    live = sources.select("file", "line").distinct().join(cleansed, ["file", "line"], "left_anti")
    # the last source that reaches a line is the greatest mark that arrives there, so one row a line is passed on
    graph = cut(line_graph(edges.where("use_line > def_line")))
    nodes = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    own = live.select(F.struct("file", "line").alias("node"), (-F.col("line")).alias("mark"))
    marks = cut(nodes.join(own, "node", "left"))
    inner = spread(graph, marks)
    come = graph.join(inner, F.col("src") == F.col("node")).groupBy("dst").agg((-F.min("mark")).alias("source_line")).where("source_line is not null")
    hits = come.select("dst.file", "dst.line", "source_line").join(sinks.select("file", "line").distinct(), ["file", "line"])
    return hits.select("file", F.col("line").alias("sink_line"), "source_line")


def branch_context(lines: DataFrame, branches: DataFrame, most: int = 5) -> DataFrame:
    """(file, line): of each branch that holds a line, all lines if they are at most most, or else its first and last.

    branches: (file, start_line, end_line).
    """
    b = branches.select(F.col("file").alias("b_file"), "start_line", "end_line")
    held = lines.join(b, (F.col("file") == F.col("b_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("file", "start_line", "end_line").distinct()
    short = F.col("end_line") - F.col("start_line") < most
    return held.select("file", F.explode(F.when(short, F.sequence("start_line", "end_line")).otherwise(F.array("start_line", "end_line"))).alias("line")).distinct()


def left_flow(diff_lines: DataFrame, edges: DataFrame, functions: DataFrame, returns: DataFrame, conditions: DataFrame) -> DataFrame:
    """(file, line, is_diff): diff lines, the first and last lines and the returns of the functions they touch, where
    their definitions flow, and for diff lines that are conditions the definitions they use and where those flow.

    returns, conditions: (file, line).
    """
    diff = diff_lines.select("file", "line").distinct()
    hit = enclosing_functions(diff, functions).select("file", "name", "start_line", "end_line").distinct()
    ends = hit.select("file", F.explode(F.array("start_line", "end_line")).alias("line"))
    inner = enclosing_functions(returns.select("file", "line").distinct(), functions).join(hit.select("file", "name"), ["file", "name"], "left_semi").select("file", "line")
    asked = diff.join(conditions, ["file", "line"], "left_semi").withColumnRenamed("line", "use_line")
    defined = edges.join(asked, ["file", "use_line"], "left_semi").select("file", F.col("def_line").alias("line"))
    found = forward(edges, diff.unionByName(defined))
    return mark(found.unionByName(ends).unionByName(inner).distinct(), diff)


def full_flow(diff_lines: DataFrame, edges: DataFrame, functions: DataFrame, returns: DataFrame) -> DataFrame:
    """left_flow() with every diff line's uses traced back, not only those of conditions."""
    return left_flow(diff_lines, edges, functions, returns, diff_lines.select("file", "line"))


def falsified(text: Column, condition: str) -> Column:
    """What a known condition makes of a branch's text: true (its body can't run), false (its else can't), or null.

    Matches by text: equality and its opposite with or without blanks; "greater" only against "> 0"; other orders never.
    """
    m = re.match(r"\s*(.*?)\s*(!=|==|>=|<=|>|<)\s*(.*?)\s*$", condition)
    if not m:
        return F.lit(None).cast("boolean")
    var, op, value = m.groups()
    says = lambda o, v: text.contains(f"{var} {o} {v}") | text.contains(f"{var}{o}{v}")
    if op in ("==", "!="):
        return F.when(says("==", value), op == "!=").when(says("!=", value), op == "==")
    if op == ">" and re.fullmatch(r"[+-]?[0-9]+", value):
        return F.when(says(">", 0), int(value) <= 0)
    return F.lit(None).cast("boolean")


def conditioned(lines: DataFrame, branches: DataFrame, condition: str) -> DataFrame:
    """The lines that can run if the condition holds. branches: (file, text, then_start, then_end, else_start, else_end)."""
    f = falsified(F.col("text"), condition)
    pick = lambda end: F.when(f, F.col(f"then_{end}")).when(~f, F.col(f"else_{end}"))
    dead = branches.select(F.col("file").alias("d_file"), pick("start").alias("d_start"), pick("end").alias("d_end")).where("d_start is not null")
    return lines.join(dead, (F.col("file") == F.col("d_file")) & F.col("line").between(F.col("d_start"), F.col("d_end")), "left_anti")


def relevant(lines: DataFrame, cfg_edges: DataFrame, branches: DataFrame, depth: int = 5) -> DataFrame:
    """(file, line): lines, and of each way out of one of their branches that leaves them the first depth statements.

    cfg_edges: (file, from_line, to_line); branches: (file, line).
    """
    base = lines.select("file", "line").distinct()
    taken = base.join(branches, ["file", "line"], "left_semi")
    ways = cfg_edges.join(taken.withColumnRenamed("line", "from_line"), ["file", "from_line"], "left_semi").select("file", F.col("to_line").alias("line")).distinct()
    ways = ways.join(base, ["file", "line"], "left_anti")
    node = F.struct("file", "line")
    walk = distances(line_graph(cfg_edges.select("file", F.col("from_line").alias("def_line"), F.col("to_line").alias("use_line"))), ways.select(node.alias("origin"), node.alias("node")), depth - 1)
    first = walk.withColumn("at", F.row_number().over(Window.partitionBy("origin").orderBy("hop", "node"))).where(F.col("at") <= depth)
    return base.unionByName(first.select("node.file", "node.line")).distinct()


def vertical(edges: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """(target, node, place): callers (places below 0, the farthest least), the target (0) and callees; a node that is
    both caller and callee stands as caller."""
    edges, starts = cut(edges.select("src", "dst")), cut(targets.select(F.col("node").alias("origin"), "node").distinct())
    numbers = numbered(starts)
    up, down = walk(reverse(edges), starts, numbers, depth).where("hop > 0"), walk(edges, starts, numbers, depth)
    free(edges, starts)
    taken = up.groupBy("word", "node").agg(F.bit_or("bits").alias("taken"))
    # the target itself, at hop 0, is never among its callers
    rest = down.join(taken, ["word", "node"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("taken", F.lit(0).cast("long")))))
    places = up.select("word", "node", "bits", (-F.col("hop")).alias("place")).unionByName(rest.where("bits <> 0").select("word", "node", "bits", F.col("hop").alias("place")))
    return spelled(places, numbers).select(F.col("origin").alias("target"), "node", "place")


def quantum(assignments: DataFrame, async_points: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, name, after, before): assignments whose value depends on an asynchronous line of the innermost
    function: one stands before them (after) or behind them (before). assignments: (file, line, name)."""
    a = enclosing_functions(assignments.withColumnRenamed("name", "variable"), functions).select("file", "line", "variable", F.col("name").alias("function"), "start_line", "end_line")
    points = async_points.select(F.col("file").alias("p_file"), F.col("line").alias("p"))
    joined = a.join(points, (F.col("file") == F.col("p_file")) & F.col("p").between(F.col("start_line") + 1, F.col("end_line") - 1))
    found = joined.groupBy("file", "line", F.col("variable").alias("name")).agg(F.bool_or(F.col("p") < F.col("line")).alias("after"), F.bool_or(F.col("p") > F.col("line")).alias("before"))
    return found.where("after or before")


def echo(calls: DataFrame, changed: DataFrame, source_lines: DataFrame, functions: DataFrame, words=tables.HANDLED, ahead: int = 3, behind: int = 5) -> DataFrame:
    """(file, line, callee): calls of changed functions with no handling text from ahead lines before the call to behind
    lines after it (within the caller), the lines joined by blanks. calls: (file, line, callee_file, callee); changed:
    (callee_file, callee)."""
    sites = enclosing_functions(calls.join(changed, ["callee_file", "callee"], "left_semi").select("file", "line", "callee").distinct(), functions)
    # each site asks for at most ahead + behind + 1 lines, by number
    asked = sites.withColumn("h", F.explode(F.sequence(F.greatest(F.col("line") - ahead, F.lit(1)), F.least(F.col("line") + behind, "end_line"))))
    near = source_lines.select("file", F.col("line").alias("h"), "text")
    texts = asked.join(near, ["file", "h"]).groupBy("file", "line", "callee").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "text"))), lambda x: x["text"]), " ").alias("context"))
    return texts.where(~any_of(F.col("context"), words)).select("file", "line", "callee")
