"""Slicing queries over (file, line) relations: each returns slice lines with is_diff.

Relations: diff_lines (file, line); functions (file, name, start_line, end_line); identifiers and definitions
(file, line, name); source_lines (file, line, text). Every range join has the file as its equi-key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables


def enclosing_functions(lines: DataFrame, functions: DataFrame, every: bool = False) -> DataFrame:
    """lines with (name, start_line, end_line) of the innermost function around each; every: of all of them."""
    f = functions.withColumnRenamed("file", "f_file")
    joined = lines.join(f, (F.col("file") == F.col("f_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("f_file")
    if every:
        return joined
    inner = F.min_by(F.struct("name", "start_line", "end_line"), F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), "name"))
    return joined.groupBy(*lines.columns).agg(inner.alias("f")).select(*lines.columns, "f.name", "f.start_line", "f.end_line")


def function_at(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """lines with the function around each that is first by name (not the innermost one)."""
    joined = enclosing_functions(lines, functions, every=True)
    return joined.groupBy(*lines.columns).agg(F.min(F.struct("name", "start_line", "end_line")).alias("f")).select(*lines.columns, "f.name", "f.start_line", "f.end_line")


def original_diff(diff_lines: DataFrame) -> DataFrame:
    return diff_lines.select("file", "line").distinct().withColumn("is_diff", F.lit(True))


def mark(lines: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """lines with is_diff."""
    d = diff_lines.select("file", "line").distinct().withColumn("is_diff", F.lit(True))
    return lines.join(d, ["file", "line"], "left").withColumn("is_diff", F.coalesce("is_diff", F.lit(False)))


def parent_function(diff_lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, name, line, is_diff): all lines of the innermost functions that a diff line touches; lines outside any
    function stand alone, with a null name."""
    diff = diff_lines.select("file", "line").distinct()
    hit = enclosing_functions(diff, functions)
    bodies = hit.select("file", "name", "start_line", "end_line").distinct()
    bodies = bodies.select("file", "name", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    alone = diff.join(hit, ["file", "line"], "left_anti").select("file", F.lit(None).cast("string").alias("name"), "line")
    return mark(bodies.unionByName(alone), diff)


def thin_slice(diff_lines: DataFrame, definitions: DataFrame, identifiers: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, is_diff): diff lines, and the lines of the same function that mention what a diff line defines."""
    diff = diff_lines.select("file", "line").distinct()
    defs = diff.join(definitions.withColumnRenamed("name", "variable"), ["file", "line"])
    spans = enclosing_functions(defs, functions).select("file", "variable", "start_line", "end_line").distinct()
    uses = identifiers.select("file", F.col("name").alias("variable"), "line")
    found = uses.join(spans, ["file", "variable"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("file", "line")
    return mark(found.unionByName(diff).distinct(), diff)


def flow_edges(definitions: DataFrame, identifiers: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, name, def_line, use_line): from each definition to every other line of its function with the name."""
    spans = enclosing_functions(definitions.withColumnRenamed("name", "variable"), functions)
    spans = spans.select("file", "variable", F.col("line").alias("def_line"), "start_line", "end_line")
    uses = identifiers.select("file", F.col("name").alias("variable"), F.col("line").alias("use_line"))
    joined = spans.join(uses, ["file", "variable"]).where(F.col("use_line").between(F.col("start_line"), F.col("end_line")) & (F.col("use_line") != F.col("def_line")))
    return joined.select("file", F.col("variable").alias("name"), "def_line", "use_line").distinct()


def sequential_flow(statements: DataFrame) -> DataFrame:
    """(file, from_line, to_line): consecutive statements of a function unless the first ends the flow.

    statements: (file, function, line, terminates).
    """
    w = Window.partitionBy("file", "function").orderBy("line")
    return statements.withColumn("to_line", F.lead("line").over(w)).where(~F.col("terminates") & F.col("to_line").isNotNull()).select("file", F.col("line").alias("from_line"), "to_line")


def delta(old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The edges in one version only, with change: added or removed."""
    gone = old_edges.distinct().exceptAll(new_edges.distinct()).withColumn("change", F.lit("removed"))
    return gone.unionByName(new_edges.distinct().exceptAll(old_edges.distinct()).withColumn("change", F.lit("added")))


def spiral(rings: list[DataFrame], stop: float = 0.05) -> DataFrame:
    """(file, line, ring): the union of rings (file, line), each line in its first ring; a ring that adds less than
    stop of what was there before ends it. One count a ring."""
    out, size = None, 0
    for k, ring in enumerate(rings, 1):
        new = ring.select("file", "line").distinct()
        if out is not None:
            new = new.join(out, ["file", "line"], "left_anti")
        new = new.withColumn("ring", F.lit(k).cast("long"))
        added = new.count()
        out = new if out is None else out.unionByName(new)
        if size and added / size < stop:
            break
        size += added
    return out


def membrane(diff_lines: DataFrame, functions: DataFrame, calls: DataFrame, source_lines: DataFrame, guards=tables.GUARDED, around: int = 2) -> DataFrame:
    """(file, line, callee): calls from other files into a changed function with no guard word within around lines.

    calls: (file, line, callee_file, callee).
    """
    changed = enclosing_functions(diff_lines.select("file", "line").distinct(), functions).select(F.col("file").alias("callee_file"), F.col("name").alias("callee")).distinct()
    sites = calls.join(changed, ["callee_file", "callee"]).where("file <> callee_file")
    near = source_lines.select(F.col("file").alias("g_file"), F.col("line").alias("g_line"), "text")
    guarded = F.lit(False)
    for g in dict.fromkeys(guards):
        guarded = guarded | F.col("text").contains(g)
    near = near.where(guarded)
    return sites.join(near, (F.col("file") == F.col("g_file")) & F.col("g_line").between(F.col("line") - around, F.col("line") + around), "left_anti").select("file", "line", "callee").distinct()


def nearest_source(sinks: DataFrame, sources: DataFrame) -> DataFrame:
    """sinks (file, line) with source_line: the last source of the file before each, or else its first one.

    One pass over both kinds of lines in order; sinks of files without a source are left out.
    """
    rows = sources.select("file", "line", F.col("line").alias("s")).distinct().unionByName(sinks.select("file", "line").distinct().withColumn("sink", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy("file").orderBy("line").rangeBetween(0, Window.unboundedFollowing)
    found = rows.withColumn("source_line", F.coalesce(F.max("s").over(before), F.min("s").over(from_here)))
    return found.where("sink and source_line is not null").select("file", "line", "source_line")
