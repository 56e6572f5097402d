"""Data flow from the relations of sources/code.py: aliases, references, Def-Use edges, closures and chops over them.

A node of the flow graph is (file, function, line, path, access). Edges run from a Def to every reference of its path in
the function (there is no kill), and from an argument to the parameter it becomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from .graph import distances, reverse

KEY = ["file", "function", "fn_line"]
#: Hops of an alias chain, and of the base of a dotted target.
CHAIN, BASE = 10, 5


def alias_targets(aliases: DataFrame) -> DataFrame:
    """(file, function, fn_line, alias, target): what each alias stands for at last; the last definition of an alias wins,
    chains are followed for CHAIN hops, the base of a dotted target for BASE."""
    plain = aliases.where(~F.col("alias").contains("."))
    last = plain.groupBy(*KEY, "alias").agg(F.max_by("target", "line").alias("target"))
    found, step = last, last.select(*KEY, F.col("alias").alias("via"), F.col("target").alias("further"))
    for hop in range(CHAIN):
        base = F.substring_index("target", ".", 1)
        key = base if hop < BASE else F.col("target")
        joined = found.withColumn("via", key).join(step, [*KEY, "via"], "left")
        rest = F.substring(F.col("target"), F.length("via") + 1, 1 << 20)
        # a name that comes back to itself stays as it is
        further = F.when(F.col("further").isNotNull() & (F.substring_index("further", ".", 1) != F.col("alias")), F.concat("further", rest)).otherwise(F.col("target"))
        found = joined.select(*KEY, "alias", further.alias("target"))
    return found


def references(identifiers: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, function, fn_line, line, name): every mention of a name within a function; nested functions each have it."""
    f = functions.select("file", F.col("name").alias("function"), F.col("start_line").alias("fn_line"), "end_line")
    return identifiers.select("file", "line", "name").distinct().join(f, "file").where(F.col("line").between(F.col("fn_line"), F.col("end_line"))).select(*KEY, "line", "name").distinct()


def scoped_references(refs: DataFrame, defs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file, function, fn_line, name, def_line, line): references of each def (…, name, def_line), without those in an inner
    scope that declares the name again and does not hold the def. scopes: (file, function, start_line, end_line, name)."""
    pairs = defs.select(*KEY, "name", "def_line").distinct().join(refs, [*KEY, "name"])
    s = scopes.select("file", "function", "name", F.col("start_line").alias("s0"), F.col("end_line").alias("s1"))
    hides = [pairs[c] == s[c] for c in ("file", "function", "name")] + [F.col("line").between(F.col("s0"), F.col("s1")) & ~F.col("def_line").between(F.col("s0"), F.col("s1"))]
    return pairs.join(s, hides, "left_anti")


def bare_references(refs: DataFrame, accesses: DataFrame) -> DataFrame:
    """(file, function, fn_line, name): names that a function uses other than as the base of a path, outside its first line."""
    return accesses.where("path = base and access = 'use' and line <> fn_line").select(*KEY, F.col("base").alias("name")).distinct().join(refs.select(*KEY, "name").distinct(), [*KEY, "name"], "left_semi")


def data_flow(accesses: DataFrame, refs: DataFrame, parameters: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file, function, path, def_line, use_line): the Def-Use edges of each function.

    Defs are what statements write, and the parameters that have bare references, at the function's first line. A plain
    name reaches every scoped reference of it but its own line, earlier ones too; a path with fields reaches later lines
    with the same path.
    """
    inner = accesses.where("function is not null")
    params = parameters.select(*KEY, "name").join(bare_references(refs, inner), [*KEY, "name"], "left_semi").select(*KEY, "name", F.col("fn_line").alias("def_line"))
    plain = inner.where("access = 'def' and path = base").select(*KEY, F.col("base").alias("name"), F.col("line").alias("def_line")).unionByName(params).distinct()
    simple = scoped_references(refs, plain, scopes).where("line <> def_line").select(*KEY, F.col("name").alias("path"), "def_line", F.col("line").alias("use_line"))
    dotted = inner.where("access = 'def' and path <> base").select(*KEY, "path", F.col("line").alias("def_line")).distinct()
    later = inner.select(*KEY, "path", F.col("line").alias("use_line")).distinct()
    fields = dotted.join(later, [*KEY, "path"]).where("use_line > def_line")
    return simple.unionByName(fields.select(simple.columns)).distinct()


def flow_graph(edges: DataFrame, accesses: DataFrame | None = None) -> DataFrame:
    """(src, dst) over nodes {file, function, line, path, access}: the edges, and with accesses the step within a line from what
    it reads to what it writes."""
    node = lambda line, path, access: F.struct("file", F.col(line).cast("int").alias("line"), F.col(path).alias("path"), F.lit(access).alias("access"))
    out = edges.select(node("def_line", "path", "def").alias("src"), node("use_line", "path", "use").alias("dst"))
    if accesses is not None:
        w = accesses.where("access = 'def'").select("file", "line", F.col("path").alias("written"))
        # a path is read where it stands, and its base with it
        r = accesses.where("access = 'use'").select("file", "line", F.explode(F.array("path", "base")).alias("path")).distinct()
        out = out.unionByName(r.join(w, ["file", "line"]).select(node("line", "path", "use").alias("src"), node("line", "written", "def").alias("dst")))
    return out.distinct()


def starts_at(lines: DataFrame, edges: DataFrame, access: str, column: str) -> DataFrame:
    """(origin, node): the nodes of one kind on lines (file, line)."""
    at = edges.select("file", F.col(column).alias("line"), "path").distinct().join(lines.select("file", "line").distinct(), ["file", "line"])
    node = F.struct("file", F.col("line").cast("int").alias("line"), "path", F.lit(access).alias("access"))
    return at.select(node.alias("origin"), node.alias("node"))


def forward(edges: DataFrame, accesses: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, origin, line): lines that the Defs on each line (file, line) reach, by flow and by what their lines write."""
    graph = cut(flow_graph(edges, accesses))
    found = distances(graph, starts_at(lines, edges, "def", "def_line")).where("hop > 0")
    return found.select("node.file", F.col("origin.line").alias("origin"), "node.line").distinct()


def backward(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, origin, line): Defs that reach the Uses on each line, by flow edges alone."""
    graph = cut(reverse(flow_graph(edges)))
    found = distances(graph, starts_at(lines, edges, "use", "use_line")).where("hop > 0")
    return found.select("node.file", F.col("origin.line").alias("origin"), "node.line").distinct()


def chop(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(file, line) on a flow path from a source line to a sink line of the same file, both always included."""
    ahead = cut(flow_graph(edges))
    a = distances(ahead, starts_at(sources, edges, "def", "def_line")).select("node").distinct()
    b = distances(reverse(ahead), starts_at(sinks, edges, "use", "use_line")).select("node").distinct()
    met = a.intersect(b).select("node.file", "node.line")
    return met.unionByName(sources.select("file", F.col("line").cast("int"))).unionByName(sinks.select("file", F.col("line").cast("int"))).distinct()


def cfg_chop(chopped: DataFrame, after_source: DataFrame, before_sink: DataFrame) -> DataFrame:
    """The lines of a chop that control reaches from a source and that reach a sink, ends included.

    after_source, before_sink: (file, origin, line) as from control.reachable_lines().
    """
    reach = lambda df: df.select("file", "line").unionByName(df.select("file", F.col("origin").alias("line"))).distinct()
    return chopped.intersect(reach(after_source)).intersect(reach(before_sink))


def with_control(reached: DataFrame, control: DataFrame) -> DataFrame:
    """reached (file, origin, line) without lines of the origin's file that control does not lead to. control: (file, origin, line)."""
    known = control.select("file", "origin").distinct()
    judged = reached.join(known, ["file", "origin"], "left_semi")
    free = reached.join(known, ["file", "origin"], "left_anti")
    return judged.where("line = origin").unionByName(judged.where("line <> origin").join(control, ["file", "origin", "line"], "left_semi")).unionByName(free).distinct()


def argument_flow(calls: DataFrame, functions: DataFrame, accesses: DataFrame) -> DataFrame:
    """(file, line, path, to_file, to_line, parameter): arguments that become parameters of functions resolved by name.

    calls: with callee_file; the argument's text before a dot or arrow must be something that the call's line mentions.
    """
    arg = calls.select("file", "line", "callee", "callee_file", F.posexplode("args").alias("k", "arg"))
    base = F.regexp_extract("arg", r"^\s*([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    f = functions.select(F.col("file").alias("callee_file"), F.col("name").alias("callee"), F.col("start_line").alias("to_line"), F.posexplode("params").alias("k", "parameter"))
    found = arg.withColumn("path", base).join(f, ["callee_file", "callee", "k"])
    here = accesses.select("file", "line", F.col("base").alias("path")).distinct()
    return found.join(here, ["file", "line", "path"], "left_semi").select("file", "line", "path", F.col("callee_file").alias("to_file"), "to_line", "parameter").distinct()


def definitions_of(accesses: DataFrame, names: DataFrame) -> DataFrame:
    """(file, name, function, line): every Def of a name (file, name) in its file, in any function."""
    d = accesses.where("access = 'def'").select("file", F.col("base").alias("name"), "function", "line").distinct()
    return d.join(names, ["file", "name"], "left_semi")


def nodes_at(accesses: DataFrame, points: DataFrame) -> DataFrame:
    """(file, line, function, path, access) of the variable nodes on points (file, line)."""
    return accesses.select("file", "line", "function", "path", "access").distinct().join(points, ["file", "line"], "left_semi")


def first_statement(statements: DataFrame, points: DataFrame) -> DataFrame:
    """points (file, line) with the kind of the first statement there."""
    w = Window.partitionBy("file", "line").orderBy("fn_line")
    rows = statements.withColumn("r", F.row_number().over(w)).where("r = 1")
    return points.join(rows.select("file", "line", "kind"), ["file", "line"])
