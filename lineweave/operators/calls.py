"""Call graph over the relations of sources/code.py: resolution, indirect calls, dispatch, types, and the joined program graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flow import resolve_callees
from .graph import distances

KEY = ["file", "function", "fn_line"]


def resolved(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """calls within functions with callee_file, one row a target that the name may mean."""
    sites = calls.where("function is not null").select("file", "line", "callee", "qualifier").distinct()
    one = functions.select("file", "name", "is_static")
    # a null qualifier joins nothing, as it should: it names no module
    found = resolve_callees(sites.withColumn("qualifier", F.coalesce("qualifier", F.lit(""))), one, imports)
    found = found.withColumn("qualifier", F.when(F.col("qualifier") != "", F.col("qualifier")))
    keep = calls.where("function is not null").select("file", "function", "fn_line", "line", "callee", "qualifier").distinct()
    same = (keep.file == found.file) & (keep.line == found.line) & (keep.callee == found.callee) & keep.qualifier.eqNullSafe(found.qualifier)
    return keep.join(found, same).select(keep.file, "function", "fn_line", keep.line, keep.callee, keep.qualifier, "callee_file")


def indirect(calls: DataFrame, functions: DataFrame, aliases: DataFrame, accesses: DataFrame, parameters: DataFrame) -> DataFrame:
    """(file, function, line, callee, target, level): calls of names that are no function, by what the name may hold.

    1: the last function that the caller assigns to the name, or else one that the file's top level assigns; 2: functions
    in the value that an array of that name is written with; 4: functions that any file assigns to a field of that name
    (calls with a qualifier only); 3: the name is a parameter of the caller: functions among the arguments of its own
    callers. Levels 1 and 2 come first, then 4, then 3; a site that has a target goes no further.
    """
    names = functions.select(F.col("name").alias("target")).distinct()
    sites = calls.where("function is not null").select(*KEY, "line", "callee", "qualifier", "args").join(names, F.col("callee") == F.col("target"), "left_anti")
    held = aliases.join(names, "target")
    local = held.where("function is not null").groupBy(*KEY, F.col("alias").alias("callee")).agg(F.max_by("target", "line").alias("target"))
    top = held.where("function is null").groupBy("file", F.col("alias").alias("callee")).agg(F.max_by("target", "line").alias("target"))
    out = ["file", "function", "line", "callee", "target"]
    one = sites.join(local, [*KEY, "callee"]).select(*out, F.lit(1).alias("level"))
    rest = sites.join(local, [*KEY, "callee"], "left_anti")
    one = one.unionByName(rest.join(top, ["file", "callee"]).select(*out, F.lit(1).alias("level")))
    written = accesses.where("access = 'def'").select("file", "line", F.col("base").alias("callee")).join(accesses.where("access = 'use'").select("file", "line", F.col("base").alias("target")).join(names, "target"), ["file", "line"])
    arrays = sites.where("qualifier is null").join(written.select("file", "callee", "target").distinct(), ["file", "callee"]).select(*out, F.lit(2).alias("level"))
    first = one.unionByName(arrays.join(one.select("file", "function", "line"), ["file", "function", "line"], "left_anti"))
    fields = held.where(F.col("alias").contains(".")).select(F.substring_index("alias", ".", -1).alias("callee"), "target").distinct()
    left = sites.join(first.select("file", "function", "line"), ["file", "function", "line"], "left_anti")
    four = left.where("qualifier is not null").join(fields, "callee").select(*out, F.lit(4).alias("level"))
    left = left.join(four.select("file", "function", "line"), ["file", "function", "line"], "left_anti")
    mine = left.join(parameters.select(*KEY, F.col("name").alias("callee"), "index"), [*KEY, "callee"])
    theirs = calls.select(F.col("callee").alias("function"), F.posexplode("args").alias("index", "arg"), F.col("file").alias("from_file"), F.col("function").alias("from_function"))
    passed = mine.join(theirs, ["function", "index"])
    direct = passed.join(names, F.col("arg") == F.col("target")).select(*out)
    by_name = passed.join(local.select(F.col("file").alias("from_file"), F.col("function").alias("from_function"), F.col("callee").alias("arg"), "target"), ["from_file", "from_function", "arg"]).select(*out)
    return first.unionByName(four).unionByName(direct.unionByName(by_name).select(*out, F.lit(3).alias("level"))).distinct()


def callers_into(found: DataFrame, targets: DataFrame) -> DataFrame:
    """The resolved call sites whose target is one of targets (callee, callee_file)."""
    return found.join(targets, ["callee", "callee_file"], "left_semi")


def live_types(made: DataFrame, types: DataFrame) -> DataFrame:
    """(name): types that some file makes an instance of."""
    return made.select("name").distinct().join(types.select("name"), "name", "left_semi")


def ancestors(types: DataFrame) -> DataFrame:
    """(name, ancestor): the closure of the bases that types name."""
    edges = types.select(F.col("name").alias("src"), F.explode("bases").alias("dst")).distinct()
    return distances(edges, edges.select(F.col("src").alias("origin"), F.col("src").alias("node"))).where("hop > 0").select(F.col("origin").alias("name"), F.col("node").alias("ancestor"))


def dispatch(calls: DataFrame, functions: DataFrame, live: DataFrame) -> DataFrame:
    """(file, line, callee, callee_file, owner): calls of a method's name with the methods of that name in live types; where
    none of the types that have it is live, in all of them."""
    methods = functions.where("owner is not null").select(F.col("name").alias("callee"), F.col("file").alias("callee_file"), "owner").distinct()
    marked = methods.join(live.select(F.col("name").alias("owner"), F.lit(True).alias("alive")).distinct(), "owner", "left")
    any_live = marked.groupBy("callee").agg(F.bool_or(F.coalesce("alive", F.lit(False))).alias("any_live"))
    targets = marked.join(any_live, "callee").where("alive or not any_live")
    return calls.where("function is not null and qualifier is not null").select("file", "line", "callee").distinct().join(targets, "callee").select("file", "line", "callee", "callee_file", "owner")


def satisfies(types: DataFrame, fields: DataFrame, functions: DataFrame) -> DataFrame:
    """(interface, type): types that have every method an interface asks for (relational division); empty interfaces are left out."""
    asked = fields.join(types.where(F.col("kind").isin("interface", "trait")).select(F.col("name").alias("type")).distinct(), "type", "left_semi").select(F.col("type").alias("interface"), F.col("field").alias("method")).distinct()
    size = asked.groupBy("interface").agg(F.count("*").alias("size"))
    has = functions.where("owner is not null").select(F.col("owner").alias("type"), F.col("name").alias("method")).distinct()
    met = asked.join(has, "method").groupBy("interface", "type").agg(F.count("*").alias("met"))
    return met.join(size, "interface").where("met = size and type <> interface").select("interface", "type")


def program_nodes(functions: DataFrame, accesses: DataFrame, statements: DataFrame) -> DataFrame:
    """(node, kind, file, line, name): functions (the last of those with one name in a file), variables and statements."""
    f = functions.groupBy("file", "name").agg(F.max("start_line").alias("line")).select(F.lit("function").alias("kind"), "file", F.col("line").cast("int").alias("line"), "name")
    v = accesses.where("function is not null").select(F.lit("variable").alias("kind"), "file", "line", F.concat_ws(":", "function", "path", "access").alias("name")).distinct()
    s = statements.select(F.lit("statement").alias("kind"), "file", "line", F.lit("").alias("name")).distinct()
    rows = f.unionByName(v).unionByName(s)
    return rows.withColumn("node", F.xxhash64("kind", "file", "line", "name"))


def program_edges(flow: DataFrame, found: DataFrame, arguments: DataFrame, statements: DataFrame, control: DataFrame) -> DataFrame:
    """(kind, file, line, to_file, to_line): data flow, arguments, calls and returns, containment, and control flow."""
    edge = lambda df, kind, file, line, to_file, to_line: df.select(F.lit(kind).alias("kind"), F.col(file).alias("file"), F.col(line).cast("int").alias("line"), F.col(to_file).alias("to_file"), F.col(to_line).cast("int").alias("to_line"))
    parts = [
        edge(flow, "flow", "file", "def_line", "file", "use_line"),
        edge(arguments, "argument", "file", "line", "to_file", "to_line"),
        edge(found, "call", "file", "line", "callee_file", "callee_line"),
        edge(found, "return", "callee_file", "callee_line", "file", "line"),
        edge(statements, "contains", "file", "fn_line", "file", "line"),
        edge(control, "control", "file", "from_line", "file", "to_line"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
