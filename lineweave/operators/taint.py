"""Taint over code relations: seeds, sinks by name and by call, cleansers, findings. The tables are in functions/tables.py.

Table rows are turned into small DataFrames (a few hundred rows, fixed by the module) and joined on the call's name, so
that a join key and not a scan of the table finds what matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables


def any_of(text: Column, words) -> Column:
    """Whether the text has one of the words in it."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in dict.fromkeys(words)], F.lit(False))


def frameworks(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, framework): the first framework of the list whose module a file imports and whose texts stand in it.

    files: (file, lang, source).
    """
    rows = files.join(imports.groupBy("file").agg(F.collect_set("module").alias("modules")), "file")
    pick = F.lit(None).cast("string")
    for name, langs, modules, texts, _ in reversed(tables.FRAMEWORKS):
        named = lambda m: reduce(lambda a, b: a | b, [m.startswith(x[:-1]) if x.endswith("*") else m == x for x in modules])  # noqa: B023, E731
        has = F.col("lang").isin(*langs) & F.exists("modules", named) & (any_of(F.col("source"), texts) if texts else F.lit(True))
        pick = F.when(has, F.lit(name)).otherwise(pick)
    return rows.select("file", pick.alias("framework")).where("framework is not null")


def framework_sources(found: DataFrame, parameters: DataFrame, calls: DataFrame, accesses: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, line, name, framework): where a request's data comes in. name: the parameter for JavaScript handlers, else null.

    Go: the framework's calls and paths with the request parameter's own name in place of theirs. Flask: what is read from
    the imported request. Express, Koa, Fastify: the handler's request parameter at the function's first line.
    """
    spark = found.sparkSession
    rows = [(n, p.split(".")[0], p.split(".", 1)[1]) for n, langs, _, _, paths in tables.FRAMEWORKS if "go" in langs for p in paths]
    paths = F.broadcast(spark.createDataFrame(rows, "framework string, holder string, rest string"))
    typed = parameters.join(found, "file").where("(framework = 'gin' and type = '*gin.Context') or (framework in ('net/http', 'gorilla/mux') and type = '*http.Request')")
    wanted = typed.select("file", "function", "framework", F.col("name").alias("param")).join(paths, "framework").select("file", "function", "framework", F.concat_ws(".", "param", "rest").alias("full"))
    called = calls.select("file", "function", "line", F.concat_ws(".", "qualifier", "callee").alias("full"))
    read = accesses.where("access = 'use'").select("file", "function", "line", F.col("path").alias("full"))
    go = called.unionByName(read).join(wanted, ["file", "function", "full"]).select("file", "line", F.lit(None).cast("string").alias("name"), "framework")
    request = imports.where("module = 'flask' and name = 'request'").select("file", "alias")
    flask = accesses.where("access = 'use'").join(found.where("framework = 'flask'"), "file").join(request, "file").where("base = alias and path <> base").select("file", "line", F.lit(None).cast("string").alias("name"), "framework")
    first = parameters.where("index = 0").select("file", "function", "fn_line", "name")
    second = parameters.where("index = 1").select("file", "function", "fn_line", F.col("name").alias("second"))
    handlers = first.join(second, ["file", "function", "fn_line"], "left").join(found, "file")
    js = handlers.where("(framework = 'express' and name in ('req', 'request') and second in ('res', 'response')) or (framework = 'koa' and name in ('ctx', 'context')) or (framework = 'fastify' and name in ('request', 'req'))")
    return go.unionByName(flask).unionByName(js.select("file", F.col("fn_line").alias("line"), "name", "framework")).distinct()


def ipc_sources(lines: DataFrame, diff_files: DataFrame) -> DataFrame:
    """(file, line): lines of changed C and C++ files that read from another process. lines: (file, lang, line, code)."""
    return lines.where(F.col("lang").isin("c", "cpp")).join(diff_files, "file", "left_semi").where(any_of(F.col("code"), tables.IPC_SOURCES)).select("file", "line")


def dynamic_sinks(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(name): variadic functions that call a printing function themselves; they are sinks by their whole name."""
    inner = calls.where(F.col("callee").isin(*tables.PRINTERS)).select("file", F.col("function").alias("name"))
    return functions.where("is_variadic").select("file", "name").join(inner, ["file", "name"], "left_semi").select("name").distinct()


def flat_sinks(targets: DataFrame, identifiers: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """(file, line, name): identifiers on lines that a tainted value reaches and that name a sink. targets: (file, line)."""
    here = identifiers.join(targets.select("file", "line").distinct(), ["file", "line"], "left_semi").distinct()
    whole, parts = [s[1:] for s in tables.FLAT_SINKS if s[0] == "="], [s for s in tables.FLAT_SINKS if s[0] != "="]
    out = here.where(F.col("name").isin(*dict.fromkeys(whole)) | any_of(F.col("name"), parts))
    return out if wrappers is None else out.unionByName(here.join(wrappers, "name", "left_semi")).distinct()


def sink_table(spark: SparkSession) -> DataFrame:
    """(lang, path, callee, category, index, rule): the structured sinks, a row an argument."""
    rows = [(lang, p, p.rsplit(".", 1)[-1], category, i, rule, k) for k, (langs, category, indices, rule, paths) in enumerate(tables.STRUCTURED_SINKS) for lang in langs for p in paths for i in indices]
    return spark.createDataFrame(rows, "lang string, path string, callee string, category string, index int, rule string, entry int")


def structured_sinks(calls: DataFrame, langs: DataFrame, reached: DataFrame) -> DataFrame:
    """(file, line, path, category): calls with a tainted argument where it matters.

    langs: (file, lang); reached: (file, line, base): what is tainted on its own line. A sink without a dot is met by any
    call of that name, one with dots by that whole path. Words inside string literals don't taint.
    """
    sinks = F.broadcast(sink_table(calls.sparkSession))
    named = calls.join(langs, "file").withColumn("full", F.concat_ws(".", "qualifier", "callee")).join(sinks, ["lang", "callee"])
    named = named.where((F.col("path") == F.col("full")) | ~F.col("path").contains("."))
    arg = lambda k: F.get("args", F.lit(k) if isinstance(k, int) else k)
    bare = lambda c: F.regexp_replace(c, r"\"[^\"]*\"|'[^']*'|`[^`]*`", "")
    literal = lambda c: F.regexp_replace(c, "^[\"'`]|[\"'`]$", "")
    shell = (literal(arg(0)).isin("sh", "bash", "/bin/sh", "/bin/bash") & (literal(arg(1)) == "-c")) | ((literal(arg(0)) == "cmd.exe") & (literal(arg(1)) == "/c")) | (literal(arg(0)).isin("pwsh", "powershell", "powershell.exe") & literal(arg(1)).isin("-c", "-Command", "-command"))
    shifted = (literal(arg(1)).isin("sh", "bash", "/bin/sh", "/bin/bash") & (literal(arg(2)) == "-c")) | ((literal(arg(1)) == "cmd.exe") & (literal(arg(2)) == "/c"))
    parametrized = arg(0).rlike(r"^[\"'`]") & arg(0).rlike(r"%s|\?|:[A-Za-z_]|\$[0-9]") & (F.size("args") > 1)
    safe = F.exists("args", lambda a: a.contains("SafeLoader") | a.contains("SAFE_SCHEMA") | a.contains("FAILSAFE_SCHEMA") | a.contains("JSON_SCHEMA"))
    with_shell = F.exists("args", lambda a: a.rlike(r"shell\s*:\s*true"))
    holds = F.when(F.col("rule") == "shell", F.when(F.col("index") == 3, shifted).otherwise(shell)).when(F.col("rule") == "sql", ~parametrized).when(F.col("rule") == "yaml", ~safe).when(F.col("rule") == "shell true", with_shell).otherwise(F.lit(True))
    asked = named.where(F.coalesce(holds, F.lit(False))).select("file", "line", "path", "category", F.explode(F.array_distinct(F.regexp_extract_all(bare(arg(F.col("index"))), F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), 1))).alias("base"))
    return asked.join(reached.select("file", "line", "base").distinct(), ["file", "line", "base"], "left_semi").select("file", "line", "path", "category").distinct()


def cleansed(sources: DataFrame, calls: DataFrame, langs: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, line, category): sources (file, line) whose function calls a cleaner of that category, and what must stand beside it."""
    spark = sources.sparkSession
    rows = [(lang, path.rsplit(".", 1)[-1], path, category, beside) for ls, category, path, beside in tables.SANITIZERS for lang in ls]
    table = F.broadcast(spark.createDataFrame(rows, "lang string, callee string, path string, category string, beside string"))
    made = calls.withColumn("full", F.concat_ws(".", "qualifier", "callee"))
    use = made.join(langs, "file").join(table, ["lang", "callee"]).where("path = full or not contains(path, '.')").select("file", "function", "fn_line", "category", "beside")
    beside = made.select("file", "function", "fn_line", F.col("full").alias("beside"), F.lit(True).alias("there")).distinct()
    ok = use.join(beside, ["file", "function", "fn_line", "beside"], "left").where("beside is null or there").select("file", "fn_line", "category").distinct()
    ends = functions.select("file", F.col("start_line").alias("fn_line"), "end_line")
    spans = ok.join(ends, ["file", "fn_line"])
    s = sources.select("file", "line").distinct()
    return s.join(spans, "file").where(F.col("line").between(F.col("fn_line"), F.col("end_line"))).select("file", "line", "category").distinct()


def findings(sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(file, line, category, severity, source_line): an info row a source, and a warning a sink line with the nearest earlier
    source of its file, one from another process first. sources: (file, line, ipc); sinks: (file, line)."""
    own = sources.select("file", "line", F.lit("taint_source").alias("category"), F.lit("info").alias("severity"), F.lit(None).cast("int").alias("source_line")).distinct()
    rows = sources.select("file", "line", "ipc", F.col("line").alias("s")).unionByName(sinks.select("file", "line").distinct().withColumn("sink", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy("file").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.coalesce(F.max(F.when(F.col("ipc"), F.col("s"))).over(before), F.max("s").over(before))).where("sink")
    return own.unionByName(found.select("file", "line", F.lit("taint_sink").alias("category"), F.lit("warning").alias("severity"), F.col("near").cast("int").alias("source_line")))


def unquoted(lines: DataFrame, sinks: DataFrame) -> DataFrame:
    """(file, line): shell lines that expand a variable outside quotes and are no sink already. lines: (file, lang, line, text)."""
    bare = F.regexp_replace(F.regexp_replace("text", r"\"[^\"]*\"|'[^']*'", ""), "#.*$", "")
    hit = lines.where("lang = 'bash'").where(bare.rlike(r"\s\$(\{[A-Za-z_]|[A-Za-z_0-9@*])")).where(~bare.rlike(r"^\s*(local |export |readonly )?[A-Za-z_][A-Za-z0-9_]*=")).select("file", "line")
    return hit.join(sinks.select("file", "line"), ["file", "line"], "left_anti")


def blocks(reached: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(file, line, is_diff): one block a file: all tainted lines; sources and sinks are marked."""
    ends = sources.select("file", "line").unionByName(sinks.select("file", "line")).distinct()
    rows = reached.select("file", "line").unionByName(ends).distinct()
    return rows.join(ends.withColumn("is_diff", F.lit(True)), ["file", "line"], "left").withColumn("is_diff", F.coalesce("is_diff", F.lit(False)))
