"""Queries over source code: the corpus of sources/corpus.py read into relations, and the operators on them.

Each has DuckDB SQL that starts from the checked facts in sources/expected.py, not from a run of the readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import tables
from .operators import calls as calling
from .operators import control, dataflow, flow, patterns, render, slices, taint
from .plans.lineage import cut
from .sources.code import Code, facts
from .sources.corpus import code_files, facts_sql


def read(spark, d) -> Code:
    return Code(facts(code_files(spark, d)))


def kept(spark, d) -> Code:
    """The same, written once for queries that use several relations."""
    return Code(cut(facts(code_files(spark, d))))


def text(column, mark=","):
    return F.array_join(column, mark)


def code_functions(spark, d):
    return read(spark, d).functions.select("file", "name", "start_line", "end_line", text("params").alias("params"), "owner", F.col("is_static").cast("int").alias("is_static"), F.col("is_variadic").cast("int").alias("is_variadic"))


def code_parameters(spark, d):
    return read(spark, d).parameters


def code_identifiers(spark, d):
    return read(spark, d).identifiers.distinct()


def code_imports(spark, d):
    return read(spark, d).imports


def code_accesses(spark, d):
    return read(spark, d).accesses.distinct()


def code_aliases(spark, d):
    return read(spark, d).aliases


def code_tests(spark, d):
    return read(spark, d).tests.distinct()


def code_returns(spark, d):
    return read(spark, d).returns.withColumn("conditional", F.col("conditional").cast("int"))


def code_statements(spark, d):
    return read(spark, d).statements


def code_blocks(spark, d):
    return read(spark, d).blocks


def code_calls(spark, d):
    return read(spark, d).calls.withColumn("args", text("args", ";"))


def code_labels(spark, d):
    return kept(spark, d).labels.withColumn("cleanup", F.col("cleanup").cast("int"))


def code_types(spark, d):
    return read(spark, d).types.withColumn("bases", text("bases"))


def code_text(spark, d):
    """The code lines that still hold a call of a shell or of a database once comments and strings are blank."""
    return read(spark, d).lines.where(F.col("code").contains("system(") | F.col("code").contains("select ") | F.col("code").contains("back")).select("file", "line")


def code_errors(spark, d):
    """Error lines of the corpus with a bracket taken out of every file."""
    broken = code_files(spark, d).where("lang <> 'python'").withColumn("source", F.regexp_replace("source", r"return err\n}|return sort;\n  }|free\(p\);", "free(p;"))
    return Code(facts(broken)).errors


def code_enclosing_function(spark, d):
    """The innermost function around each call."""
    c = kept(spark, d)
    return slices.enclosing_functions(c.calls.select("file", "line").distinct(), c.functions.select("file", "name", "start_line", "end_line"))


def code_enclosing_branch(spark, d):
    """The innermost control statement around each call: kind, first and last line."""
    c = kept(spark, d)
    kinds = c.statements.where(F.col("kind").isin("if", "loop", "switch", "match", "try", "goto")).select("file", F.col("line").alias("start_line"), F.col("end_line"), F.col("kind").alias("name"))
    return slices.enclosing_functions(c.calls.select("file", "line").distinct(), kinds)


def code_function_by_name(spark, d):
    """The first function of each name in a file."""
    return read(spark, d).functions.groupBy("file", "name").agg(F.min("start_line").alias("start_line"))


def code_references(spark, d):
    c = kept(spark, d)
    return dataflow.references(c.identifiers, c.functions)


def code_scoped_references(spark, d):
    c = kept(spark, d)
    defs = c.accesses.where("access = 'def' and path = base and function is not null").select("file", "function", "fn_line", F.col("base").alias("name"), F.col("line").alias("def_line"))
    return dataflow.scoped_references(dataflow.references(c.identifiers, c.functions), defs, c.scopes)


def code_bare_references(spark, d):
    c = kept(spark, d)
    return dataflow.bare_references(dataflow.references(c.identifiers, c.functions), c.accesses.where("function is not null"))


def alias_targets(spark, d):
    return dataflow.alias_targets(kept(spark, d).aliases)


def _flow(c):
    return cut(dataflow.data_flow(c.accesses, dataflow.references(c.identifiers, c.functions), c.parameters, c.scopes))


def code_data_flow(spark, d):
    return _flow(kept(spark, d))


def control_flow(spark, d):
    return _control(kept(spark, d)).select("file", "function", "from_line", "to_line", "rule").distinct()


def _control(c):
    # every rule reads the two relations again: they are written once
    return cut(control.control_flow(cut(c.statements), cut(c.blocks)))


def control_successors(spark, d):
    c = kept(spark, d)
    return control.successors(_control(c), c.statements.where("kind in ('if', 'switch', 'loop')").select("file", "line"))


def control_predecessors(spark, d):
    c = kept(spark, d)
    return control.predecessors(_control(c), c.statements.where("kind = 'return'").select("file", "line"))


def control_reach(spark, d):
    c = kept(spark, d)
    return control.reachable_lines(_control(c), c.statements.where("kind = 'if'").select("file", "line"))


def statement_start(spark, d):
    c = kept(spark, d)
    return control.statement_start(c.identifiers.select("file", "line").distinct(), c.statements.select("file", "line").distinct())


def goto_reach(spark, d):
    c = kept(spark, d)
    return control.goto_reach(c.statements, c.labels, c.statements)


def flow_forward(spark, d):
    c = kept(spark, d)
    return dataflow.forward(_flow(c), c.accesses, c.aliases.where("function is not null").select("file", "line"))


def flow_backward(spark, d):
    c = kept(spark, d)
    return dataflow.backward(_flow(c), c.statements.where("kind = 'return'").select("file", "line"))


def _ends(c):
    return c.aliases.where("function is not null").select("file", "line"), c.statements.where("kind = 'expr'").select("file", "line")


def flow_chop(spark, d):
    c = kept(spark, d)
    return dataflow.chop(_flow(c), *_ends(c))


def control_chop(spark, d):
    """The flow chop without lines that control does not lead through."""
    c = kept(spark, d)
    g, (sources, sinks) = _control(c), _ends(c)
    return dataflow.cfg_chop(dataflow.chop(_flow(c), sources, sinks), control.reachable_lines(g, sources), control.reachable_lines(g, sinks, back=True))


def taint_control(spark, d):
    """The forward flow of alias lines, where control leads to it."""
    c = kept(spark, d)
    sources = c.aliases.where("function is not null").select("file", "line")
    return dataflow.with_control(dataflow.forward(_flow(c), c.accesses, sources), control.reachable_lines(_control(c), sources))


def definitions_of(spark, d):
    c = kept(spark, d)
    return dataflow.definitions_of(c.accesses, c.tests.select("file", "name").distinct())


def nodes_at(spark, d):
    c = kept(spark, d)
    return dataflow.nodes_at(c.accesses, c.statements.where("kind = 'return'").select("file", "line"))


def first_statement(spark, d):
    c = kept(spark, d)
    return dataflow.first_statement(c.statements, c.calls.select("file", "line").distinct())


def call_graph(spark, d):
    c = kept(spark, d)
    return calling.resolved(c.calls, c.functions, c.imports).select("file", "function", "line", "callee", "qualifier", "callee_file")


def callers_into(spark, d):
    """Call sites that lead into the Go files' help functions."""
    c = kept(spark, d)
    targets = c.functions.where("name like 'help%'").select(F.col("name").alias("callee"), F.col("file").alias("callee_file"))
    return calling.callers_into(calling.resolved(c.calls, c.functions, c.imports), targets).select("file", "line", "callee", "callee_file")


def code_callers(spark, d):
    """The callers of the help and send functions, by the report of callers."""
    c = kept(spark, d)
    touched = c.functions.where("name like 'help%' or name like 'send%'").select("file", "name")
    return render.callers_report(touched, calling.resolved(c.calls, c.functions, c.imports), c.lines)


def contract_conditions(spark, d):
    """What the conditions of branches ask for."""
    c = read(spark, d)
    return patterns.contract_conditions(c.statements.where("kind = 'if'").select("file", "line", F.col("text").alias("condition")))


def parse_quality(spark, d):
    """The quality of each file by its error lines and lines, in a corpus whose Go and C files lack a bracket."""
    files = code_files(spark, d).withColumn("source", F.regexp_replace("source", r"return err\n}|free\(p\);", "free(p;"))
    c = Code(cut(facts(files)))
    errors = c.of("error", "file", "line").groupBy("file").agg(F.count("*").alias("error_count"))
    sizes = c.lines.groupBy("file").agg(F.count("*").alias("node_count"))
    rows = sizes.join(errors, "file", "left").withColumn("error_count", F.coalesce("error_count", F.lit(0).cast("long")))
    return patterns.parse_quality(rows).select("file", "quality")


def indirect_calls(spark, d):
    c = kept(spark, d)
    return calling.indirect(c.calls, c.functions, c.aliases, c.accesses, c.parameters)


def live_types(spark, d):
    c = kept(spark, d)
    return calling.live_types(c.made, c.types)


def virtual_dispatch(spark, d):
    c = kept(spark, d)
    return calling.dispatch(c.calls, c.functions, cut(calling.live_types(c.made, c.types)))


def type_ancestors(spark, d):
    return calling.ancestors(kept(spark, d).types)


def argument_flow(spark, d):
    c = kept(spark, d)
    sites = calling.resolved(c.calls, c.functions, c.imports).select("file", "line", "callee", "callee_file").distinct()
    return dataflow.argument_flow(c.calls.join(sites, ["file", "line", "callee"]), c.functions, c.accesses)


def program_nodes(spark, d):
    c = kept(spark, d)
    return calling.program_nodes(c.functions, c.accesses, c.statements).groupBy("file", "kind").agg(F.countDistinct("node").alias("nodes"))


def program_edges(spark, d):
    c = kept(spark, d)
    found = calling.resolved(c.calls, c.functions, c.imports)
    lines = c.functions.select(F.col("file").alias("callee_file"), F.col("name").alias("callee"), F.col("start_line").alias("callee_line"))
    sites = found.select("file", "line", "callee", "callee_file").distinct()
    arguments = dataflow.argument_flow(c.calls.join(sites, ["file", "line", "callee"]), c.functions, c.accesses)
    edges = calling.program_edges(_flow(c), sites.join(lines, ["callee_file", "callee"]), arguments, c.statements, _control(c))
    return edges.groupBy("file", "kind").agg(F.count("*").alias("edges"))


# ---- taint -----------------------------------------------------------------------------------------------------------


def taint_frameworks(spark, d):
    return taint.frameworks(code_files(spark, d), kept(spark, d).imports)


def taint_framework_sources(spark, d):
    c = kept(spark, d)
    return taint.framework_sources(cut(taint.frameworks(code_files(spark, d), c.imports)), c.parameters, c.calls, c.accesses, c.imports)


def taint_ipc_sources(spark, d):
    """Lines of changed C files that read from another process: the corpus with g_variant_get_string in place of malloc."""
    files = code_files(spark, d).withColumn("source", F.replace("source", F.lit("malloc(n)"), F.lit("g_variant_get_string(v)")))
    lines = Code(facts(files)).lines.join(files.select("file", "lang"), "file")
    return taint.ipc_sources(lines, files.select("file"))


def taint_dynamic_sinks(spark, d):
    """Variadic functions that print: the corpus with a variadic copy function that calls vprintf in place of memcpy."""
    files = code_files(spark, d).withColumn("source", F.replace(F.replace("source", F.lit("int len)"), F.lit("int len, ...)")), F.lit("memcpy("), F.lit("vprintf(")))
    c = Code(cut(facts(files)))
    return taint.dynamic_sinks(c.functions, c.calls)


def _tainted(c, files):
    """(file, line, base) that the framework sources' lines reach by flow, and themselves."""
    sources = cut(taint.framework_sources(cut(taint.frameworks(files, c.imports)), c.parameters, c.calls, c.accesses, c.imports).select("file", "line").distinct())
    found = dataflow.forward(_flow(c), c.accesses, sources).select("file", "line")
    return sources, found.distinct()


def taint_flat_sinks(spark, d):
    c = kept(spark, d)
    _, reached = _tainted(c, code_files(spark, d))
    return taint.flat_sinks(reached, c.identifiers)


def taint_structured_sinks(spark, d):
    """Calls whose critical argument holds a name that is read on its line."""
    c = kept(spark, d)
    return taint.structured_sinks(c.calls, code_files(spark, d).select("file", "lang"), c.accesses.where("access = 'use'").select("file", "line", "base"))


def taint_cleansed(spark, d):
    """Categories that are clean at the returns, in a corpus whose calls of open and of help are cleaners."""
    files = code_files(spark, d).withColumn("source", F.replace(F.replace("source", F.lit("open(path)"), F.lit("bleach.clean(path)")), F.lit("send"), F.lit("escapeHtml")))
    c = Code(cut(facts(files)))
    return taint.cleansed(c.statements.where("kind = 'return'").select("file", "line"), c.calls, files.select("file", "lang"), c.functions)


def taint_findings(spark, d):
    c = kept(spark, d)
    sources, reached = _tainted(c, code_files(spark, d))
    return taint.findings(sources.withColumn("ipc", F.lit(False)), taint.flat_sinks(reached, c.identifiers).select("file", "line").distinct())


def taint_blocks(spark, d):
    c = kept(spark, d)
    sources, reached = _tainted(c, code_files(spark, d))
    return taint.blocks(reached, sources, taint.flat_sinks(reached, c.identifiers)).withColumn("is_diff", F.col("is_diff").cast("int"))


# ---- patterns over code ----------------------------------------------------------------------------------------------


def absence_slice(spark, d):
    """Every statement line counts as changed."""
    c = kept(spark, d)
    gotos = c.statements.where("kind = 'goto'").select("file", "function", "line", F.col("text").alias("label"))
    return patterns.absence(c.statements.select("file", "line"), c.functions, c.calls, c.lines, c.labels, gotos)


def provenance_slice(spark, d):
    """Every line with a test counts as changed."""
    c = kept(spark, d)
    lines = code_files(spark, d).select("file", F.posexplode(F.split("source", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")
    points = c.tests.select("file", "line", "name").distinct()
    spans = slices.enclosing_functions(points.select("file", "line").distinct(), c.functions.select("file", "name", "start_line", "end_line"))
    params = spans.select("file", "line", F.col("start_line").alias("fn_line")).join(c.parameters.select("file", "fn_line", F.col("name").alias("param")), ["file", "fn_line"]).select("file", "line", F.col("param").alias("name"))
    return patterns.provenance(points, dataflow.definitions_of(c.accesses, points.select("file", "name").distinct()).select("file", "line", "name"), lines, params)


def horizontal_slice(spark, d):
    """Peers by name of the functions that are called step."""
    c = kept(spark, d)
    f = c.functions
    return patterns.peers(f.where("name like 'help%'").select("file", "name", "start_line"), f, "name:step*")


def contract_postconditions(spark, d):
    c = kept(spark, d)
    throws = c.statements.where("kind = 'throw'").select("file", "function", "fn_line")
    return patterns.postconditions(c.functions, c.returns, throws, code_files(spark, d).select("file", "lang"))


def vertical_layers(spark, d):
    """The layer of each file, by the words of its path and of the function it calls first."""
    c = read(spark, d)
    words = F.element_at(F.array(*(F.lit(w) for w, _ in tables.LAYERS)), (F.length("file") % len(tables.LAYERS) + 1).cast("int"))
    return c.functions.select(F.concat(words, F.lit("/"), F.col("file")).alias("file"), "name").withColumn("layer", patterns.layer(F.col("file")))


def code_left_flow(spark, d):
    """Left flow over code: calls count as changed lines; tests are conditions."""
    c = kept(spark, d)
    edges = _flow(c).select("file", "def_line", "use_line")
    diff = c.calls.where("function is not null").select("file", "line").distinct()
    found = flow.left_flow(diff, edges, c.functions.select("file", "name", "start_line", "end_line"), c.returns.select("file", "line"), c.tests.select("file", "line").distinct())
    return found.select("file", "line", F.col("is_diff").cast("int").alias("is_diff"))


# ---- DuckDB ----------------------------------------------------------------------------------------------------------

#: The relations in DuckDB SQL, from the expected facts.
SQL = {
    "facts": facts_sql(),
    "fn": "SELECT file, name, line AS start_line, end_line, items AS params, path AS owner, kind FROM facts WHERE relation = 'function'",
    "par": "SELECT file, function, fn_line, n AS index, name, text AS type FROM facts WHERE relation = 'parameter'",
    "idn": "SELECT file, line, unnest(items) AS name FROM facts WHERE relation = 'identifiers'",
    "imp": "SELECT file, name AS alias, path AS module, text AS name FROM facts WHERE relation = 'import'",
    "acc": "SELECT DISTINCT file, function, fn_line, line, name AS base, path, kind AS access FROM facts WHERE relation = 'access'",
    "als": "SELECT file, function, fn_line, line, name AS alias, path AS target FROM facts WHERE relation = 'alias'",
    "tst": "SELECT DISTINCT file, function, line, name FROM facts WHERE relation = 'test'",
    "ret": "SELECT file, function, fn_line, line, text AS value, (kind = 'conditional')::int AS conditional FROM facts WHERE relation = 'return'",
    "stm": "SELECT file, function, fn_line, line, kind, end_line, text FROM facts WHERE relation = 'statement' AND function IS NOT NULL",
    "blk": "SELECT file, function, fn_line, path::int AS owner, kind AS owner_kind, items[1]::int AS owner_end, name AS role, n AS number, line AS first, end_line, items[2]::int AS last, text AS last_kind FROM facts WHERE relation = 'block'",
    "cal": "SELECT file, function, fn_line, line, name AS callee, path AS qualifier, items AS args FROM facts WHERE relation = 'call'",
    "typ": "SELECT file, name, kind, items AS bases, line AS start_line, end_line FROM facts WHERE relation = 'type'",
    "mad": "SELECT file, name FROM facts WHERE relation = 'made'",
    "scp": "SELECT file, function, line AS start_line, end_line, name FROM facts WHERE relation = 'scope'",
    "lab": "SELECT file, function, fn_line, line, text AS name, coalesce((SELECT min(x.line) - 1 FROM stm x WHERE x.file = stm.file AND x.fn_line = stm.fn_line AND x.kind = 'label' AND x.line > stm.line), (SELECT max(f.end_line) FROM fn f WHERE f.file = stm.file AND f.start_line = stm.fn_line)) AS end_line, ((SELECT arg_max(x.kind, x.line) FROM stm x WHERE x.file = stm.file AND x.fn_line = stm.fn_line AND x.line < stm.line) IN ('return', 'goto', 'break', 'continue'))::int AS cleanup FROM stm WHERE kind = 'label'",
    "ref": "SELECT DISTINCT i.file, f.name AS function, f.start_line AS fn_line, i.line, i.name FROM idn i JOIN fn f ON i.file = f.file AND i.line BETWEEN f.start_line AND f.end_line",
    "bare": "SELECT DISTINCT file, function, fn_line, base AS name FROM acc WHERE function IS NOT NULL AND path = base AND access = 'use' AND line <> fn_line",
    "dfs": "SELECT file, function, fn_line, base AS name, line AS def_line FROM acc WHERE access = 'def' AND path = base AND function IS NOT NULL",
    "sref": "SELECT DISTINCT d.file, d.function, d.fn_line, d.name, d.def_line, r.line FROM dfs d JOIN ref r ON r.file = d.file AND r.fn_line = d.fn_line AND r.name = d.name WHERE NOT EXISTS (SELECT 1 FROM scp s WHERE s.file = d.file AND s.function = d.function AND s.name = d.name AND r.line BETWEEN s.start_line AND s.end_line AND d.def_line NOT BETWEEN s.start_line AND s.end_line)",
    "pref": "SELECT p.file, p.function, p.fn_line, p.name, p.fn_line AS def_line, r.line FROM par p JOIN bare b ON b.file = p.file AND b.fn_line = p.fn_line AND b.name = p.name JOIN ref r ON r.file = p.file AND r.fn_line = p.fn_line AND r.name = p.name WHERE NOT EXISTS (SELECT 1 FROM scp s WHERE s.file = p.file AND s.function = p.function AND s.name = p.name AND r.line BETWEEN s.start_line AND s.end_line)",
    "dfl": "SELECT file, function, fn_line, name AS path, def_line, line AS use_line FROM sref WHERE line <> def_line UNION SELECT file, function, fn_line, name, def_line, line FROM pref WHERE line <> def_line UNION SELECT a.file, a.function, a.fn_line, a.path, a.line, b.line FROM acc a JOIN acc b ON a.file = b.file AND a.fn_line = b.fn_line AND a.path = b.path AND b.line > a.line WHERE a.access = 'def' AND a.path <> a.base AND a.function IS NOT NULL",
    "nxt": "SELECT s.file, s.fn_line, s.end_line AS after, min(n.line) AS line FROM (SELECT file, fn_line, end_line FROM stm UNION SELECT file, fn_line, owner_end FROM blk) s JOIN stm n ON n.file = s.file AND n.fn_line = s.fn_line AND n.line > s.end_line GROUP BY ALL",
    "cfg": "SELECT DISTINCT file, function, fn_line, f AS from_line, t AS to_line, rule FROM ("
    "SELECT file, function, fn_line, line AS f, lead(line) OVER (PARTITION BY file, fn_line ORDER BY line) AS t, 'sequence' AS rule, kind AS k FROM stm QUALIFY kind NOT IN ('return', 'break', 'continue', 'goto', 'throw')"
    " UNION ALL SELECT file, function, fn_line, owner, first, role, NULL FROM blk WHERE owner_kind = 'if' OR owner_kind = 'try' OR owner_kind = 'loop' AND role = 'body'"
    " UNION ALL SELECT file, function, fn_line, owner, first, 'loop else', NULL FROM blk WHERE owner_kind = 'loop' AND role = 'else'"
    " UNION ALL SELECT file, function, fn_line, owner, first, 'case', NULL FROM blk WHERE owner_kind IN ('switch', 'match') AND role IN ('case', 'default')"
    " UNION ALL SELECT b.file, b.function, b.fn_line, b.owner, n.line, 'skip', NULL FROM blk b JOIN nxt n ON n.file = b.file AND n.fn_line = b.fn_line AND n.after = b.owner_end WHERE owner_kind = 'if' AND role = 'then' AND NOT EXISTS (SELECT 1 FROM blk e WHERE e.file = b.file AND e.fn_line = b.fn_line AND e.owner = b.owner AND e.owner_kind = 'if' AND e.role = 'else')"
    " UNION ALL SELECT b.file, b.function, b.fn_line, b.last, n.line, 'join', NULL FROM blk b JOIN nxt n ON n.file = b.file AND n.fn_line = b.fn_line AND n.after = b.owner_end WHERE owner_kind = 'if' AND role = 'then' AND last_kind NOT IN ('return', 'break', 'continue', 'goto', 'throw')"
    " UNION ALL SELECT b.file, b.function, b.fn_line, b.last, n.line, 'leave', NULL FROM blk b JOIN nxt n ON n.file = b.file AND n.fn_line = b.fn_line AND n.after = b.owner_end WHERE owner_kind = 'switch' AND last_kind = 'break'"
    " UNION ALL SELECT b.file, b.function, b.fn_line, b.owner, n.line, 'no case', NULL FROM (SELECT file, function, fn_line, owner, owner_end FROM blk WHERE owner_kind = 'switch' GROUP BY ALL HAVING NOT bool_or(role = 'default')) b JOIN nxt n ON n.file = b.file AND n.fn_line = b.fn_line AND n.after = b.owner_end"
    " UNION ALL SELECT file, function, fn_line, last, lead(first) OVER (PARTITION BY file, fn_line, owner ORDER BY number), 'fall through', NULL FROM blk WHERE owner_kind = 'switch' QUALIFY last_kind NOT IN ('return', 'break', 'continue', 'goto', 'throw')"
    " UNION ALL SELECT g.file, g.function, g.fn_line, g.line, l.line, 'goto', NULL FROM stm g JOIN stm l ON l.file = g.file AND l.fn_line = g.fn_line AND l.kind = 'label' AND l.text = g.text WHERE g.kind = 'goto'"
    " UNION ALL SELECT file, function, fn_line, last, owner, 'back', NULL FROM blk WHERE owner_kind = 'loop' AND role = 'body' AND last_kind NOT IN ('return', 'break', 'continue', 'goto', 'throw')"
    " UNION ALL SELECT b.file, b.function, b.fn_line, b.owner, n.line, 'exit', NULL FROM blk b JOIN nxt n ON n.file = b.file AND n.fn_line = b.fn_line AND n.after = b.owner_end WHERE owner_kind = 'loop' AND role = 'body'"
    " UNION ALL SELECT c.file, c.function, c.fn_line, c.first, f.first, 'catch to finally', NULL FROM blk c JOIN blk f ON f.file = c.file AND f.fn_line = c.fn_line AND f.owner = c.owner AND f.role = 'finally' WHERE c.role = 'catch'"
    " UNION ALL SELECT r.file, r.function, r.fn_line, r.line, d.line, 'defer', NULL FROM stm r JOIN stm d ON d.file = r.file AND d.fn_line = r.fn_line AND d.kind = 'defer' WHERE r.kind = 'return') WHERE t IS NOT NULL AND f <> t",
    "cg": "SELECT DISTINCT file, function, fn_line, line, callee, qualifier, callee_file FROM (SELECT c.file, c.function, c.fn_line, c.line, c.callee, c.qualifier, f.file AS callee_file, CASE WHEN contains(f.kind, 'static') AND f.file = c.file THEN 0 WHEN EXISTS (SELECT 1 FROM imp i WHERE i.file = c.file AND i.alias = c.qualifier AND split_part(regexp_extract(i.module, '[^/]*$'), '.', 1) = split_part(regexp_extract(f.file, '[^/]*$'), '.', 1)) THEN 1 WHEN NOT contains(f.kind, 'static') THEN 2 END AS p FROM cal c JOIN fn f ON f.name = c.callee WHERE c.function IS NOT NULL) WHERE p IS NOT NULL QUALIFY p = min(p) OVER (PARTITION BY file, line, callee, qualifier)",
    "arg": "SELECT DISTINCT a.file, a.line, a.path, a.callee_file AS to_file, f.start_line AS to_line, f.params[a.k] AS parameter FROM (SELECT c.file, c.line, c.callee, g.callee_file, unnest(range(1, len(c.args) + 1)) AS k, regexp_extract(unnest(c.args), '^\\s*([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS path FROM cal c JOIN (SELECT DISTINCT file, line, callee, callee_file FROM cg) g ON g.file = c.file AND g.line = c.line AND g.callee = c.callee) a JOIN fn f ON f.file = a.callee_file AND f.name = a.callee AND a.k <= len(f.params) WHERE EXISTS (SELECT 1 FROM acc x WHERE x.file = a.file AND x.line = a.line AND x.base = a.path)",
    "nodes": "SELECT DISTINCT file, line, path, 'use' AS access, written AS to_path FROM (SELECT a.file, a.line, unnest([a.path, a.base]) AS path, w.path AS written FROM acc a JOIN acc w ON w.file = a.file AND w.line = a.line AND w.access = 'def' WHERE a.access = 'use')",
    "step": "SELECT DISTINCT file, def_line AS l0, path AS p0, 'def' AS a0, use_line AS l1, path AS p1, 'use' AS a1 FROM dfl UNION SELECT file, line, path, 'use', line, to_path, 'def' FROM nodes",
    "src": "SELECT DISTINCT file, line FROM als WHERE function IS NOT NULL",
    "snk": "SELECT DISTINCT file, line FROM stm WHERE kind = 'expr'",
    "fw": "SELECT DISTINCT file, CASE WHEN EXISTS (SELECT 1 FROM imp i WHERE i.file = f.file AND i.module = 'flask') THEN 'flask' END AS framework FROM (SELECT DISTINCT file FROM facts) f WHERE file LIKE '%.py'",
    "fsrc": "SELECT DISTINCT a.file, a.line, NULL::varchar AS name, 'flask' AS framework FROM acc a JOIN imp i ON i.file = a.file AND i.alias = a.base AND i.module = 'flask' AND i.name = 'request' WHERE a.access = 'use' AND a.path <> a.base",
}
NEEDS = {
    "lab": ("stm", "fn"), "ref": ("idn", "fn"), "bare": ("acc",), "dfs": ("acc",), "sref": ("dfs", "ref", "scp"), "pref": ("par", "bare", "ref", "scp"), "dfl": ("sref", "pref", "acc"), "nxt": ("stm", "blk"), "cfg": ("stm", "blk", "nxt"),
    "cg": ("cal", "fn", "imp"), "arg": ("cal", "cg", "fn", "acc"), "nodes": ("acc",), "step": ("dfl", "nodes"), "src": ("als",), "snk": ("stm",), "fsrc": ("acc", "imp"), "fw": ("imp",),
}


def sql(select: str, *names: str, more: str = "") -> str:
    """select after the relations that it names and what they are made of; more: further relations."""
    wanted: set[str] = {"facts"}
    todo = list(names)
    while todo:
        n = todo.pop()
        wanted.add(n)
        todo += NEEDS.get(n, ())
    parts = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in SQL if n in wanted)
    return f"WITH RECURSIVE {parts}{', ' + more if more else ''} {select}"


WALK = "w AS (SELECT DISTINCT {0} AS file, {1} AS l FROM (SELECT 1))"


def oracle_sql() -> dict[str, str]:
    inner = "SELECT l.file, l.line, arg_min({f}.name, ({f}.end_line - {f}.start_line) * 100000 - {f}.start_line) AS name, arg_min({f}.start_line, ({f}.end_line - {f}.start_line) * 100000 - {f}.start_line) AS start_line, arg_min({f}.end_line, ({f}.end_line - {f}.start_line) * 100000 - {f}.start_line) AS end_line FROM {l} l JOIN {f} ON {f}.file = l.file AND l.line BETWEEN {f}.start_line AND {f}.end_line GROUP BY ALL".format
    sites = "sites AS (SELECT DISTINCT file, line FROM cal)"
    ahead = "w AS (SELECT s.file, s.line AS origin, s.line AS l, d.path AS p, 'def' AS a FROM {0} s JOIN (SELECT DISTINCT file, def_line, path FROM dfl) d ON d.file = s.file AND d.def_line = s.line UNION SELECT w.file, w.origin, step.l1, step.p1, step.a1 FROM w JOIN step ON step.file = w.file AND step.l0 = w.l AND step.p0 = w.p AND step.a0 = w.a)".format
    # an origin is a node: its own node does not count as reached
    forward = "w AS (SELECT s.file, s.line AS origin, d.path AS op, s.line AS l, d.path AS p, 'def' AS a FROM {0} s JOIN (SELECT DISTINCT file, def_line, path FROM dfl) d ON d.file = s.file AND d.def_line = s.line UNION SELECT w.file, w.origin, w.op, step.l1, step.p1, step.a1 FROM w JOIN step ON step.file = w.file AND step.l0 = w.l AND step.p0 = w.p AND step.a0 = w.a), fwd AS (SELECT DISTINCT file, origin, l AS line FROM w WHERE NOT (l = origin AND p = op AND a = 'def'))".format
    chop = "fa AS (SELECT DISTINCT file, use_line AS line, path, 'use' AS a, def_line AS d FROM dfl), ch AS (SELECT DISTINCT e.file, unnest([e.def_line, e.use_line]) AS line FROM dfl e JOIN src ON src.file = e.file AND src.line = e.def_line JOIN snk ON snk.file = e.file AND snk.line = e.use_line UNION SELECT file, line FROM src UNION SELECT file, line FROM snk)"
    reach = "{0} AS (SELECT s.file, s.line AS origin, cfg.{2} AS l FROM {1} s JOIN cfg ON cfg.file = s.file AND cfg.{3} = s.line UNION SELECT {0}.file, {0}.origin, cfg.{2} FROM {0} JOIN cfg ON cfg.file = {0}.file AND cfg.{3} = {0}.l)".format
    on = reach("r", "src", "to_line", "from_line")
    back = reach("q", "snk", "from_line", "to_line")
    t = "fs AS (SELECT DISTINCT file, line FROM fsrc), " + forward("fs") + ", tl AS (SELECT DISTINCT file, line FROM fwd)"
    parts = [s for s in tables.FLAT_SINKS if s[0] != "="]
    flat = "fl AS (SELECT DISTINCT i.file, i.line, i.name FROM idn i JOIN tl USING (file, line) WHERE i.name IN (" + ", ".join(f"'{s[1:]}'" for s in tables.FLAT_SINKS if s[0] == "=") + ") OR " + " OR ".join(f"contains(i.name, '{s}')" for s in parts) + ")"
    every = ("dfl", "step", "fsrc", "idn")
    return {
        "code_functions": sql("SELECT file, name, start_line, end_line, array_to_string(params, ',') AS params, owner, contains(kind, 'static')::int AS is_static, contains(kind, 'variadic')::int AS is_variadic FROM fn", "fn"),
        "code_parameters": sql("SELECT * FROM par", "par"),
        "code_identifiers": sql("SELECT * FROM idn", "idn"),
        "code_imports": sql("SELECT * FROM imp", "imp"),
        "code_accesses": sql("SELECT * FROM acc", "acc"),
        "code_aliases": sql("SELECT * FROM als", "als"),
        "code_tests": sql("SELECT * FROM tst", "tst"),
        "code_returns": sql("SELECT * FROM ret", "ret"),
        "code_statements": sql("SELECT * FROM stm", "stm"),
        "code_blocks": sql("SELECT * FROM blk", "blk"),
        "code_calls": sql("SELECT file, function, fn_line, line, callee, qualifier, array_to_string(args, ';') AS args FROM cal", "cal"),
        "code_labels": sql("SELECT * FROM lab", "lab"),
        "code_types": sql("SELECT file, name, kind, array_to_string(bases, ',') AS bases, start_line, end_line FROM typ", "typ"),
        "code_text": "SELECT 'src/f' || doc_id || '.py' AS file, 10 AS line FROM documents WHERE doc_id % 4 = 0",
        "code_errors": "SELECT 'src/f' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.go' WHEN 2 THEN '.js' ELSE '.c' END AS file, unnest(CASE doc_id % 4 WHEN 1 THEN [9, 25] WHEN 2 THEN [3, 4, 20, 21] ELSE [2, 24, 26] END) AS line FROM documents WHERE doc_id % 4 <> 0",
        "code_enclosing_function": sql(inner(f="fn", l="sites"), "cal", "fn", more=sites),
        "code_enclosing_branch": sql(inner(f="br", l="sites"), "cal", "stm", more=sites + ", br AS (SELECT file, line AS start_line, end_line, kind AS name FROM stm WHERE kind IN ('if', 'loop', 'switch', 'match', 'try', 'goto'))"),
        "code_function_by_name": sql("SELECT file, name, min(start_line) AS start_line FROM fn GROUP BY ALL", "fn"),
        "code_references": sql("SELECT * FROM ref", "ref"),
        "code_scoped_references": sql("SELECT * FROM sref", "sref"),
        "code_bare_references": sql("SELECT * FROM bare", "bare"),
        "alias_targets": sql("SELECT file, function, fn_line, alias, target FROM als WHERE NOT contains(alias, '.') AND file NOT LIKE '%.js' UNION ALL SELECT file, function, fn_line, alias, CASE alias WHEN 'key' THEN 'req.id' ELSE target END FROM als WHERE file LIKE '%.js'", "als"),
        "code_data_flow": sql("SELECT file, function, fn_line, path, def_line, use_line FROM dfl", "dfl"),
        "control_flow": sql("SELECT DISTINCT file, function, from_line, to_line, rule FROM cfg", "cfg"),
        "control_successors": sql("SELECT DISTINCT s.file, s.line, cfg.to_line AS successor FROM stm s JOIN cfg ON cfg.file = s.file AND cfg.from_line = s.line WHERE s.kind IN ('if', 'switch', 'loop')", "cfg"),
        "control_predecessors": sql("SELECT DISTINCT s.file, s.line, cfg.from_line AS predecessor FROM stm s JOIN cfg ON cfg.file = s.file AND cfg.to_line = s.line WHERE s.kind = 'return'", "cfg"),
        "control_reach": sql("SELECT DISTINCT file, origin, l AS line FROM r WHERE l <> origin", "cfg", more="ifs AS (SELECT file, line FROM stm WHERE kind = 'if'), " + reach("r", "ifs", "to_line", "from_line")),
        "statement_start": sql("SELECT i.file, i.line, max(s.line) AS statement_line FROM (SELECT DISTINCT file, line FROM idn) i LEFT JOIN stm s ON s.file = i.file AND s.line BETWEEN i.line - 20 AND i.line GROUP BY ALL", "idn", "stm"),
        "goto_reach": sql("SELECT DISTINCT g.file, g.function, g.line, s.line AS reached FROM stm g JOIN lab ON lab.file = g.file AND lab.fn_line = g.fn_line AND lab.name = g.text JOIN stm s ON s.file = g.file AND s.fn_line = g.fn_line AND s.line BETWEEN lab.line AND lab.end_line WHERE g.kind = 'goto'", "lab", "stm"),
        "flow_forward": sql("SELECT * FROM fwd", "dfl", "step", "src", more=forward("src")),
        "flow_backward": sql("SELECT DISTINCT d.file, d.use_line AS origin, d.def_line AS line FROM dfl d JOIN stm s ON s.file = d.file AND s.line = d.use_line AND s.kind = 'return'", "dfl", "stm"),
        "flow_chop": sql("SELECT file, line FROM ch", "dfl", "src", "snk", more=chop),
        "control_chop": sql("SELECT file, line FROM ch WHERE ((file, line) IN (SELECT (file, l) FROM r) OR (file, line) IN (SELECT (file, origin) FROM r)) AND ((file, line) IN (SELECT (file, l) FROM q) OR (file, line) IN (SELECT (file, origin) FROM q))", "dfl", "src", "snk", "cfg", more=f"{chop}, {on}, {back}"),
        "taint_control": sql("SELECT file, origin, line FROM fwd WHERE line = origin OR (file, origin, line) IN (SELECT (file, origin, l) FROM r) OR (file, origin) NOT IN (SELECT (file, origin) FROM r WHERE l <> origin)", "dfl", "step", "src", "cfg", more=f"{forward('src')}, {on}"),
        "definitions_of": sql("SELECT DISTINCT file, base AS name, function, line FROM acc WHERE access = 'def' AND (file, base) IN (SELECT (file, name) FROM tst)", "acc", "tst"),
        "nodes_at": sql("SELECT DISTINCT file, line, function, path, access FROM acc WHERE (file, line) IN (SELECT (file, line) FROM stm WHERE kind = 'return')", "acc", "stm"),
        "first_statement": sql("SELECT DISTINCT s.file, s.line, s.kind FROM stm s JOIN (SELECT DISTINCT file, line FROM cal) c USING (file, line)", "stm", "cal"),
        "call_graph": sql("SELECT file, function, line, callee, qualifier, callee_file FROM cg", "cg"),
        "callers_into": sql("SELECT DISTINCT cg.file, cg.line, cg.callee, cg.callee_file FROM cg WHERE callee LIKE 'help%'", "cg"),
        "code_callers": "SELECT 'src/f' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.go' ELSE '.js' END AS file, CASE doc_id % 4 WHEN 1 THEN 'help' ELSE 'send' END || doc_id AS name, 'src/f' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.go' ELSE '.js' END AS caller_file, CASE doc_id % 4 WHEN 1 THEN 'Serve' ELSE 'run' END || doc_id AS caller, 1::bigint AS depth, NULL::varchar AS trust, NULL::varchar AS kind FROM documents WHERE doc_id % 4 IN (1, 2)",
        "contract_conditions": "SELECT 'src/f' || doc_id || ['.py', '.go', '.js', '.c'][k + 1] AS file, line, condition, kind FROM (SELECT doc_id FROM documents) JOIN (VALUES (0, 8, 'flag > 1', 'range-check'), (1, 11, 'name == \"\"', 'non-empty'), (2, 7, 'limit > 3', 'range-check'), (3, 5, '!p', 'non-null')) v(k, line, condition, kind) ON doc_id % 4 = k",
        "parse_quality": "SELECT 'src/f' || doc_id || ['.py', '.go', '.js', '.c'][doc_id % 4 + 1] AS file, CASE doc_id % 4 WHEN 1 THEN 'degraded' WHEN 3 THEN 'degraded' END AS quality FROM documents",
        "indirect_calls": sql("SELECT file, function, line, callee, 'step' || regexp_extract(file, '[0-9]+') AS target, 1 AS level FROM cal WHERE callee = 'handler' UNION ALL SELECT file, function, line, callee, 'step' || regexp_extract(file, '[0-9]+'), 4 FROM cal WHERE callee LIKE 'start%'", "cal", "als", "fn"),
        "live_types": sql("SELECT DISTINCT name FROM mad JOIN typ USING (name)", "mad", "typ"),
        "virtual_dispatch": sql("SELECT DISTINCT c.file, c.line, c.callee, f.file AS callee_file, f.owner FROM cal c JOIN fn f ON f.name = c.callee AND f.owner IS NOT NULL WHERE c.function IS NOT NULL AND c.qualifier IS NOT NULL AND (f.owner IN (SELECT m.name FROM mad m JOIN typ USING (name)) OR c.callee NOT IN (SELECT g.name FROM fn g JOIN mad ON mad.name = g.owner JOIN typ ON typ.name = g.owner))", "cal", "fn", "mad", "typ"),
        "type_ancestors": sql("SELECT name, unnest(bases) AS ancestor FROM typ", "typ"),
        "argument_flow": sql("SELECT * FROM arg", "arg"),
        "program_nodes": sql("SELECT file, kind, count(*) AS nodes FROM (SELECT DISTINCT file, 'function' AS kind, name AS a, 0 AS b, '' AS c, '' AS e FROM fn UNION ALL SELECT DISTINCT file, 'variable', function, line, path, access FROM acc WHERE function IS NOT NULL UNION ALL SELECT DISTINCT file, 'statement', '', line, '', '' FROM stm) GROUP BY ALL", "fn", "acc", "stm"),
        "program_edges": sql("SELECT file, kind, count(*) AS edges FROM (SELECT DISTINCT 'flow' AS kind, file, def_line AS a, file AS b, use_line AS c FROM dfl UNION ALL SELECT DISTINCT 'argument', file, line, to_file, to_line FROM arg UNION ALL SELECT DISTINCT 'call', cg.file, cg.line, cg.callee_file, fn.start_line FROM cg JOIN fn ON fn.file = cg.callee_file AND fn.name = cg.callee UNION ALL SELECT DISTINCT 'return', cg.callee_file, fn.start_line, cg.file, cg.line FROM cg JOIN fn ON fn.file = cg.callee_file AND fn.name = cg.callee UNION ALL SELECT DISTINCT 'contains', file, fn_line, file, line FROM stm UNION ALL SELECT DISTINCT 'control', file, from_line, file, to_line FROM cfg) GROUP BY ALL", "dfl", "arg", "cg", "fn", "stm", "cfg"),
        "taint_frameworks": sql("SELECT file, framework FROM fw", "fw"),
        "taint_framework_sources": sql("SELECT * FROM fsrc", "fsrc"),
        "taint_ipc_sources": "SELECT 'src/f' || doc_id || '.c' AS file, 4 AS line FROM documents WHERE doc_id % 4 = 3",
        "taint_dynamic_sinks": "SELECT 'copy' || doc_id AS name FROM documents WHERE doc_id % 4 = 3",
        "taint_flat_sinks": sql("SELECT * FROM fl", *every, more=f"{t}, {flat}"),
        "taint_structured_sinks": "SELECT 'src/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.js' END AS file, v.* FROM documents JOIN (VALUES (0, 17, 'execute', 'Sqli'), (1, 14, 'os.Open', 'PathTraversal'), (1, 21, 'exec.Command', 'OsCommand'), (2, 14, 'exec', 'OsCommand')) v(k, line, path, category) ON doc_id % 4 = k".replace("v.*", "v.line, v.path, v.category"),
        "taint_cleansed": "SELECT 'src/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' ELSE '.js' END AS file, unnest(CASE doc_id % 4 WHEN 0 THEN [19, 22] ELSE []::int[] END) AS line, 'Xss' AS category FROM documents WHERE doc_id % 4 IN (0, 2)",
        "taint_findings": sql("SELECT file, line, 'taint_source' AS category, 'info' AS severity, NULL::int AS source_line FROM fs UNION ALL SELECT l.file, l.line, 'taint_sink', 'warning', max(fs.line) FROM (SELECT DISTINCT file, line FROM fl) l LEFT JOIN fs ON fs.file = l.file AND fs.line < l.line GROUP BY l.file, l.line", *every, more=f"{t}, {flat}"),
        "taint_blocks": sql("SELECT file, line, ((file, line) IN (SELECT (file, line) FROM fs) OR (file, line) IN (SELECT (file, line) FROM fl))::int AS is_diff FROM (SELECT file, line FROM tl UNION SELECT file, line FROM fs)", *every, more=f"{t}, {flat}"),
        "absence_slice": "SELECT 'src/f' || doc_id || '.js' AS file, 'send' || doc_id AS function, 24 AS line, 'allocation without free' AS description, 'missing_counterpart' AS category, 'warning' AS severity FROM documents WHERE doc_id % 4 = 2",
        "provenance_slice": "SELECT 'src/f' || doc_id || ['.py', '.go', '.js'][k + 1] AS file, line, name, origin, severity FROM (SELECT doc_id FROM documents) JOIN (VALUES (0, 8, 'flag', 'FunctionParam', 'info'), (0, 13, 'path', 'FunctionParam', 'info'), (1, 11, 'name', 'UserInput', 'concern'), (1, 19, 'name', 'UserInput', 'concern'), (2, 7, 'limit', 'FunctionParam', 'info'), (2, 10, 'item', 'Unknown', NULL), (2, 10, 'key', 'Database', 'warning')) v(k, line, name, origin, severity) ON doc_id % 4 = k",
        "horizontal_slice": sql("SELECT DISTINCT file, name, unnest(list_append(range(start_line, least(start_line + 10, end_line) + 1), end_line)) AS line FROM fn WHERE name LIKE 'step%' OR name LIKE 'help%'", "fn"),
        "contract_postconditions": sql("SELECT file, name, start_line, CASE WHEN name LIKE 'load%' THEN 'nullable' WHEN name LIKE 'Serve%' THEN 'nullable' WHEN name LIKE 'run%' THEN 'non-null-or-throws' ELSE 'non-null' END AS postcondition FROM fn", "fn"),
        "vertical_layers": sql("SELECT w || '/' || file AS file, name, CASE w WHEN 'usecase' THEN 'UseCase' WHEN 'api' THEN 'API' WHEN 'dao' THEN 'DAO' WHEN 'db' THEN 'Database' WHEN 'util' THEN 'Utility' WHEN 'cmd' THEN 'Command' WHEN 'pkg' THEN 'Package' ELSE upper(w[1]) || w[2:] END AS layer FROM (SELECT file, name, (['handler', 'controller', 'route', 'api', 'view', 'service', 'usecase', 'domain', 'model', 'entity', 'repository', 'dao', 'db', 'store', 'migration', 'middleware', 'util', 'helper', 'cmd', 'pkg'])[length(file) % 20 + 1] AS w FROM fn)", "fn"),
        "code_left_flow": sql("SELECT file, line, ((file, line) IN (SELECT (file, line) FROM df))::int AS is_diff FROM (SELECT file, l AS line FROM w UNION SELECT file, start_line FROM hit UNION SELECT file, end_line FROM hit UNION SELECT r.file, r.line FROM ret r JOIN hit ON hit.file = r.file AND hit.start_line = r.fn_line)", "dfl", "cal", "tst", "ret", "fn", more="df AS (SELECT DISTINCT file, line FROM cal WHERE function IS NOT NULL), hit AS (SELECT DISTINCT file, name, start_line, end_line FROM (" + inner(f="fn", l="df") + ")), sd AS (SELECT file, line AS l FROM df UNION SELECT d.file, d.def_line FROM dfl d JOIN df ON df.file = d.file AND df.line = d.use_line WHERE (d.file, d.use_line) IN (SELECT (file, line) FROM tst)), w AS (SELECT file, l FROM sd UNION SELECT w.file, dfl.use_line FROM w JOIN dfl ON dfl.file = w.file AND dfl.def_line = w.l)"),
    }


def queries() -> dict:
    from . import code_queries as here

    return {name: getattr(here, name) for name in oracle_sql()}
