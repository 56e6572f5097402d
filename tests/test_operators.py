"""Small cases of operators whose edge semantics the tables do not reach."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lineweave import queries
from lineweave.functions import paths
from lineweave.operators import calls as calls_
from lineweave.operators import control, flow, graph, patterns, render, rules, slices, taint
from lineweave.plans.lineage import cut
from lineweave.sources import diffs
from lineweave.sources.code import Code, facts, rows_of, scan
from lineweave.sources.syntax import LANGUAGES, blanked, read
from lineweave.streaming import history as stream


def test_unified_diff(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,3 @@\n keep\n+new\n-old\n+more\n@@ bad @@\n+lost\n--- a/y\n+++ b/src/y.go\n@@ -0,0 +1 @@\n+one"
    df = spark.createDataFrame([(1, text), (2, '{"files":[{"file_path":"z.c","modify_type":"Deleted","diff_lines":[4,2,4]}]}')], "diff_id long, text string")
    got = {tuple(r) for r in diffs.read_diffs(df).collect()}
    assert got == {(1, "x.py", "Modified", 4), (1, "x.py", "Modified", 5), (1, "src/y.go", "Modified", 1), (2, "z.c", "Deleted", 4), (2, "z.c", "Deleted", 2)}


def test_language(spark):
    df = spark.createDataFrame([("a/b.py",), ("x.tsx",), ("Makefile",), ("k.hh",)], "p string")
    assert [r[0] for r in df.select(diffs.language(F.col("p"))).collect()] == ["python", "tsx", None, "cpp"]


def test_access_paths(spark):
    df = spark.createDataFrame([("a.b.c",), ("p->f",), ("buf[i]",), ("(*p).f",), ("x",)], "e string")
    rows = df.select(paths.base(F.col("e")), paths.fields(F.col("e"))).collect()
    assert [(r[0], r[1]) for r in rows] == [("a", ["b", "c"]), ("p", ["f"]), ("buf", ["[]"]), ("p", ["f"]), ("x", [])]


def closure(edges, node):
    seen, todo = set(), [node]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


def test_random_graph(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)}
    edges = {e for e in edges if e[0] != e[1]}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    reach = {n: closure(edges, n) for n in range(14)}
    got = graph.reachable(df, spark.createDataFrame([(n, n) for n in (0, 3, 7)], "origin long, node long"))
    assert {tuple(r) for r in got.collect()} == {(n, m) for n in (0, 3, 7) for m in reach[n] if m != n}
    components = {tuple(r) for r in graph.strong_components(df).collect()}
    assert components == {(n, min(m for m in reach[n] if n in reach[m])) for n in range(14) if any(n in reach[m] for m in reach[n] if m != n)}
    sources, sinks = spark.createDataFrame([(0,), (1,)], "node long"), spark.createDataFrame([(5,), (9,)], "node long")
    ahead, behind = {0, 1} | reach[0] | reach[1], {n for n in range(14) if n in (5, 9) or reach[n] & {5, 9}}
    assert {r[0] for r in graph.chop(df, sources, sinks).collect()} == ahead & behind


def test_delta_of_equal_versions_is_empty(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert slices.delta(df, df).count() == 0


def test_text_block(spark):
    lines = spark.createDataFrame([("f", 1, False), ("f", 4, True), ("f", 4, False)], "file string, line long, is_diff boolean")
    source = spark.createDataFrame([("f", 1, "one"), ("f", 4, "four")], "file string, line long, text string")
    assert render.text_blocks(lines, source).first()["block"] == "    1|one\n  ...|...\n+   4|four"
    assert render.paper_json(lines).first()["json"] == '{"file":"f","diff_lines":[4],"diff_list":{"1":0,"4":1}}'


def test_contract_conditions(spark):
    cases = {"x is None": "non-null", "!p": "non-null", "len(x) == 0": "non-empty", "isinstance(x, int)": "type-check", "n <= 0": "positive", "n < m": "range-check", "x != nil": "nil-check", "not x": None}
    df = spark.createDataFrame([(c,) for c in cases], "condition string")
    assert {r["condition"]: r["kind"] for r in patterns.contract_conditions(df).collect()} == cases


def test_streamed_churn_is_the_batch_churn(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 8).alias("commit_id"), (F.col("id") % 3).alias("file"), F.expr("timestamp_seconds(1700000000 + id * 86400)").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.churn_windows(live).writeStream.format("memory").queryName("churned").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("churned").collect())) == sorted(map(tuple, stream.churn_windows(rows).collect()))


def test_falsified(spark):
    cases = {("x==5", "if x == 5"): False, ("x == 5", "if x!=5"): True, ("x!=null", "x == null"): True, ("x > 3", "if x > 0"): False, ("x>-1", "x>0"): True, ("x>=1", "x > 0"): None, ("x", "x == 1"): None, ("x > y", "x > 0"): None}
    for (known, text), want in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(flow.falsified(F.col("t"), known)).first()[0] is want


def test_rules(spark):
    cases = {
        "k = h.hexdigest()[:31]": ["HASH_TRUNCATED_BELOW_128_BITS"], "k = h.hexdigest()[:32]": [], "self.user_id = hashlib.md5(x)": ["WEAK_HASH_FOR_IDENTITY"], "cache_put(hashlib.sha1(x))": ["WEAK_HASH_FOR_IDENTITY"],
        "os.system(f'rm {x}')": ["SHELL_TRUE_WITH_INTERPOLATION"], "subprocess.run('%s' % x)": [], "self.api_key: str = 'abc'": ["HARDCODED_SECRET"], "token = os.environ['T']": [], "token = '${T}'": [], "secret = 'TODO'": [], "token == 'abc'": [], "x = 1  # verify=False": [],
    }
    lines = spark.createDataFrame([("f", i, c) for i, c in enumerate(cases)], "file string, line long, text string")
    none = spark.createDataFrame([], "file string, line long")
    functions = spark.createDataFrame([], "file string, name string, start_line long, end_line long")
    got = rules.primitives(lines, none, functions).collect()
    assert sorted((r["line"], r["rule"]) for r in got) == [(i, n) for i, v in enumerate(cases.values()) for n in v]
    assert {r["severity"] for r in got} == {"suggestion"}


def test_cleansed_and_backward_flows_are_no_taint(spark):
    edges = spark.createDataFrame([("f", 2, 4), ("f", 4, 6), ("f", 6, 3), ("f", 12, 14)], "file string, def_line long, use_line long")
    functions = spark.createDataFrame([("f", "a", 1, 10), ("f", "b", 11, 20)], "file string, name string, start_line long, end_line long")
    lines = lambda *ns: spark.createDataFrame([("f", n) for n in ns], "file string, line long")
    got = flow.taint(lines(2, 12), lines(3, 6, 14), edges, functions, lines(13)).collect()
    assert [tuple(r) for r in got] == [("f", 6, 2)]


def test_readers_take_any_text():
    for lang in [*LANGUAGES, "python"]:
        for text in ("", "\n", "}}}((", "if (", "def f(:", "x = ", "/* open", chr(39) * 3, "for (;;) { a[", "func f(", "class A { int", "a" * 5000, "{" * 300, "é = ü + 1;", "switch (x) { case"):
            assert read(text, lang) is not None
    assert read("x", "cobol") is None and read(None, "c").functions == []


def test_reader_of_other_languages():
    java = read("import java.util.List;\nclass A extends B implements C {\n  private int n;\n  @Override\n  public int get(int k) {\n    int m = k;\n    return m;\n  }\n}\n", "java")
    assert [(f.name, f.line, f.end, f.params, f.owner) for f in java.functions] == [("get", 4, 8, ["k"], "A")] or [(f.name, f.line, f.end, f.params, f.owner) for f in java.functions] == [("get", 5, 8, ["k"], "A")]
    assert java.imports == [("List", "java.util.List", "List")] and java.types[0].bases == ["B", "C"]
    rust = read("use std::fs;\nfn f(a: i32, b: &str) -> i32 {\n    let c = a;\n    match c {\n        1 => g(b),\n        _ => h(c),\n    }\n}\n", "rust")
    assert [(f.name, f.params) for f in rust.functions] == [("f", ["a", "b"])]
    assert [(s.kind, s.line, [b.line for b in s.blocks]) for s in rust.functions[0].body] == [("assign", 3, []), ("match", 4, [5, 6])]
    ts = read("export async function f(a: string, b?: number): Promise<void> {\n  const c: string = a;\n  await g(c);\n}\n", "typescript")
    assert [(f.name, f.params, f.is_async) for f in ts.functions] == [("f", ["a", "b"], True)] and ts.functions[0].body[0].defs == ["c"]


def test_comments_and_strings_are_blank():
    assert blanked("a = 'x # y' # z\n", ("#",), None, "'\"") == ["a = '     '    ", ""]
    assert blanked('f("/*") /* g(\n */ h()', ("//",), ("/*", "*/"), '"') == ['f("  ")      ', "    h()"]


def test_python_control_flow(spark):
    text = "def f(a):\n    for x in a:\n        if x:\n            break\n    else:\n        g()\n    try:\n        h()\n    except E:\n        raise\n    finally:\n        k()\n    return 1\n"
    c = Code(facts(spark.createDataFrame([("f.py", "python", text)], "file string, lang string, source string")))
    got = {(r["from_line"], r["to_line"]) for r in control.control_flow(c.statements, c.blocks).collect()}
    assert {(2, 3), (3, 4), (2, 6), (2, 7), (7, 8), (7, 9), (7, 12), (9, 12), (12, 13)} <= got
    assert not {(4, 6), (10, 12)} & got


def test_guards_of_structured_sinks(spark):
    calls = [
        ("a.py", "f", 1, 2, "execute", "cur", ['"select %s"', "x"]), ("a.py", "f", 1, 3, "execute", "cur", ['"select " + x']), ("a.py", "f", 1, 4, "load", "yaml", ["x", "Loader=SafeLoader"]), ("a.py", "f", 1, 5, "load", "yaml", ["x"]),
        ("b.go", "f", 1, 6, "Command", "exec", ['"ls"', '"-l"', "x"]), ("b.go", "f", 1, 7, "Command", "exec", ['"sh"', '"-c"', "x"]), ("c.js", "f", 1, 8, "spawn", "cp", ["x", "[]"]), ("c.js", "f", 1, 9, "spawn", "cp", ["x", "{ shell: true }"]), ("a.py", "f", 1, 10, "get", "requests", ['"x"']),
    ]
    df = spark.createDataFrame(calls, "file string, function string, fn_line int, line int, callee string, qualifier string, args array<string>")
    langs = spark.createDataFrame([("a.py", "python"), ("b.go", "go"), ("c.js", "javascript")], "file string, lang string")
    tainted = df.select("file", "line", F.lit("x").alias("base"))
    assert sorted(r["line"] for r in taint.structured_sinks(df, langs, tainted).collect()) == [3, 5, 7, 9]


def test_absence_on_error_paths(spark):
    text = "int f(int n) {\n    char *p = malloc(n);\n    int k = 0;\n    k = g(p);\n    if (k)\n        goto fail;\n    return 0;\nfail:\n    free(p);\n    return 1;\n}\nint h(int n) {\n    char *q = kmalloc(n);\n    kfree(q);\n    kfree(q);\n    return 0;\n}\n"
    c = Code(facts(spark.createDataFrame([("f.c", "c", text)], "file string, lang string, source string")))
    gotos = c.statements.where("kind = 'goto'").select("file", "function", "line", F.col("text").alias("label"))
    found = patterns.absence(c.statements.select("file", "line"), c.functions, c.calls, c.lines, c.labels, gotos)
    got = {(r["function"], r["line"], r["category"]) for r in found.where("description like '%allocation without free'").collect()}
    assert {("f", 2, "close_only_on_error_path"), ("h", 13, "double_close")} <= got and not any(x[2] == "missing_counterpart" for x in got)


def test_interfaces_are_met_by_all_their_methods(spark):
    text = "package m\ntype R interface {\n\tRead(p int) int\n\tClose() int\n}\ntype A struct {\n\tn int\n}\nfunc (a *A) Read(p int) int {\n\treturn p\n}\nfunc (a *A) Close() int {\n\treturn 0\n}\ntype B struct {\n\tn int\n}\nfunc (b *B) Read(p int) int {\n\treturn p\n}\n"
    c = Code(facts(spark.createDataFrame([("m.go", "go", text)], "file string, lang string, source string")))
    assert [tuple(r) for r in calls_.satisfies(c.types, c.fields, c.functions).collect()] == [("R", "A")]


def test_peers(spark):
    f = spark.createDataFrame([("a", "run_x", 2, 4, "@app.get('/x')", None), ("a", "run_y", 6, 30, "@app.get('/y')", "K"), ("b", "other", 1, 2, None, None)], "file string, name string, start_line int, end_line int, decorator string, owner string")
    names = lambda changed, p: {r["name"] for r in patterns.peers(f.where(changed).select("file", "name", "start_line"), f, p).collect()}
    assert names("name = 'run_x'", "auto") == {"run_x", "run_y"} and names("name = 'other'", "auto") == {"run_x", "run_y", "other"}
    assert names("name = 'other'", "name:run*") == {"run_x", "run_y", "other"} and names("name = 'other'", "class:K") == {"run_y", "other"}
    assert {r["line"] for r in patterns.peers(f.where("name = 'run_y'").select("file", "name", "start_line"), f, "class:K").collect()} == {*range(6, 17), 30}


def test_scan_reads_files_below_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    (tmp_path / "c.go").write_text("package c\n")
    assert {r["file"] for r in scan(spark, str(tmp_path)).collect()} == {"src/a.py", "c.go"}
    assert {r["file"] for r in scan(spark, str(tmp_path), spark.createDataFrame([("c.go",)], "file string")).collect()} == {"c.go"}


def test_ranges_of_origins(spark):
    cases = {"x = transform(y)": "Unknown", "x = form(y)": "UserInput", 'x = "a"': "Constant", "cursor.execute(q)": "Database", "prefetch(y)": "Unknown", "k = os.environ[n]": "EnvVar", "cfg.load()": "Config"}
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    assert {r["text"]: r["origin"] for r in patterns.classify(df).collect()} == cases


def test_return_classes(spark):
    cases = {"": "Void", "None": "Null", "true": "Bool", "x, nil": "GoSuccess", "nil, err": "GoError", "0x1F": "Numeric", "f'a'": "StringLit", "[]": "EmptyCollection", "new A()": "ConstructedValue", "Foo(1)": "ConstructedValue", "a + b": "Expression"}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r["v"]: r["c"] for r in df.select("v", patterns.return_class(F.col("v"), F.lit(True)).alias("c")).collect()} == cases


def test_command_line(spark, tmp_path, capsys):
    from lineweave.__main__ import main

    (tmp_path / "a.py").write_text("def f(x):\n    y = x\n    return y\n\ndef g(z):\n    return f(z)\n")
    (tmp_path / "d.diff").write_text("--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,3 @@\n def f(x):\n+    y = x\n     return y\n")
    base = ["--repo", str(tmp_path), "--diff", str(tmp_path / "d.diff")]
    assert main([*base, "-a", "left_flow"], spark) == 0
    assert capsys.readouterr().out == "# Block 1 [left_flow] a.py\n    1|def f(x):\n+   2|    y = x\n    3|    return y\n"
    assert main([*base, "-a", "original_diff,thin_slice", "--format", "paper"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ['{"file":"a.py","diff_lines":[2],"diff_list":{"2":1}}', '{"file":"a.py","diff_lines":[2],"diff_list":{"2":1,"3":0}}']
    assert main([*base, "--format", "callers"], spark) == 0
    assert capsys.readouterr().out.split() == ["a.py", "f", "1", "a.py", "g"]


def test_blocks_of_several_files_and_findings(spark):
    import json

    lines = spark.createDataFrame([(1, "a", "a", 1, True), (1, "a", "b", 2, False), (1, "a", "b", 5, False), (1, "a", "gone", 1, False)], "block_id int, block_file string, file string, line int, is_diff boolean")
    source = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 5, "z")], "file string, line int, text string")
    text = "# Block 1 [t] a\n--- a\n+   1|x\n--- b\n    2|y\n  ...|...\n    5|z"
    assert [tuple(r) for r in render.blocks_text(lines, source, "t").collect()] == [(1, text)]
    findings = spark.createDataFrame([("a", 1, "taint_sink", "warning"), ("b", 2, "x", "info")], "file string, line int, category string, severity string")
    review = render.review_json(lines, source, findings, "t")
    got = json.loads(review.first()["json"])
    assert (got["text"], got["cross_file_refs"], got["findings"]) == (text, ["b", "gone"], [{"line": 1, "category": "taint_sink", "severity": "warning"}])
    multi = json.loads(render.multi_json({"t": review}, findings).first()["json"])
    assert (multi["version"], multi["algorithms_run"], len(multi["results"]), len(multi["all_findings"])) == ("1.0", ["t"], 1, 2)
    hook = spark.createDataFrame([("h.c", 3, 'g_signal_connect(bus, "  ", G_CALLBACK(on_call), NULL);')], "file string, line int, code string")
    none = spark.createDataFrame([], "file string, function string, callee string, callee_file string")
    assert [tuple(r) for r in render.callers_report(spark.createDataFrame([("a.c", "on_call")], "file string, name string"), none, hook).collect()] == [("a.c", "on_call", "h.c", "g_signal_connect", 1, "untrusted_ipc", "dbus_callback")]


def test_facts_of_many_files_leave_in_small_batches():
    class Files:
        """What facts() asks of a table; gives back the pass itself."""

        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    text = "def f(a):\n    b = a\n    return b\n"
    given = pa.RecordBatch.from_pydict({"file": [f"f{k}.py" for k in range(900)], "lang": ["python"] * 899 + ["lua"], "source": [text] * 898 + [None, text]})
    one = list(rows_of("f0.py", "python", read(text, "python")))
    out = list(facts(Files())(iter([given, given.slice(0, 0)])))
    assert sum(b.num_rows for b in out) == 898 * len(one) > 10_000
    assert max(b.num_rows for b in out) <= 10_000
    assert [tuple(r.values()) for r in out[0].slice(0, len(one)).to_pylist()] == one


def test_walks_from_more_origins_than_a_word_has_bits(spark, monkeypatch):
    rng = random.Random(9)
    edges = {(rng.randrange(90), rng.randrange(90)) for _ in range(400)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(3)
    reach = {n: closure(edges, n) for n in range(90)}
    starts = spark.createDataFrame([(n, n) for n in range(80)], "origin long, node long").repartition(5)
    written = []
    monkeypatch.setattr(graph, "cut", lambda x: written.append(cut(x)) or written[-1])
    got = [tuple(r) for r in graph.reachable(df, starts).collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, m) for n in range(80) for m in reach[n] if m != n}
    # a round writes a row for 64 origins at most, not one for each that reaches a node
    assert sum(x.count() for x in written if "hop" in x.columns) * 4 < len(got)
    pairs = spark.createDataFrame([(n, m) for n in range(0, 80, 7) for m in range(90)] * 2, "src long, dst long")
    want = {(n, m) for n in range(0, 80, 7) for m in range(90) if m == n or m in reach[n]}
    assert sorted(tuple(r) for r in graph.has_path(df, pairs).collect()) == sorted(want)
    few = spark.createDataFrame([(n,) for n in range(0, 80, 7)], "node long")
    got = graph.paths_between(df, few, spark.range(30, 60).withColumnRenamed("id", "node"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, m) for n, m in want if 30 <= m < 60)


def test_vertical_places(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(150)})

    def hops(pairs, start, most):
        found, last = {start: 0}, {start}
        for h in range(1, most + 1):
            last = {b for a, b in pairs if a in last} - found.keys()
            found |= dict.fromkeys(last, h)
        return found

    want = set()
    for t in range(70):
        up, down = hops([(b, a) for a, b in edges], t, 3), hops(edges, t, 3)
        want |= {(t, n, -up[n] if n in up else down[n]) for n in up.keys() | down.keys()}
    got = flow.vertical(spark.createDataFrame(edges, "src long, dst long"), spark.range(70).withColumnRenamed("id", "node"), 3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_callees_of_every_rank(spark):
    rng = random.Random(3)
    files = [f"p{k % 3}/m{k % 7}_{k}.py" if k % 2 else f"q{k}/m{k % 7}.py" for k in range(40)]
    functions = [(rng.choice(files), f"n{rng.randrange(4)}", rng.random() < 0.4) for _ in range(70)]
    imports = [(rng.choice(files), f"a{rng.randrange(3)}", f"x/m{rng.randrange(7)}.z") for _ in range(60)]
    sites = [(rng.choice(files), rng.randrange(9), f"n{rng.randrange(5)}", f"a{rng.randrange(4)}") for _ in range(120)]
    static = {}
    for f, n, s in functions:
        static[n, f] = static.get((n, f), False) or s
    want, start = set(), lambda p: p.split("/")[-1].split(".")[0]
    for f, line, n, q in sites:
        modules = {start(m) for g, a, m in imports if (g, a) == (f, q)}
        rank = {g: 0 if s and g == f else 1 if start(g) in modules else 2 for (m, g), s in static.items() if m == n and (s and g == f or start(g) in modules or not s)}
        want |= {(f, line, n, q, g) for g, r in rank.items() if r == min(rank.values())}
    frames = spark.createDataFrame(sites, "file string, line int, callee string, qualifier string"), spark.createDataFrame(functions, "file string, name string, is_static boolean"), spark.createDataFrame(imports, "file string, alias string, module string")
    assert sorted(tuple(r) for r in flow.resolve_callees(*frames).collect()) == sorted(want)


def test_candidates_are_not_dealt_out_again(spark):
    """All sites call one name that all files have: no shuffle may write a row for each candidate."""
    functions = spark.range(300).selectExpr("concat('f', id, '.py') as file", "'n' as name", "false as is_static")
    sites = spark.range(200).selectExpr("concat('s', id, '.py') as file", "id as line", "'n' as callee", "'' as qualifier")
    found = flow.resolve_callees(sites, functions, spark.createDataFrame([], "file string, alias string, module string"))
    assert found.count() == found.distinct().count() == 60_000
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    deep = lambda line: re.search("[A-Z]", line).start()
    made = [k for k, line in enumerate(plan) if "Generate explode(files" in line]
    assert made
    for k in made:
        depth = deep(plan[k])
        for line in reversed(plan[:k]):
            if line.strip() and deep(line) < depth:
                depth = deep(line)
                assert not any(w in line for w in ("Window", "Aggregate", "Join", "Sort"))


def test_counterparts_meet_by_name(spark):
    """Every file has both names of a pair: names meet names, so no row for each pair of files is made."""
    functions = spark.range(200).selectExpr("concat('f', id) as file", "explode(array('Open_1', 'close_1', 'OPEN_1', 'alone')) as name")
    changed = functions.where("name in ('Open_1', 'alone') or (name = 'close_1' and file < 'f2')")
    found = patterns.symmetry(functions, changed)
    want = {(r["file"], r["name"], r["counterpart"]) for r in found.collect()}
    rows = [tuple(r) for r in patterns.counterparts(functions, changed).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {r[1:] for r in rows} == {("Open_1", "close_1"), ("close_1", "OPEN_1")}
    asked = set(queries.symmetry_slice(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split())
    assert not any("counterpart_file" in w for w in asked)
