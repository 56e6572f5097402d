"""Queries by word and pattern tables over source lines and function names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables
from .slices import enclosing_functions
from .taint import any_of

def angle(source_lines: DataFrame, functions: DataFrame, words=tables.CONCERNS["error_handling"]) -> DataFrame:
    """(file, line): lines with a word of the concern, and the first and last line of the functions around them."""
    hit = source_lines.where(any_of(F.col("text"), words)).select("file", "line")
    ends = enclosing_functions(hit, functions).select("file", F.explode(F.array("start_line", "end_line")).alias("line"))
    return hit.unionByName(ends).distinct()


def has(text: Column, pattern: str) -> Column:
    """Whether a text has a pattern in it; with a leading ~, only if no word character stands before its first occurrence."""
    if not pattern.startswith("~"):
        return text.contains(pattern)
    at = F.instr(text, pattern[1:])
    return (at > 0) & ~F.coalesce(F.substring(text, at - 1, F.lit(1)).rlike("[A-Za-z0-9_]") & (at > 1), F.lit(False))


def classify(lines: DataFrame, classes=tables.ORIGINS, default: str = "Unknown") -> DataFrame:
    """lines (with text) and origin: the first class one of whose patterns the line has. classes: (name, patterns)."""
    out = F.lit(default)
    for name, patterns in reversed(classes):
        hit = F.lit(False)
        for p in dict.fromkeys(patterns):
            hit = hit | has(F.col("text"), p)
        out = F.when(hit, name).otherwise(out)
    return lines.withColumn("origin", out)


def provenance(points: DataFrame, definitions: DataFrame, lines: DataFrame, params: DataFrame) -> DataFrame:
    """(file, line, name, origin, severity) of the names on diff lines: points (file, line, name), names of one letter left out.

    The first that tells: the name's definitions in the file in line order, the diff line itself, the signature of a
    function around it. definitions: (file, line, name); lines: (file, line, text); params: (file, line, name): diff lines
    whose function's first line has the name.
    """
    wanted = points.where("length(name) > 1").distinct()
    told = classify(lines).where("origin <> 'Unknown'").select("file", "line", "origin")
    by_def = wanted.join(definitions.select("file", "name", F.col("line").alias("d")).distinct(), ["file", "name"]).join(told.withColumnRenamed("line", "d"), ["file", "d"])
    by_def = by_def.select("file", "line", "name", F.struct(F.lit(1).alias("step"), F.col("d").cast("long").alias("at"), "origin").alias("o"))
    by_line = wanted.join(told, ["file", "line"]).select("file", "line", "name", F.struct(F.lit(2).alias("step"), F.col("line").cast("long").alias("at"), "origin").alias("o"))
    by_param = wanted.join(params, ["file", "line", "name"], "left_semi").select("file", "line", "name", F.struct(F.lit(3).alias("step"), F.col("line").cast("long").alias("at"), F.lit("FunctionParam").alias("origin")).alias("o"))
    best = by_def.unionByName(by_line).unionByName(by_param).groupBy("file", "line", "name").agg(F.min("o").alias("o"))
    severity = F.lit(None).cast("string")
    for name, level in tables.ORIGIN_SEVERITY.items():
        severity = F.when(F.col("origin") == name, level).otherwise(severity)
    out = wanted.join(best, ["file", "line", "name"], "left").select("file", "line", "name", F.coalesce("o.origin", F.lit("Unknown")).alias("origin"))
    return out.withColumn("severity", severity)


def mirrored(name: Column, mirrors=tables.MIRRORS) -> Column:
    """The names that would mirror a lower-cased name, by the first word that it holds: pair by pair, left words first."""
    rows = [(w, side[1 - k]) for side in mirrors for k in (0, 1) for w in side[k]]
    table = F.array(*(F.struct(F.lit(w.lower()).alias("word"), F.array(*(F.lit(o.lower()) for o in others)).alias("others")) for w, others in rows))
    first = F.get(F.filter(table, lambda r: name.contains(r["word"])), F.lit(0))
    return F.transform(first["others"], lambda o: F.replace(name, first["word"], o))


def mirrors_of(functions: DataFrame, changed: DataFrame, mirrors=tables.MIRRORS) -> tuple[DataFrame, DataFrame]:
    """(name, other) of the changed names, and functions (file, name) without those changed; each distinct."""
    names = changed.select("name").distinct()
    wanted = names.select("name", F.explode(F.array_distinct(mirrored(F.lower("name"), mirrors))).alias("other"))
    left = functions.select("file", "name").distinct().join(changed.select("file", "name").distinct(), ["file", "name"], "left_anti")
    return wanted, left


def symmetry(functions: DataFrame, changed: DataFrame, mirrors=tables.MIRRORS) -> DataFrame:
    """(file, name, counterpart, counterpart_file): unchanged counterparts of changed functions, in any file.

    changed: (file, name); functions: (file, name). Every file with a name meets every file with its counterpart, so the
    rows grow with the square of the files; where the counterpart's file is not asked for, counterparts() has the rest.
    """
    wanted, left = mirrors_of(functions, changed, mirrors)
    there = left.select(F.lower("name").alias("other"), F.col("name").alias("counterpart"), F.col("file").alias("counterpart_file"))
    return changed.select("file", "name").distinct().join(wanted, "name").join(there, "other").select("file", "name", "counterpart", "counterpart_file")


def counterparts(functions: DataFrame, changed: DataFrame, mirrors=tables.MIRRORS) -> DataFrame:
    """symmetry() without the counterpart's file, distinct: names meet names, and only then files."""
    wanted, left = mirrors_of(functions, changed, mirrors)
    there = left.select(F.lower("name").alias("other"), F.col("name").alias("counterpart")).distinct()
    return changed.select("file", "name").distinct().join(wanted.join(there, "other").select("name", "counterpart"), "name").select("file", "name", "counterpart")


def peer_consistency(facts: DataFrame) -> DataFrame:
    """(file, peer, kind, size, guards, derefs): groups of three or more functions that share a first parameter.

    facts: (file, peer, guarded, dereferenced). uniform: none guards and at least 0.8 dereference; divergent: at least
    three guard and more dereference than guard.
    """
    g = facts.groupBy("file", "peer").agg(F.count("*").alias("size"), F.count_if("guarded").alias("guards"), F.count_if("dereferenced").alias("derefs")).where("size >= 3")
    kind = F.when((F.col("guards") == 0) & (F.col("derefs") / F.col("size") >= 0.8), "uniform").when((F.col("guards") >= 3) & (F.col("derefs") > F.col("guards")), "divergent")
    return g.withColumn("kind", kind).where("kind is not null")


def matched(full: Column, callee: Column, code: Column, side: int) -> Column:
    """The numbers of the pairs one of whose patterns a call (full name and last part) or, where those are null, a line's code has."""
    calls, texts = [], []
    for n, pair in enumerate(tables.PAIRS):
        for p in pair[side]:
            base = p[:-1].lstrip(".") if p.endswith("(") else None
            if base:
                calls.append(F.struct(F.lit(n).alias("n"), F.lit(base).alias("base"), F.lit(base.rsplit(".", 1)[-1]).alias("last")))
            else:
                texts.append(F.struct(F.lit(n).alias("n"), F.lit(p).alias("text")))
    exact = lambda r: (callee == F.substring(r["base"], 2, 1 << 20)) & r["base"].startswith("=")
    by_call = F.filter(F.array(*calls), lambda r: exact(r) | full.contains(r["base"]) | (callee == r["last"]))
    by_text = F.filter(F.array(*texts), lambda r: code.contains(r["text"]))
    return F.array_distinct(F.concat(F.coalesce(F.transform(by_call, lambda r: r["n"]), F.array().cast("array<int>")), F.coalesce(F.transform(by_text, lambda r: r["n"]), F.array().cast("array<int>"))))


def absence(diff_lines: DataFrame, functions: DataFrame, calls: DataFrame, code: DataFrame, labels: DataFrame | None = None, gotos: DataFrame | None = None) -> DataFrame:
    """(file, function, line, description, category, severity): what diff lines open and their function does not close.

    Patterns that end in a parenthesis are looked for among the calls, the others in the code without comments and strings.
    missing_counterpart: no closing in the function and no clean-up word. With labels (Code.labels) and gotos (file,
    function, line): close_only_on_error_path where all closings stand behind clean-up labels, and
    missing_close_on_error_path where a goto two lines or more behind the opening leads to a label with no closing from
    there on. double_close: two closings of one pair with the same call text in one function.

    calls: (file, line, callee, qualifier, args); code: (file, line, code); functions: (file, name, start_line, end_line).
    """
    none = F.lit(None).cast("string")
    events = calls.select("file", "line", F.concat_ws(".", "qualifier", "callee").alias("full"), "callee", none.alias("code"), F.concat_ws(",", "args").alias("what"))
    events = events.unionByName(code.select("file", "line", none.alias("full"), none.alias("callee"), "code", none.alias("what")))
    side = lambda k: events.select("file", "line", "what", F.explode(matched(F.col("full"), F.col("callee"), F.col("code"), k)).alias("pair"))
    spans = enclosing_functions(diff_lines.select("file", "line").distinct(), functions.select("file", "name", "start_line", "end_line"))
    opens = spans.join(side(0).select("file", "line", "pair").distinct(), ["file", "line"]).select("file", F.col("name").alias("function"), "line", "start_line", "end_line", "pair")
    closes = side(1).select("file", F.col("line").alias("c"), "pair", "what")
    within = opens.join(closes, ["file", "pair"], "left")
    inside = F.col("c").between(F.col("start_line"), F.col("end_line"))
    key = ["file", "function", "line", "start_line", "end_line", "pair"]
    counted = within.groupBy(*key).agg(F.coalesce(F.max(inside), F.lit(False)).alias("closed"))
    tidy = code.where(any_of(F.col("code"), tables.CLEANUP)).select("file", F.col("line").alias("t"))
    tidied = opens.select("file", "function", "start_line", "end_line").distinct().join(tidy, "file").where(F.col("t").between(F.col("start_line"), F.col("end_line"))).select("file", "function", "start_line").distinct()
    missing = counted.where("not closed").join(tidied, ["file", "function", "start_line"], "left_anti").select("file", "function", "line", "pair", F.lit("missing_counterpart").alias("category"), F.lit("warning").alias("severity"))
    again = within.where(inside & F.col("what").isNotNull()).groupBy(*key, "what").agg(F.countDistinct("c").alias("n")).where("n > 1")
    out = missing.unionByName(again.select("file", "function", "line", "pair", F.lit("double_close").alias("category"), F.lit("warning").alias("severity")))
    if labels is not None:
        l = labels.where("cleanup").select("file", "function", F.col("line").alias("l0"), F.col("end_line").alias("l1"))
        placed = within.where(inside).join(l, ["file", "function"], "left").withColumn("behind", F.coalesce(F.col("c").between(F.col("l0"), F.col("l1")), F.lit(False)))
        each = placed.groupBy(*key, "c").agg(F.max("behind").alias("behind")).groupBy(*key).agg(F.min("behind").alias("only"))
        out = out.unionByName(each.where("only").select("file", "function", "line", "pair", F.lit("close_only_on_error_path").alias("category"), F.lit("info").alias("severity")))
    if labels is not None and gotos is not None:
        to = labels.select("file", "function", F.col("name").alias("label"), F.col("line").alias("l0"))
        jumps = opens.join(gotos.select("file", "function", F.col("line").alias("g"), "label"), ["file", "function"]).where("g > line + 2").join(to, ["file", "function", "label"])
        late = jumps.join(closes, ["file", "pair"], "left").groupBy(*key, "g", "l0").agg(F.coalesce(F.max(F.col("c").between(F.col("l0"), F.col("end_line"))), F.lit(False)).alias("closed"))
        out = out.unionByName(late.where("not closed").select("file", "function", "line", "pair", F.lit("missing_close_on_error_path").alias("category"), F.lit("warning").alias("severity")))
    names = F.element_at(F.array(*(F.lit(p[2]) for p in tables.PAIRS)), F.col("pair") + 1)
    return out.select("file", "function", "line", names.alias("description"), "category", "severity").distinct()


def layer(path: Column, order: list[str] | None = None) -> Column:
    """The layer of a file's path: the first word of the list in it, or of the caller's own layers; else Application or Unknown."""
    out = F.lit("Application" if order is None else "Unknown")
    for word, name in reversed(tables.LAYERS if order is None else [(o.lower(), o) for o in order]):
        out = F.when(F.lower(path).contains(word), name).otherwise(out)
    return out


def decorated(functions: DataFrame) -> DataFrame:
    """functions with mark: what stands before the parenthesis of the decorator above them."""
    return functions.withColumn("mark", F.substring_index("decorator", "(", 1))


def peers(changed: DataFrame, functions: DataFrame, pattern: str = "auto", preview: int = 10) -> DataFrame:
    """(file, name, line): first preview + 1 lines and end line of changed functions and of their peers.

    pattern: auto (the same decorator where the changed function has one, else every function of every file), name:X with
    a * before or behind, class:X, decorator:X, siblings. functions: (file, name, start_line, end_line, decorator, owner);
    changed: (file, name, start_line).
    """
    f = decorated(functions.select("file", "name", "start_line", "end_line", "decorator", "owner"))
    kind, _, what = pattern.partition(":")
    if kind == "name":
        core = what.strip("*")
        found = f.where(F.col("name").endswith(core) if what.startswith("*") else F.col("name").startswith(core) if what.endswith("*") else F.col("name").contains(core))
    elif kind == "class":
        found = f.where(F.col("owner").contains(what))
    elif kind == "decorator":
        found = f.where(F.col("mark") == what.partition("(")[0])
    elif kind == "siblings":
        found = f
    else:
        marks = f.join(changed.select("file", "name", "start_line"), ["file", "name", "start_line"], "left_semi").select("mark").distinct()
        by_mark = f.join(marks.where("mark is not null"), "mark", "left_semi")
        # one changed function without a decorator makes every function a peer
        bare = marks.where("mark is null").select(F.lit(1).alias("one")).limit(1)
        found = by_mark.unionByName(f.withColumn("one", F.lit(1)).join(F.broadcast(bare), "one", "left_semi").select(by_mark.columns)).distinct()
    own = f.join(changed.select("file", "name", "start_line"), ["file", "name", "start_line"], "left_semi")
    lines = F.array_union(F.sequence("start_line", F.least(F.col("start_line") + preview, "end_line")), F.array("end_line"))
    return found.select(own.columns).unionByName(own).distinct().select("file", "name", F.explode(lines).alias("line")).distinct()


def contract_conditions(conditions: DataFrame) -> DataFrame:
    """conditions (with condition) and kind: what a guard asks for, by the first rule that matches."""
    c, v = F.col("condition"), r"[A-Za-z_][A-Za-z0-9_.]*"
    null = "(None|null|nil|NULL|nullptr)"
    rules = [
        ("non-null", rf"^({v} (is|==) {null}|{null} == {v})$"), ("non-null", rf"^!{v}$"), ("non-null", rf"^({v} == (0|false)|(0|false) == {v})$"),
        ("non-empty", r"len\(.*(== 0|< 1)"), ("non-empty", r"\.length.*(=== 0|== 0|< 1)"), ("non-empty", r"^.*\.is_empty\(\)$"), ("type-check", r"^isinstance\("), ("type-check", r"^typeof "),
        ("positive", rf"^{v} (<|<=) 0$"), ("range-check", rf"^{v} (<|>|<=|>=) ({v}|[0-9]+)$"), ("non-empty", rf"^{v} == (\"\"|'')$"), ("nil-check", rf"^({v} != (nil|null|None)|(nil|null|None) != {v})$"),
    ]
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        kind = F.when(c.rlike(pattern), name).otherwise(kind)
    return conditions.withColumn("kind", kind)


def return_class(value: Column, go: Column) -> Column:
    """What a returned text is; go tells whether it stands in a Go function, whose pairs come first."""
    v = F.trim(value)
    pair = v.rlike(r"^.+,\s*[^,]+$")
    return (
        F.when(F.coalesce(v, F.lit("")) == "", "Void")
        .when(v.isin("None", "null", "nil", "NULL", "nullptr", "undefined"), "Null")
        .when(v.isin("True", "False", "true", "false"), "Bool")
        .when(go & pair & v.rlike(r",\s*nil$"), "GoSuccess")
        .when(go & pair & v.rlike(r'^(nil|""|0)\s*,'), "GoError")
        .when(go & pair, "Expression")
        .when(v.rlike(r"^-?(0x[0-9a-fA-F]+|0b[01]+|[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?)$"), "Numeric")
        .when(v.rlike(r"^[a-zA-Z]?[\"'`]"), "StringLit")
        .when(v.isin("[]", "{}", "()", "new Array()", "new Map()"), "EmptyCollection")
        .when(v.rlike(r"^new |::new\(|^[A-Z][A-Za-z0-9_]*\(.*\)$"), "ConstructedValue")
        .otherwise("Expression")
    )


def postconditions(functions: DataFrame, returns: DataFrame, throws: DataFrame, langs: DataFrame) -> DataFrame:
    """(file, name, start_line, postcondition): what each function promises of what it returns, by a list of rules in order.

    functions without a return promise void in Go, Rust, C, C++ and Java, and nothing elsewhere. returns: (file, function,
    fn_line, value); throws: (file, function, fn_line); langs: (file, lang).
    """
    key = ["file", "function", "fn_line"]
    rows = returns.join(langs, "file").withColumn("c", return_class(F.col("value"), F.col("lang") == "go"))
    n = lambda *kinds: F.count_if(F.col("c").isin(*kinds))
    typed = F.when(F.col("c").isin("Bool"), "bool").when(F.col("c") == "Numeric", "numeric").when(F.col("c") == "StringLit", "string").when(F.col("c") == "EmptyCollection", "collection").when(F.col("c") == "ConstructedValue", "object").when(F.col("c") == "Expression", "expression")
    values = ("Numeric", "StringLit", "EmptyCollection", "ConstructedValue", "Expression", "Bool", "GoSuccess")
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), n("Void").alias("void"), n("Bool").alias("bool"), n("GoError").alias("bad"), n("GoSuccess").alias("good"), n("Null").alias("null"), n(*values).alias("value"), F.collect_set(typed).alias("types"))
    f = functions.select("file", F.col("name").alias("function"), F.col("start_line").alias("fn_line")).join(langs, "file").join(g, key, "left").join(throws.select(*key, F.lit(True).alias("throws")).distinct(), key, "left")
    one = F.get("types", F.lit(0))
    sure = (F.col("null") == 0) & (F.col("value") > 0) & (F.col("void") == 0) & (F.col("bad") == 0)
    rule = (
        F.when(F.col("n").isNull() & F.col("lang").isin("go", "rust", "c", "cpp", "java"), "void")
        .when(F.col("n").isNull(), None)
        .when(F.col("void") == F.col("n"), "void")
        .when(F.col("bool") == F.col("n"), "bool")
        .when((F.col("bad") > 0) & (F.col("good") > 0), "go result pair")
        .when((F.col("null") > 0) & (F.col("value") > 0), "nullable")
        .when(sure & F.coalesce("throws", F.lit(False)), "non-null-or-throws")
        .when(sure & (F.size("types") == 1) & (one != "expression"), F.concat(F.lit("consistent-type "), one))
        .when(sure, "non-null")
        .otherwise("mixed")
    )
    return f.select("file", F.col("function").alias("name"), F.col("fn_line").alias("start_line"), rule.alias("postcondition")).where("postcondition is not null")


def contract_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, name, variable, change): preconditions (file, name, variable, kind) that were weakened or strengthened."""
    a, b = old.select("file", "name", "variable", F.col("kind").alias("k0")).distinct(), new.select("file", "name", "variable", F.col("kind").alias("k1")).distinct()
    both = old.select("file", "name").distinct().join(new.select("file", "name").distinct(), ["file", "name"])
    rows = a.join(b, ["file", "name", "variable"], "full_outer").join(both, ["file", "name"], "left_semi")
    return rows.where("k0 is null or k1 is null").select("file", "name", "variable", F.when(F.col("k1").isNull(), "weakened").otherwise("strengthened").alias("change"))


def parse_quality(files: DataFrame) -> DataFrame:
    """files (error_count, node_count) with quality: unparseable, poor, degraded, or null."""
    rate = F.when(F.col("node_count") > 0, F.col("error_count") / F.col("node_count")).otherwise(0.0)
    return files.withColumn("quality", F.when(rate > 0.30, "unparseable").when(rate > 0.10, "poor").when(rate > 0.01, "degraded"))
