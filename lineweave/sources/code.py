"""Source files as relations: one pass of the readers over the files gives a table of facts, and each relation is a filter of it.

files: (file, lang, source). A file in a language without a reader, or that is null or empty, gives no facts but its
lines; text that does not parse gives its error lines and what could be read. Each file is read by itself, so the pass
is a map over the files, dealt as they come, and a repeated file gives its facts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .diffs import language
from .syntax import Block, Function, Statement, Unit, read

FACTS = "relation string, file string, function string, fn_line int, line int, end_line int, kind string, name string, path string, text string, items array<string>, n int"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
#: Files taken out of a batch at once, and rows given back at once.
FILES, ROWS = 64, 8192
TYPES = [pa.int32() if c.endswith(" int") else pa.list_(pa.string()) if "array" in c else pa.string() for c in FACTS.split(", ")]


def scan(spark: SparkSession, folder: str, changed: DataFrame | None = None) -> DataFrame:
    """(file, lang, source) of the files below a folder whose extension has a language; with changed (file), only those.

    file is the path below the folder. Unknown extensions are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://")[-1].rstrip("/") + "/"
    files = raw.select(F.substring_index("path", root, -1).alias("file"), F.decode("content", "UTF-8").alias("source"))
    files = files.select("file", language(F.col("file")).alias("lang"), "source").where("lang is not null")
    return files if changed is None else files.join(changed.select("file").distinct(), "file", "left_semi")


def rows_of(file: str, lang: str | None, unit: Unit):
    """The facts of one file, as tuples in the order of COLUMNS."""

    def fact(relation, f: Function | None, line, end=None, kind=None, name=None, path=None, text=None, items=None, n=None):
        return relation, file, f and f.name, f and f.line, line, line if end is None else end, kind, name, path, text, items, n

    def walk(body: list[Statement], f: Function | None, conditional: bool):
        for s in body:
            yield fact("statement", f, s.line, s.end, s.kind, text=s.text or None)
            for d in s.defs:
                yield fact("access", f, s.line, kind="def", name=d.split(".")[0], path=d)
            for line, u in s.uses:
                yield fact("access", f, line, kind="use", name=u.split(".")[0], path=u)
            for c in s.calls:
                yield fact("call", f, c.line, name=c.callee, path=c.qualifier, items=c.args)
            for line, t in s.tests:
                yield fact("test", f, line, name=t)
            for a, b in s.alias:
                yield fact("alias", f, s.line, name=a, path=b)
            if s.kind == "return":
                yield fact("return", f, s.line, s.end, "conditional" if conditional else "plain", text=s.text)
            for k, b in enumerate(s.blocks):
                last = b.body[-1] if b.body else None
                yield fact("block", f, b.line, b.end, s.kind, b.role, text=last and last.kind, n=k, path=str(s.line), items=[str(s.end), str(last.line if last else b.line)])
                for d in declared(b):
                    yield fact("scope", f, b.line, b.end, name=d)
                yield from walk(b.body, f, conditional or s.kind in ("if", "loop", "switch", "match", "try"))

    def declared(b: Block):
        return [d for s in b.body for d in s.declares]

    for k, code in enumerate(unit.code, 1):
        yield fact("line", None, k, text=code)
    for line in sorted(set(unit.errors)):
        yield fact("error", None, line)
    for alias, module, there in unit.imports:
        yield fact("import", None, 1, name=alias, path=module, text=there)
    for t in unit.types:
        yield fact("type", None, t.line, t.end, t.kind, t.name, items=t.bases)
        for field in t.fields:
            yield fact("field", None, t.line, name=t.name, path=field)
    for name in sorted(set(unit.made)):
        yield fact("made", None, 1, name=name)
    for line, name in unit.names:
        yield fact("identifier", None, line, name=name)
    for f in unit.functions:
        marks = [w for w, on in (("static", f.static), ("variadic", f.variadic), ("async", f.is_async)) if on]
        yield fact("function", f, f.line, f.end, ",".join(marks), f.name, f.owner, f.decorator, f.params)
        for k, (p, t) in enumerate(zip(f.params, f.types or [""] * len(f.params), strict=True)):
            yield fact("parameter", f, f.line, name=p, text=t, n=k)
        yield from walk(f.body, f, False)
    yield from walk(unit.body, None, False)


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows as record batches of at most ROWS."""
    while part := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), TYPES, strict=True)], names=COLUMNS)


def facts(files: DataFrame) -> DataFrame:
    """Everything that the readers find in (file, lang, source). A task holds the facts of one file and a batch of rows, however many files it is given."""

    def found(given):
        for batch in given:
            for k in range(0, batch.num_rows, FILES):
                for file, lang, source in zip(*(c.to_pylist() for c in batch.slice(k, FILES).columns), strict=True):
                    unit = read(source, lang) if source else None
                    if unit is not None:
                        yield from rows_of(file, lang, unit)

    return files.select("file", "lang", "source").mapInArrow(lambda given: batches(found(given)), FACTS)


class Code:
    """The relations of a table of facts."""

    def __init__(self, found: DataFrame):
        self.facts = found

    def of(self, relation: str, *columns: str | Column) -> DataFrame:
        return self.facts.where(F.col("relation") == relation).select(*columns)

    @property
    def functions(self) -> DataFrame:
        flag = lambda w: F.array_contains(F.split("kind", ","), w)
        return self.of("function", "file", "name", F.col("line").alias("start_line"), F.col("end_line"), F.col("items").alias("params"), F.col("path").alias("owner"), F.col("text").alias("decorator"), flag("static").alias("is_static"), flag("variadic").alias("is_variadic"), flag("async").alias("is_async"))

    @property
    def parameters(self) -> DataFrame:
        return self.of("parameter", "file", "function", "fn_line", F.col("n").alias("index"), "name", F.col("text").alias("type"))

    @property
    def identifiers(self) -> DataFrame:
        return self.of("identifier", "file", "line", "name")

    @property
    def lines(self) -> DataFrame:
        """Lines with comments and the inside of strings blanked."""
        return self.of("line", "file", "line", F.col("text").alias("code"))

    @property
    def imports(self) -> DataFrame:
        return self.of("import", "file", F.col("name").alias("alias"), F.col("path").alias("module"), F.col("text").alias("name"))

    @property
    def accesses(self) -> DataFrame:
        return self.of("access", "file", "function", "fn_line", "line", F.col("name").alias("base"), "path", F.col("kind").alias("access"))

    @property
    def aliases(self) -> DataFrame:
        return self.of("alias", "file", "function", "fn_line", "line", F.col("name").alias("alias"), F.col("path").alias("target"))

    @property
    def tests(self) -> DataFrame:
        return self.of("test", "file", "function", "line", "name")

    @property
    def returns(self) -> DataFrame:
        return self.of("return", "file", "function", "fn_line", "line", F.col("text").alias("value"), (F.col("kind") == "conditional").alias("conditional"))

    @property
    def statements(self) -> DataFrame:
        """One statement a line of a function: the first that begins there."""
        rows = self.facts.where("relation = 'statement' and function is not null")
        # a greater end comes first: the outer one of two that begin together
        first = F.min_by(F.struct("kind", "text", "end_line"), -F.col("end_line"))
        return rows.groupBy("file", "function", "fn_line", "line").agg(first.alias("s")).select("file", "function", "fn_line", "line", "s.kind", "s.end_line", "s.text")

    @property
    def blocks(self) -> DataFrame:
        """The blocks of statements: owner's line, kind and end; role and number; first and last line; the last statement's line and kind."""
        n = lambda k: F.element_at("items", k).cast("int")
        return self.of("block", "file", "function", "fn_line", F.col("path").cast("int").alias("owner"), F.col("kind").alias("owner_kind"), n(1).alias("owner_end"), F.col("name").alias("role"), F.col("n").alias("number"), F.col("line").alias("first"), "end_line", n(2).alias("last"), F.col("text").alias("last_kind"))

    @property
    def scopes(self) -> DataFrame:
        return self.of("scope", "file", "function", F.col("line").alias("start_line"), "end_line", "name")

    @property
    def calls(self) -> DataFrame:
        return self.of("call", "file", "function", "fn_line", "line", F.col("name").alias("callee"), F.col("path").alias("qualifier"), F.col("items").alias("args"))

    @property
    def types(self) -> DataFrame:
        return self.of("type", "file", F.col("name"), "kind", F.col("items").alias("bases"), F.col("line").alias("start_line"), "end_line")

    @property
    def fields(self) -> DataFrame:
        return self.of("field", "file", F.col("name").alias("type"), F.col("path").alias("field"))

    @property
    def made(self) -> DataFrame:
        return self.of("made", "file", "name")

    @property
    def errors(self) -> DataFrame:
        """The first twenty error lines of each file."""
        rows = self.of("error", "file", "line")
        return rows.groupBy("file").agg(F.slice(F.array_sort(F.collect_set("line")), 1, 20).alias("lines")).select("file", F.explode("lines").alias("line"))

    @property
    def labels(self) -> DataFrame:
        """(file, function, fn_line, line, name, end_line, cleanup): a label's section runs to the line before the next one or
        the function's end; it is a cleanup label where what stands before it does not run into it."""
        w = Window.partitionBy("file", "function", "fn_line").orderBy("line")
        rows = self.statements.withColumn("before", F.lag("kind").over(w)).where("kind = 'label'")
        ends = self.functions.select("file", F.col("name").alias("function"), F.col("start_line").alias("fn_line"), F.col("end_line").alias("fn_end"))
        rows = rows.join(ends, ["file", "function", "fn_line"])
        return rows.select("file", "function", "fn_line", "line", F.col("text").alias("name"), F.coalesce(F.lead("line").over(w) - 1, "fn_end").alias("end_line"), F.col("before").isin("return", "goto", "break", "continue").alias("cleanup"))
