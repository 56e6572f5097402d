"""Output formats of slice lines: text blocks with gap marks, and the compact JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import callers


def text_blocks(slice_lines: DataFrame, source_lines: DataFrame) -> DataFrame:
    """(file, block): the numbered lines of each file, `+` before diff lines, dots where lines are left out."""
    rows = slice_lines.groupBy("file", "line").agg(F.max("is_diff").alias("is_diff")).join(source_lines, ["file", "line"], "left")
    gap = F.col("line") - F.lag("line").over(Window.partitionBy("file").orderBy("line")) > 1
    line = F.concat(F.when(F.col("is_diff"), "+").otherwise(" "), F.lpad(F.col("line").cast("string"), 4, " "), F.lit("|"), F.coalesce("text", F.lit("")))
    rows = rows.select("file", "line", F.concat(F.when(gap, F.lit("  ...|...\n")).otherwise(""), line).alias("out"))
    lines = F.array_sort(F.collect_list(F.struct("line", "out")))
    return rows.groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["out"]), "\n").alias("block"))


def paper_json(slice_lines: DataFrame) -> DataFrame:
    """(file, json): {"file", "diff_lines", "diff_list": {line: 0 or 1}} of each file."""
    rows = slice_lines.groupBy("file", "line").agg(F.max("is_diff").alias("is_diff"))
    entries = F.array_sort(F.collect_list(F.struct("line", F.col("is_diff").cast("int").alias("d"))))
    agg = rows.groupBy("file").agg(entries.alias("e"))
    body = F.struct("file", F.transform(F.filter("e", lambda x: x["d"] == 1), lambda x: x["line"]).alias("diff_lines"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["line"].cast("string"), x["d"]))).alias("diff_list"))
    return agg.select("file", F.to_json(body).alias("json"))


def blocks_text(slice_lines: DataFrame, source_lines: DataFrame, code: str) -> DataFrame:
    """(block_id, text) of slice lines (block_id, block_file, file, line, is_diff): a head line with the block's number, the
    algorithm's code and its file; the lines of each file under its name where the block has several. Files without a source
    are left out, lines beyond the end are empty."""
    rows = slice_lines.groupBy("block_id", "block_file", "file", "line").agg(F.max("is_diff").alias("is_diff"))
    known = source_lines.select("file").distinct()
    rows = rows.join(known, "file", "left_semi").join(source_lines, ["file", "line"], "left")
    w = Window.partitionBy("block_id", "file").orderBy("line")
    gap = F.col("line") - F.lag("line").over(w) > 1
    line = F.concat(F.when(F.col("is_diff"), "+").otherwise(" "), F.lpad(F.col("line").cast("string"), 4, " "), F.lit("|"), F.coalesce("text", F.lit("")))
    rows = rows.select("block_id", "block_file", "file", "line", F.concat(F.when(gap, F.lit("  ...|...\n")).otherwise(""), line).alias("out"))
    files = rows.groupBy("block_id", "block_file", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "out"))), lambda x: x["out"]), "\n").alias("body"))
    whole = files.groupBy("block_id", "block_file").agg(F.array_sort(F.collect_list(F.struct("file", "body"))).alias("parts"))
    named = F.transform("parts", lambda p: F.when(F.size("parts") > 1, F.concat(F.lit("--- "), p["file"], F.lit("\n"), p["body"])).otherwise(p["body"]))
    head = F.concat(F.lit("# Block "), F.col("block_id").cast("string"), F.lit(f" [{code}] "), F.col("block_file"))
    return whole.select("block_id", F.concat(head, F.lit("\n"), F.array_join(named, "\n")).alias("text"))


def review_json(slice_lines: DataFrame, source_lines: DataFrame, findings: DataFrame, code: str) -> DataFrame:
    """(block_id, json) of blocks: number, file, text, lines by file, other files, and the findings in the block's own file.

    findings: (file, line, category, severity). The lists of names that a block could have are always empty.
    """
    text = blocks_text(slice_lines, source_lines, code)
    lines = slice_lines.groupBy("block_id", "block_file", "file").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    per = lines.groupBy("block_id", "block_file").agg(F.array_sort(F.collect_list(F.struct("file", "lines"))).alias("slice_lines"), F.array_sort(F.collect_set(F.when(F.col("file") != F.col("block_file"), F.col("file")))).alias("cross_file_refs"))
    told = findings.groupBy(F.col("file").alias("block_file")).agg(F.array_sort(F.collect_list(F.struct("line", "category", "severity"))).alias("findings"))
    none = F.array().cast("array<string>")
    rows = per.join(told, "block_file", "left").join(text, "block_id", "left")
    body = F.struct("block_id", F.col("block_file").alias("file"), "text", "slice_lines", "cross_file_refs", F.coalesce("findings", F.array().cast(told.schema["findings"].dataType)).alias("findings"), none.alias("callees"), none.alias("lvalues"), none.alias("rvalues"))
    return rows.select("block_id", F.to_json(body).alias("json"))


def multi_json(results: dict[str, DataFrame], findings: DataFrame) -> DataFrame:
    """One row (json): version, the algorithms run, their blocks (algorithm, block_id, json), all findings."""
    spark = findings.sparkSession
    out = None
    for name, df in results.items():
        part = df.select(F.lit(name).alias("algorithm"), "block_id", "json")
        out = part if out is None else out.unionByName(part)
    rows = out.agg(F.array_sort(F.collect_list(F.struct("algorithm", "block_id", "json"))).alias("results"))
    told = findings.agg(F.array_sort(F.collect_list(F.struct("file", "line", "category", "severity"))).alias("all_findings"))
    ran = spark.createDataFrame([("1.0", sorted(results))], "version string, algorithms_run array<string>")
    return ran.crossJoin(rows).crossJoin(told).select(F.to_json(F.struct("version", "algorithms_run", "results", "all_findings")).alias("json"))


def callers_report(touched: DataFrame, found: DataFrame, lines: DataFrame, depth: int = 5) -> DataFrame:
    """(file, name, caller_file, caller, depth, trust, kind): the callers of touched functions (file, name), by name, up to depth
    calls away, and signal handlers that a g_signal_connect call registers (depth 1, untrusted).

    found: resolved calls (file, function, callee, callee_file); lines: (file, line, code).
    """
    node = lambda f, n: F.struct(F.col(f).alias("file"), F.col(n).alias("name"))
    edges = found.select(node("file", "function").alias("src"), node("callee_file", "callee").alias("dst")).distinct()
    up = callers(edges, touched.select(node("file", "name").alias("node")).distinct(), depth)
    plain = up.select("target.file", "target.name", F.col("node.file").alias("caller_file"), F.col("node.name").alias("caller"), "depth", F.lit(None).cast("string").alias("trust"), F.lit(None).cast("string").alias("kind"))
    hook = lines.select(F.col("file").alias("caller_file"), F.regexp_extract("code", r"g_signal_connect\w*\s*\([^,]*,[^,]*,\s*(?:G_CALLBACK\s*\(\s*)?([A-Za-z_]\w*)", 1).alias("name")).where("name <> ''")
    signal = touched.join(hook, "name").select("file", "name", "caller_file", F.lit("g_signal_connect").alias("caller"), F.lit(1).cast("long").alias("depth"), F.lit("untrusted_ipc").alias("trust"), F.lit("dbus_callback").alias("kind"))
    return plain.unionByName(signal).distinct()
