"""Diff readers: unified diff text or JSON to (file, modify_type, line), file filters and language detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# File extensions by language.
LANGUAGES = {
    "python": ("py",), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts",), "tsx": ("tsx",), "go": ("go",), "java": ("java",),
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hxx", "hh"), "rust": ("rs",), "lua": ("lua",), "terraform": ("tf", "hcl"), "bash": ("sh", "bash"),
}


def unified(diffs: DataFrame, text: str = "text", key: str = "diff_id") -> DataFrame:
    """(key, file, modify_type, line) of the added lines of unified diffs, new side.

    A `+++` line opens a file, a hunk header sets the counter, removed lines do not advance it. An added line counts
    while its number is at most the hunk's start plus its length (inclusive). A bad header voids its hunk.
    """
    rows = diffs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    order = Window.partitionBy(key).orderBy("pos")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    opens, header = F.col("raw").startswith("+++ "), F.col("raw").startswith("@@")
    name = F.regexp_replace(F.regexp_replace(F.expr("trim(substring(raw, 5))"), r"\t.*$", ""), "^b/", "")
    rows = rows.withColumn("file", F.last(F.when(opens, name), ignorenulls=True).over(back))
    rows = rows.withColumn("hunk", F.sum(F.when(opens | header, 1).otherwise(0)).over(back))
    start = F.regexp_extract("raw", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1)
    length = F.regexp_extract("raw", r"^@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+,([0-9]+)", 1)
    inside = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.max(F.when(header & (start != ""), start.cast("int"))).over(inside))
    rows = rows.withColumn("size", F.max(F.when(header, F.when(length != "", length.cast("int")).otherwise(1))).over(inside))
    moves = F.when(header | opens | F.col("raw").startswith("-"), 0).otherwise(1)
    rows = rows.withColumn("line", F.col("start") + F.sum(moves).over(inside) - 1)
    added = F.col("raw").startswith("+") & ~opens & F.col("start").isNotNull() & (F.col("line") <= F.col("start") + F.col("size"))
    return rows.where(added & F.col("file").isNotNull()).select(key, "file", F.lit("Modified").alias("modify_type"), F.col("line").cast("int").alias("line"))


def from_json(diffs: DataFrame, text: str = "text", key: str = "diff_id") -> DataFrame:
    """(key, file, modify_type, line) of JSON diffs: files with file_path, modify_type and diff_lines."""
    schema = "files array<struct<file_path: string, modify_type: string, diff_lines: array<int>>>"
    files = diffs.select(key, F.explode(F.from_json(text, schema)["files"]).alias("f"))
    return files.select(key, F.col("f.file_path").alias("file"), F.col("f.modify_type").alias("modify_type"), F.explode("f.diff_lines").alias("line")).distinct()


def read_diffs(diffs: DataFrame, text: str = "text", key: str = "diff_id") -> DataFrame:
    """Either kind: JSON where the trimmed text starts with a brace."""
    json = F.trim(F.col(text)).startswith("{")
    return unified(diffs.where(~json), text, key).unionByName(from_json(diffs.where(json), text, key))


def only_files(diff_lines: DataFrame, files: list[str] | None) -> DataFrame:
    return diff_lines if files is None else diff_lines.where(F.col("file").isin(files))


def language(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    extension = F.when(path.contains("."), F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for name, extensions in LANGUAGES.items():
        out = F.when(extension.isin(*extensions), name).otherwise(out)
    return out
