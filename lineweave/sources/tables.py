"""The canonical relations drawn from ordinary tables, so that every operator runs on them as on extracted code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text): the lines of every document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line): every seventh line, at another offset in each file."""
    return source_lines(spark, sf_dir).where("line % 7 = file % 7").select("file", "line")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, name, start_line, end_line): stretches of ten lines, and an inner one of four in each that has room."""
    last = source_lines(spark, sf_dir).groupBy("file").agg(F.max("line").alias("last"))
    outer = last.select("file", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / 10))).alias("k"))
    outer = outer.select("file", F.format_string("f%d_%d", "file", "k").alias("name"), (10 * F.col("k") + 1).alias("start_line"), F.least(10 * F.col("k") + 10, "last").alias("end_line"), "k")
    inner = outer.where("end_line - start_line >= 6").select("file", F.format_string("g%d_%d", "file", "k").alias("name"), (F.col("start_line") + 2).alias("start_line"), (F.col("start_line") + 5).alias("end_line"))
    return outer.drop("k").unionByName(inner)


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, name): the distinct ASCII words of each line, lower-cased."""
    words = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1))
    return source_lines(spark, sf_dir).select("file", "line", words.alias("name")).select("file", "line", F.lower("name").alias("name")).distinct()


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, name): the first word of each line stands for the variable that the line defines."""
    first = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    return source_lines(spark, sf_dir).select("file", "line", first.alias("name")).where("name <> ''")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts that follow each other in one order call each other; no self-calls."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def changed_functions(spark: SparkSession, sf_dir: str, size: int = 1) -> DataFrame:
    """(node): the large parts of a size stand for the functions that a diff touches."""
    return read(spark, sf_dir, "part").where((F.col("p_type") == "LARGE") & (F.col("p_size") == size)).select(F.col("p_partkey").alias("node"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, file, ts): fifty events are a commit, users are files."""
    return read(spark, sf_dir, "events").select(F.expr("event_id div 50").alias("commit_id"), F.col("user_id").alias("file"), "ts")


#: The same relations as DuckDB SQL, for the oracles.
SQL = {
    "source_lines": "SELECT doc_id AS file, u.i::bigint AS line, u.t AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) d, LATERAL (SELECT unnest(a) AS t, unnest(range(1, len(a) + 1)) AS i) u",
    "diff_lines": "SELECT file, line FROM source_lines WHERE line % 7 = file % 7",
    "outer_functions": "SELECT file, k, 'f' || file || '_' || k AS name, 10 * k + 1 AS start_line, least(10 * k + 10, last) AS end_line FROM (SELECT file, last, unnest(range(0, (last - 1) // 10 + 1)) AS k FROM (SELECT file, max(line) AS last FROM source_lines GROUP BY file))",
    "functions": "SELECT file, name, start_line, end_line FROM outer_functions UNION ALL SELECT file, 'g' || file || '_' || k, start_line + 2, start_line + 5 FROM outer_functions WHERE end_line - start_line >= 6",
    "identifiers": "SELECT DISTINCT file, line, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS name FROM source_lines",
    "definitions": "SELECT file, line, lower(regexp_extract(text, '[A-Za-z]+')) AS name FROM source_lines WHERE regexp_extract(text, '[A-Za-z]+') <> ''",
    "call_edges": "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst",
    "changed": "SELECT p_partkey AS node FROM part WHERE p_type = 'LARGE' AND p_size = 1",
    "commit_files": "SELECT event_id // 50 AS commit_id, user_id AS file, ts FROM events",
}


def with_relations(sql: str, *names: str, recursive: bool = False) -> str:
    """sql after the relations it names and those they are made of, in their order above."""
    needs = {"diff_lines": ("source_lines",), "outer_functions": ("source_lines",), "functions": ("source_lines", "outer_functions"), "identifiers": ("source_lines",), "definitions": ("source_lines",)}
    wanted = {n for name in names for n in (name, *needs.get(name, ()))}
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{', ' if sql.lstrip().startswith('--+') else ' '}{sql.replace('--+', '', 1)}"
