"""Queries over version history: churn, co-change, risk, deleted symbols. commit_files: (commit_id, file, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(commit_files: DataFrame, days: int) -> DataFrame:
    """The rows of the last days before the newest commit."""
    newest = commit_files.agg(F.max("ts").alias("newest"))
    return commit_files.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.make_dt_interval(F.lit(days))).drop("newest")


def churn(commit_files: DataFrame, days: int = 90) -> DataFrame:
    """(file, commits): how many commits of the window touch each file."""
    return recent(commit_files, days).select("commit_id", "file").distinct().groupBy("file").agg(F.count("*").alias("commits"))


def co_change(commit_files: DataFrame, most_files: int = 50, least: int = 3, share: float = 0.3) -> DataFrame:
    """(file, partner, together, commits): files that change together at least least times and in share of a file's
    commits. Commits of over most_files files are left out, which bounds the pairs of a commit."""
    rows = commit_files.select("commit_id", "file").distinct()
    small = rows.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= most_files).select("commit_id")
    rows = rows.join(small, "commit_id", "left_semi")
    total = rows.groupBy("file").agg(F.count("*").alias("commits"))
    pairs = rows.join(rows.withColumnRenamed("file", "partner"), "commit_id").where("file <> partner")
    pairs = pairs.groupBy("file", "partner").agg(F.count("*").alias("together"))
    return pairs.join(total, "file").where((F.col("together") >= least) & (F.col("together") / F.col("commits") >= share))


def resonance(commit_files: DataFrame, changed: DataFrame, **limits) -> DataFrame:
    """(file, partner, together, commits): usual partners of changed files that have not changed. changed: (file)."""
    found = co_change(commit_files, **limits).join(changed, "file", "left_semi")
    return found.join(changed.withColumnRenamed("file", "partner"), "partner", "left_anti").select("file", "partner", "together", "commits")


def risk(functions: DataFrame, degree: DataFrame, churned: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """(node, risk): max(1, callers + callees) * max(1, churn) * max(1, changed lines).

    functions: (node, file); degree: (node, degree); churned: (file, commits); changed_lines: (node, lines).
    """
    rows = functions.join(degree, "node", "left").join(churned, "file", "left").join(changed_lines, "node", "left")
    one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(0)))
    return rows.select("node", (one("degree") * one("commits") * one("lines")).cast("long").alias("risk"))


def phantom(identifiers: DataFrame, diff_lines: DataFrame, deleted: DataFrame, shortest: int = 3) -> DataFrame:
    """(name, file, line): diff lines that still mention a deleted symbol. deleted: (name)."""
    hits = identifiers.join(diff_lines, ["file", "line"], "left_semi").where(F.length("name") >= shortest)
    return hits.join(deleted.select("name").distinct(), "name", "left_semi").select("name", "file", "line")
