"""Mixing sources to target weights with hash-threshold histograms.

A document's hash has four digits of 12 bits. For each source the words are summed by the hash's first digit; the
budget that is left after whole rounds of the source falls into one digit, and only that digit's documents are summed
again by the next digit. After four digits the threshold is one hash value, and the mix is a filter on the hash:
thresholds for smaller budgets are below those for larger ones, nothing is sorted, and reruns agree.

Null texts have size 0, a null source is a source of its own (last in order), rows with equal doc_id share a hash and
are taken alike. The rows at the threshold itself are taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, read

# Weights of the sources in order, repeating; how often a document may be taken.
WEIGHTS, REPEATS = (5, 2, 1), 3
DIGITS, BITS = 4, 12
#: Sources up to which their thresholds are broadcast; beyond, they are joined by a shuffle.
FEW_SOURCES = 100_000


def digits() -> list[Column]:
    """The hash digits of a row's doc_id."""
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return [F.conv(F.substring(md5, 1 + 3 * k, 3), 16, 10).cast("int") for k in range(DIGITS)]


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash digits d1..d4), written once: the passes that follow read these narrow rows."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return cut(documents.select("doc_id", F.col("source").cast("string").alias("source"), size, *(d.alias(f"d{k}") for k, d in enumerate(digits(), 1))))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with weight, target, whole rounds, and the rest of the budget.

    target = min(3 * size, level * weight): sources are capped in order of 3 * size / weight, and the level is set by
    those that are left, which is where resharing the excess again and again ends. One row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    rows = sources.withColumn("weight", weight.cast("long")).withColumn("cap", REPEATS * F.col("source_size"))
    # capped first: the lowest cap for its weight; ties by place
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, from_here, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    # with every source at its cap there is no level; the total is a third of the caps, so at least one is below
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(REPEATS))).otherwise(0)
    return rows.withColumn("rounds", rounds.cast("long")).select("source", "source_size", "target", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("rest"))


def thresholds(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of sized(), and one row a source: source, source_size, target, whole rounds, and the digits b1..b4
    of the hash at which the next round ends, with_edge telling whether the rows at it belong to the round.

    The sources are broadcast up to FEW_SOURCES of them, and joined by a shuffle beyond.
    """
    docs = sized(documents)
    narrow = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = narrow.count() <= FEW_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    plan = cut(targets(narrow))
    for k in range(1, DIGITS + 1):
        on = [docs.source.eqNullSafe(F.col("p.source")), *(docs[f"d{j}"] == F.col(f"p.b{j}") for j in range(1, k))]
        inside = docs.join(hint(plan.select("source", *(f"b{j}" for j in range(1, k))).alias("p")), on, "left_semi")
        sums = inside.groupBy("source", f"d{k}").agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source").orderBy(f"d{k}").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        # the digit in which the budget ends: the last one that starts within it
        r = plan.alias("p").join(sums.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("s.before") <= F.col("p.rest")), "left")
        edge = F.max(F.struct(f"s.d{k}", "s.before", "s.n"))
        r = r.groupBy(*(F.col(f"p.{c}") for c in plan.columns)).agg(edge.alias("e"))
        rest = F.col("rest") - F.coalesce(F.col("e.before"), F.lit(0))
        keep = [c for c in plan.columns if c != "rest"]
        plan = r.select(*keep, rest.alias("rest"), F.coalesce(F.col(f"e.d{k}"), F.lit(-1)).alias(f"b{k}"), *([F.coalesce(F.col("e.n"), F.lit(0)).alias("n")] if k == DIGITS else []))
        plan = cut(plan)
    # the rows at the threshold: all of them where that ends nearer to the target
    plan = plan.withColumn("with_edge", 2 * F.col("rest") >= F.col("n"))
    return docs, hint(plan)


def times(digit: list[Column]) -> Column:
    """How often a row with these digits is taken, from its source's row of thresholds()."""
    below, equal = F.lit(False), F.lit(True)
    for k, d in enumerate(digit, 1):
        below = below | (equal & (d < F.col(f"b{k}")))
        equal = equal & (d == F.col(f"b{k}"))
    return F.least(F.col("rounds") + F.when(below | (equal & F.col("with_edge")), 1).otherwise(0), F.lit(REPEATS))


def mix(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, and taken (size times how often it is taken)."""
    docs, plan = thresholds(documents)
    joined = docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    often = times([F.col(f"d{k}") for k in range(1, DIGITS + 1)])
    return joined.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", (F.col("size") * often).alias("taken"), often.alias("times"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


def apply_mix(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, each as often as mix() says; the columns stay as they are.

    Whether a row is taken follows from its source and doc_id, so rows are filtered where they are: no text is shuffled.
    Rows that repeat a doc_id are taken each by its own source; null ids, sources and texts as in mix(). An empty table
    stays empty. The names of further columns don't matter.
    """
    _, plan = thresholds(documents)
    keep = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    docs = documents.select(keep, F.col("source").cast("string").alias("own"), *(d.alias(f"d{k}") for k, d in enumerate(digits(), 1)))
    taken = docs.join(plan, F.col("own").eqNullSafe(F.col("source")))
    often = times([F.col(f"d{k}") for k in range(1, DIGITS + 1)]).cast("int")
    return taken.where(often > 0).select("row", F.explode(F.sequence(F.lit(1), often))).select("row.*")


def oracle() -> str:
    """The same mix by sorting the hashes, in DuckDB SQL."""
    return f"""
    WITH docs AS (SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size FROM documents),
    keyed AS (SELECT doc_id, source, size, substr(h, 1, {3 * DIGITS}) AS k FROM docs),
    src AS (SELECT source, sum(size)::bigint AS source_size FROM keyed GROUP BY source),
    w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, {REPEATS} * source_size AS cap FROM src),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
    m AS (SELECT arg_min(lv, cap / weight) FILTER (WHERE lv * weight <= cap) AS level FROM l),
    t AS (SELECT source, source_size, weight, least(cap::double, coalesce(level * weight, cap::double)) AS target FROM l, m),
    r AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {REPEATS})::bigint ELSE 0 END AS rounds FROM t),
    b AS (SELECT source, k, sum(size) AS n FROM keyed GROUP BY source, k),
    c AS (SELECT source, k, n, sum(n) OVER (PARTITION BY source ORDER BY k) - n AS before FROM b),
    e AS (SELECT r.source, max(k) AS edge, arg_max(n, k) AS n, arg_max(before, k) AS before FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND before <= target - rounds * source_size GROUP BY r.source)
    SELECT doc_id, size, source_size, target, (size * least(rounds + CASE WHEN k < edge OR k = edge AND 2 * (target - rounds * source_size - before) >= n THEN 1 ELSE 0 END, {REPEATS}))::bigint AS taken
    FROM keyed JOIN r ON keyed.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON keyed.source IS NOT DISTINCT FROM e.source
    """
