"""The registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import code_queries, flow_queries
from .functions import tables
from .operators import graph, history, patterns, render, slices
from .sources import diffs
from .sources import tables as t
from .sources.tables import with_relations

INNER = "SELECT l.file, l.line, arg_min(f.name, (f.end_line - f.start_line) * 1000000 - f.start_line) AS name, arg_min(f.start_line, (f.end_line - f.start_line) * 1000000 - f.start_line) AS start_line, arg_min(f.end_line, (f.end_line - f.start_line) * 1000000 - f.start_line) AS end_line FROM {lines} l JOIN functions f ON l.file = f.file AND l.line BETWEEN f.start_line AND f.end_line GROUP BY l.file, l.line"


def flag(df):
    return df.withColumn("is_diff", F.col("is_diff").cast("int"))


def original_diff(spark, d):
    return flag(slices.original_diff(t.diff_lines(spark, d)))


def enclosing_function(spark, d):
    return slices.enclosing_functions(t.diff_lines(spark, d), t.functions(spark, d))


def function_at(spark, d):
    return slices.function_at(t.diff_lines(spark, d), t.functions(spark, d))


def parent_function(spark, d):
    return flag(slices.parent_function(t.diff_lines(spark, d), t.functions(spark, d)))


def thin_slice(spark, d):
    return flag(slices.thin_slice(t.diff_lines(spark, d), t.definitions(spark, d), t.identifiers(spark, d), t.functions(spark, d)))


def flow_edges(spark, d):
    return slices.flow_edges(t.definitions(spark, d), t.identifiers(spark, d), t.functions(spark, d))


def sequential_flow(spark, d):
    lines = slices.enclosing_functions(t.source_lines(spark, d).select("file", "line", "text"), t.functions(spark, d))
    return slices.sequential_flow(lines.select("file", F.col("name").alias("function"), "line", F.col("text").endswith("the.").alias("terminates")))


def delta_slice(spark, d):
    new = t.definitions(spark, d)
    return slices.delta(new.where("(file * 31 + line) % 11 <> 0"), new.where("(file * 17 + line) % 13 <> 0"))


def spiral_slice(spark, d):
    """Rings over the corpus of lines: the diff, its functions, what their definitions flow to, the neighbours' functions."""
    diff, functions = t.diff_lines(spark, d), t.functions(spark, d)
    body = slices.parent_function(diff, functions)
    every = slices.enclosing_functions(t.source_lines(spark, d).select("file", "line"), functions, every=True)
    return slices.spiral([diff, body, every.select("file", "line"), t.source_lines(spark, d)], stop=0.05)


def nearest_source(spark, d):
    lines = t.source_lines(spark, d)
    return slices.nearest_source(lines.where("line % 5 = 0").select("file", "line"), lines.where("line % 7 = 3").select("file", "line"))


def membrane_slice(spark, d):
    lines = t.source_lines(spark, d)
    calls = lines.where("line % 4 = 1").select("file", "line", (F.col("file") + 1).alias("callee_file"), F.concat(F.lit("f"), F.col("file") + 1, F.lit("_0")).alias("callee"))
    return slices.membrane(t.diff_lines(spark, d), t.functions(spark, d), calls, lines)


def origins(spark, d):
    """The changed functions, each a start of its own."""
    return t.changed_functions(spark, d).select(F.col("node").alias("origin"), "node")


def call_reach(spark, d):
    return graph.reachable(t.call_edges(spark, d), origins(spark, d))


def call_path(spark, d):
    """Pairs of a changed function and a large part of size 2 with a path from the one to the other."""
    return graph.paths_between(t.call_edges(spark, d), t.changed_functions(spark, d), t.changed_functions(spark, d, 2))


def call_distance(spark, d):
    return graph.distances(t.call_edges(spark, d), origins(spark, d), 3)


def call_chop(spark, d):
    return graph.chop(t.call_edges(spark, d), t.changed_functions(spark, d), t.changed_functions(spark, d, 2))


def callers(spark, d):
    return graph.callers(t.call_edges(spark, d), t.changed_functions(spark, d), 2)


def circular_slice(spark, d):
    return graph.strong_components(t.call_edges(spark, d))


def gradient_slice(spark, d):
    found = graph.gradient(t.call_edges(spark, d), t.changed_functions(spark, d))
    return found.select("node", "hop", F.round(F.col("score") * 1_000_000).cast("long").alias("score"))


def barrier_slice(spark, d):
    """Callers and callees up to two hops, without the barred nodes (rows are filtered, walks are not)."""
    edges, targets = t.call_edges(spark, d), t.changed_functions(spark, d)
    return graph.callers(edges, targets, 2).unionByName(graph.callees(edges, targets, 2)).where("node % 9 <> 4").select("target", "node").distinct()


def churn(spark, d):
    return history.churn(t.commit_files(spark, d), 7)


def co_change(spark, d):
    return history.co_change(t.commit_files(spark, d)).select("file", "partner", "together", "commits")


def resonance_slice(spark, d):
    files = t.commit_files(spark, d)
    return history.resonance(files, files.where("file % 3 = 0").select("file").distinct())


def threed_slice(spark, d):
    """Parts are functions, each in the file of the user with its number, changed by the diff lines of the document with it."""
    edges = t.call_edges(spark, d)
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    lines = t.diff_lines(spark, d).groupBy(F.col("file").alias("node")).agg(F.count("*").alias("lines"))
    return history.risk(degree.select("node", F.col("node").alias("file")), degree, history.churn(t.commit_files(spark, d), 7), lines)


def phantom_slice(spark, d):
    words = t.read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"), 1)).alias("name"))
    deleted = words.select(F.lower("name").alias("name"))
    return history.phantom(t.identifiers(spark, d), t.diff_lines(spark, d), deleted)


def angle_slice(spark, d):
    return patterns.angle(t.source_lines(spark, d), t.functions(spark, d), tables.CONCERNS["authentication"])


def named_lines(spark, d):
    """(file, name, line): every line stands for a function named by a mirror word and the line's number."""
    words = F.array(*(F.lit(w) for side in tables.MIRRORS for half in side for w in half))
    name = F.concat(F.element_at(words, ((F.col("file") * 7 + F.col("line")) % F.size(words) + 1).cast("int")), F.lit("_"), F.col("line"))
    return t.source_lines(spark, d).select("file", name.alias("name"), "line")


def symmetry_slice(spark, d):
    names = named_lines(spark, d)
    changed = names.join(t.diff_lines(spark, d), ["file", "line"], "left_semi").select("file", "name")
    return patterns.counterparts(names.select("file", "name"), changed)


def peer_consistency(spark, d):
    facts = t.source_lines(spark, d).select("file", (F.col("line") % 5).alias("peer"), F.col("text").contains("tion").alias("guarded"), F.col("text").contains("the").alias("dereferenced"))
    return patterns.peer_consistency(facts)


def text_blocks(spark, d):
    return render.text_blocks(slices.original_diff(t.diff_lines(spark, d)), t.source_lines(spark, d))


def diff_reader(spark, d):
    """Unified diffs made of the documents (their lines in turn kept, added, removed), read back."""
    lines = t.source_lines(spark, d).withColumn("raw", F.concat(F.when(F.col("line") % 3 == 1, " ").when(F.col("line") % 3 == 2, "+").otherwise("-"), F.col("line").cast("string")))
    body = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("b"), F.count("*").alias("n"))
    text = F.concat(F.lit("--- a/x\n+++ b/src/"), F.col("file"), F.lit(".py\n@@ -5,"), F.col("n"), F.lit(" +"), F.col("file") % 9 + 5, F.lit(","), F.col("n"), F.lit(" @@\n"), F.array_join(F.transform("b", lambda x: x["raw"]), "\n"))
    return diffs.read_diffs(body.select(F.col("file").alias("diff_id"), text.alias("text"))).withColumn("line", F.col("line").cast("long")).withColumn("language", diffs.language(F.col("file")))


def reachable_sql(select: str) -> str:
    return with_relations(f"--+r AS (SELECT DISTINCT node AS origin, node FROM changed UNION SELECT origin, dst FROM r JOIN call_edges ON node = src) {select}", "call_edges", "changed", recursive=True)


def walk_sql(select: str, hops: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return with_relations(f"--+w AS (SELECT DISTINCT node AS origin, node, 0::bigint AS hop FROM changed UNION SELECT origin, {b}, hop + 1 FROM w JOIN call_edges ON node = {a} WHERE hop < {hops}), m AS (SELECT origin, node, min(hop) AS hop FROM w GROUP BY ALL) {select}", "call_edges", "changed", recursive=True)


def mirror_sql() -> str:
    """Names and their counterparts: a row a word with its place in the order, and the words of the other side."""
    rows, k = [], 0
    for left, right in tables.MIRRORS:
        for words, others in ((left, right), (right, left)):
            for w in words:
                rows.append(f"({k}, '{w}', [" + ", ".join(f"'{o.lower()}'" for o in others) + "])")
                k += 1
    words = ", ".join(f"'{w}'" for side in tables.MIRRORS for half in side for w in half)
    return (
        f"--+v AS (SELECT * FROM (VALUES {', '.join(rows)}) v(k, word, others)), n AS (SELECT file, line, ([{words}])[(file * 7 + line) % {k} + 1] || '_' || line AS name FROM source_lines), "
        "c AS (SELECT n.* FROM n JOIN diff_lines USING (file, line)), x AS (SELECT DISTINCT name FROM c), "
        "b AS (SELECT name, arg_min(lower(word), k) AS word, arg_min(others, k) AS others FROM x JOIN v ON contains(lower(name), lower(word)) GROUP BY name), "
        "o AS (SELECT name, replace(lower(name), word, unnest(others)) AS other FROM b), "
        "t AS (SELECT DISTINCT name AS counterpart FROM n WHERE (file, name) NOT IN (SELECT (file, name) FROM c)) "
        "SELECT DISTINCT c.file, c.name, t.counterpart FROM c JOIN o ON o.name = c.name JOIN t ON lower(t.counterpart) = o.other"
    )


def line_sql() -> dict[str, str]:
    r = with_relations
    inner = INNER.format
    has = lambda text, words: " OR ".join(f"contains({text}, '{w}')" for w in dict.fromkeys(words))
    guards = has("g.text", tables.GUARDED)
    return {
        "original_diff": r("SELECT DISTINCT file, line, 1 AS is_diff FROM diff_lines", "diff_lines"),
        "enclosing_function": r(inner(lines="diff_lines"), "diff_lines", "functions"),
        "function_at": r("SELECT l.file, l.line, min(f.name) AS name, arg_min(f.start_line, f.name) AS start_line, arg_min(f.end_line, f.name) AS end_line FROM diff_lines l JOIN functions f ON l.file = f.file AND l.line BETWEEN f.start_line AND f.end_line GROUP BY l.file, l.line", "diff_lines", "functions"),
        "parent_function": r(f"--+i AS ({inner(lines='diff_lines')}), b AS (SELECT file, name, unnest(range(start_line, end_line + 1)) AS line FROM (SELECT DISTINCT file, name, start_line, end_line FROM i) UNION ALL SELECT file, NULL, line FROM diff_lines WHERE (file, line) NOT IN (SELECT (file, line) FROM i)) SELECT file, line, name, (EXISTS (SELECT 1 FROM diff_lines d WHERE d.file = b.file AND d.line = b.line))::int AS is_diff FROM b", "diff_lines", "functions"),
        "thin_slice": r("--+dd AS (SELECT d.* FROM definitions d JOIN diff_lines USING (file, line)), " + f"i AS ({inner(lines='dd')}), s AS (SELECT DISTINCT dd.file, dd.name AS variable, start_line, end_line FROM dd JOIN i USING (file, line)), x AS (SELECT s.file, u.line FROM s JOIN identifiers u ON u.file = s.file AND u.name = s.variable AND u.line BETWEEN start_line AND end_line UNION SELECT file, line FROM diff_lines) SELECT x.file, x.line, (d.line IS NOT NULL)::int AS is_diff FROM x LEFT JOIN diff_lines d USING (file, line)", "diff_lines", "functions", "definitions", "identifiers"),
        "flow_edges": r(f"--+i AS ({inner(lines='definitions')}) SELECT DISTINCT i.file, d.name, d.line AS def_line, u.line AS use_line FROM definitions d JOIN i USING (file, line) JOIN identifiers u ON u.file = d.file AND u.name = d.name AND u.line BETWEEN start_line AND end_line AND u.line <> d.line", "functions", "definitions", "identifiers"),
        "sequential_flow": r(f"--+i AS ({inner(lines='source_lines')}), n AS (SELECT file, line, suffix(text, 'the.') AS stop, lead(line) OVER (PARTITION BY file, name ORDER BY line) AS to_line FROM i JOIN source_lines USING (file, line)) SELECT file, line AS from_line, to_line FROM n WHERE NOT stop AND to_line IS NOT NULL", "functions", "source_lines"),
        "delta_slice": r("--+o AS (SELECT DISTINCT * FROM definitions WHERE (file * 31 + line) % 11 <> 0), n AS (SELECT DISTINCT * FROM definitions WHERE (file * 17 + line) % 13 <> 0) SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)", "definitions"),
        "nearest_source": r("SELECT k.file, k.line, coalesce(max(s.line) FILTER (WHERE s.line < k.line), min(s.line)) AS source_line FROM source_lines k JOIN source_lines s ON s.file = k.file AND s.line % 7 = 3 WHERE k.line % 5 = 0 GROUP BY k.file, k.line", "source_lines"),
        "membrane_slice": r(f"--+i AS ({inner(lines='diff_lines')}) SELECT DISTINCT s.file, s.line, 'f' || (s.file + 1) || '_0' AS callee FROM source_lines s WHERE s.line % 4 = 1 AND EXISTS (SELECT 1 FROM i WHERE i.file = s.file + 1 AND i.name = 'f' || (s.file + 1) || '_0') AND NOT EXISTS (SELECT 1 FROM source_lines g WHERE g.file = s.file AND g.line BETWEEN s.line - 2 AND s.line + 2 AND ({guards}))", "diff_lines", "functions", "source_lines"),
        "call_reach": reachable_sql("SELECT origin, node FROM r WHERE origin <> node"),
        "call_path": with_relations("--+r AS (SELECT DISTINCT node AS origin, node FROM changed UNION SELECT origin, dst FROM r JOIN call_edges ON node = src) SELECT DISTINCT origin AS src, node AS dst FROM r WHERE node IN (SELECT p_partkey FROM part WHERE p_type = 'LARGE' AND p_size = 2)", "call_edges", "changed", recursive=True),
        "call_distance": walk_sql("SELECT * FROM m", 3),
        "call_chop": r("--+a AS (SELECT node FROM changed UNION SELECT dst FROM a JOIN call_edges ON node = src), b AS (SELECT p_partkey AS node FROM part WHERE p_type = 'LARGE' AND p_size = 2 UNION SELECT src FROM b JOIN call_edges ON node = dst) SELECT node FROM a INTERSECT SELECT node FROM b", "call_edges", "changed", recursive=True),
        "callers": walk_sql("SELECT origin AS target, node, hop AS depth FROM m WHERE hop > 0", 2, back=True),
        "circular_slice": r("--+a AS (SELECT min(src) AS node FROM call_edges UNION SELECT dst FROM a JOIN call_edges ON node = src), b AS (SELECT min(src) AS node FROM call_edges UNION SELECT src FROM b JOIN call_edges ON node = dst), k AS (SELECT node FROM a INTERSECT SELECT node FROM b) SELECT node, (SELECT min(node) FROM k) AS component FROM k WHERE (SELECT count(*) FROM k) > 1", "call_edges", recursive=True),
        "gradient_slice": walk_sql("SELECT node, min(hop) AS hop, round(pow(0.6, min(hop)) * 1000000)::bigint AS score FROM m GROUP BY node HAVING pow(0.6, min(hop)) >= 0.1", 5),
        "barrier_slice": r("--+f AS (SELECT node AS target, node, 0 AS hop FROM changed UNION SELECT target, src, hop + 1 FROM f JOIN call_edges ON node = dst WHERE hop < 2), g AS (SELECT node AS target, node, 0 AS hop FROM changed UNION SELECT target, dst, hop + 1 FROM g JOIN call_edges ON node = src WHERE hop < 2) SELECT DISTINCT target, node FROM (SELECT * FROM f UNION SELECT * FROM g) WHERE node <> target AND node % 9 <> 4", "call_edges", "changed", recursive=True),
        "churn": r("SELECT file, count(DISTINCT commit_id) AS commits FROM commit_files WHERE ts >= (SELECT max(ts) FROM commit_files) - INTERVAL 7 DAY GROUP BY file", "commit_files"),
        "co_change": r("--+c AS (SELECT DISTINCT commit_id, file FROM commit_files), k AS (SELECT * FROM c WHERE commit_id IN (SELECT commit_id FROM c GROUP BY 1 HAVING count(*) <= 50)), n AS (SELECT file, count(*) AS commits FROM k GROUP BY 1), p AS (SELECT a.file, b.file AS partner, count(*) AS together FROM k a JOIN k b ON a.commit_id = b.commit_id AND a.file <> b.file GROUP BY 1, 2) SELECT file, partner, together, commits FROM p JOIN n USING (file) WHERE together >= 3 AND together / commits >= 0.3", "commit_files"),
        "resonance_slice": r("--+c AS (SELECT DISTINCT commit_id, file FROM commit_files), k AS (SELECT * FROM c WHERE commit_id IN (SELECT commit_id FROM c GROUP BY 1 HAVING count(*) <= 50)), n AS (SELECT file, count(*) AS commits FROM k GROUP BY 1), p AS (SELECT a.file, b.file AS partner, count(*) AS together FROM k a JOIN k b ON a.commit_id = b.commit_id AND a.file <> b.file GROUP BY 1, 2) SELECT file, partner, together, commits FROM p JOIN n USING (file) WHERE together >= 3 AND together / commits >= 0.3 AND file % 3 = 0 AND partner % 3 <> 0", "commit_files"),
        "threed_slice": r("--+n AS (SELECT src AS node FROM call_edges UNION ALL SELECT dst FROM call_edges), g AS (SELECT node, count(*) AS degree FROM n GROUP BY 1), h AS (SELECT file, count(DISTINCT commit_id) AS commits FROM commit_files WHERE ts >= (SELECT max(ts) FROM commit_files) - INTERVAL 7 DAY GROUP BY file), l AS (SELECT file, count(*) AS lines FROM diff_lines GROUP BY 1) SELECT g.node, (greatest(1, degree) * greatest(1, coalesce(commits, 0)) * greatest(1, coalesce(lines, 0)))::bigint AS risk FROM g LEFT JOIN h ON h.file = g.node LEFT JOIN l ON l.file = g.node", "call_edges", "commit_files", "diff_lines"),
        "phantom_slice": r("--+x AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS name FROM benchmark) SELECT i.name, i.file, i.line FROM identifiers i JOIN diff_lines USING (file, line) WHERE i.name IN (SELECT name FROM x) AND length(i.name) >= 3", "identifiers", "diff_lines"),
        "angle_slice": r("--+h AS (SELECT file, line FROM source_lines WHERE regexp_matches(text, 'auth|token|session|permission|credential|login|logout|jwt|oauth|cookie|Bearer|authenticate|authorize')), " + f"i AS ({inner(lines='h')}) SELECT file, line FROM h UNION SELECT file, start_line FROM i UNION SELECT file, end_line FROM i", "source_lines", "functions"),
        "symmetry_slice": r(mirror_sql(), "source_lines", "diff_lines"),
        "peer_consistency": r("--+g AS (SELECT file, line % 5 AS peer, count(*) AS size, count(*) FILTER (WHERE contains(text, 'tion')) AS guards, count(*) FILTER (WHERE contains(text, 'the')) AS derefs FROM source_lines GROUP BY 1, 2), k AS (SELECT *, CASE WHEN guards = 0 AND derefs / size >= 0.8 THEN 'uniform' WHEN guards >= 3 AND derefs > guards THEN 'divergent' END AS kind FROM g WHERE size >= 3) SELECT * FROM k WHERE kind IS NOT NULL", "source_lines"),
        "spiral_slice": r(f"--+i AS ({inner(lines='diff_lines')}), b AS (SELECT file, unnest(range(start_line, end_line + 1)) AS line FROM (SELECT DISTINCT file, start_line, end_line FROM i) UNION SELECT file, line FROM diff_lines), e AS (SELECT DISTINCT s.file, s.line FROM source_lines s JOIN functions f ON f.file = s.file AND s.line BETWEEN f.start_line AND f.end_line), a AS (SELECT file, line, min(ring)::bigint AS ring FROM (SELECT file, line, 1 AS ring FROM diff_lines UNION ALL SELECT file, line, 2 FROM b UNION ALL SELECT file, line, 3 FROM e UNION ALL SELECT file, line, 4 FROM source_lines) GROUP BY ALL), n AS (SELECT k AS ring, (SELECT count(*) FROM a WHERE a.ring = k) AS added, (SELECT count(*) FROM a WHERE a.ring < k) AS size FROM range(1, 5) t(k)), z AS (SELECT coalesce(min(ring), 4) AS stop FROM n WHERE size > 0 AND added / size < 0.05) SELECT a.* FROM a, z WHERE ring <= stop", "source_lines", "diff_lines", "functions"),
        "text_blocks": r("--+x AS (SELECT d.file, d.line, CASE WHEN d.line - lag(d.line) OVER (PARTITION BY d.file ORDER BY d.line) > 1 THEN '  ...|...' || chr(10) ELSE '' END || '+' || lpad(d.line::varchar, 4, ' ') || '|' || s.text AS out FROM diff_lines d JOIN source_lines s USING (file, line)) SELECT file, string_agg(out, chr(10) ORDER BY line) AS block FROM x GROUP BY file", "diff_lines", "source_lines"),
        "diff_reader": r("--+n AS (SELECT file, line, count(*) OVER (PARTITION BY file) AS n, sum(CASE WHEN line % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY line) - 1 AS moved FROM source_lines) SELECT file AS diff_id, 'src/' || file || '.py' AS file, 'Modified' AS modify_type, (file % 9 + 5 + moved)::bigint AS line, 'python' AS language FROM n WHERE line % 3 = 2 AND moved <= n", "source_lines"),
    }


def oracle_sql() -> dict[str, str]:
    return line_sql() | flow_queries.oracle_sql() | code_queries.oracle_sql()


def queries() -> dict:
    from . import queries as here

    return {name: getattr(here, name) for name in line_sql()} | flow_queries.queries() | code_queries.queries()
