"""A corpus of source files made from the documents table: four languages in turn, the doc_id in the names.

The driver's tables hold no source code. TEMPLATES is written by hand to meet the rules of the operators; {i} is the
file's doc_id and {j} that of the next file in the same language, so calls cross files. FACTS is what a reader must find
in each: printed from the readers and checked line by line against the texts. The SQL of the code queries starts from it,
so a reader that changes what it finds no longer agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expected import FACTS

TEMPLATES = (
    ("python", "src/f{i}.py", '''import os
from flask import request as rq
from mod{j} import step{j}

def load{i}(path, flag=0):
    name = rq.args["n"]
    alias = name
    if flag > 1:
        total = step{j}(alias, flag)
        os.system("rm " + alias)
    else:
        total = 0
    for part in path:
        total += part
    try:
        handle = open(path)
        cursor.execute("select " + name)
    except OSError:
        return None
    finally:
        total = total + 1
    return total

class Box{i}(Base):
    def get(self, key):
        self.key = key
        return self.key
'''),
    ("go", "src/f{i}.go", '''package main
import (
	"os"
	"os/exec"
)
type Store{i} struct {
	path string
}
func (s *Store{i}) Serve{i}(w http.ResponseWriter, r *http.Request) error {
	name := r.FormValue("name")
	if name == "" {
		return nil
	}
	f, err := os.Open(name)
	defer f.Close()
	for n := 0; n < 3; n++ {
		s.path = name
	}
	switch name {
	case "a":
		exec.Command("sh", "-c", name)
	default:
		help{i}(name)
	}
	return err
}
func help{i}(q string) int {
	m := q
	return step{j}(m)
}
'''),
    ("javascript", "src/f{i}.js", '''const cp = require("child_process");
import { load as fetchAll } from "./m{j}";
class Base{i} extends Root {
  run{i}(req, limit) {
    const { id, kind: sort } = req;
    let key = id;
    if (limit > 3) {
      key = fetchAll(key);
    }
    for (const item of key) {
      send{i}(item);
    }
    try {
      cp.exec("ls " + key);
    } catch (e) {
      throw e;
    } finally {
      done(key);
    }
    return sort;
  }
}
function send{i}(x) {
  const box = new Base{i}();
  return box.run{i}(x, 1); // back
}
'''),
    ("c", "src/f{i}.c", '''#include <stdio.h>
static int copy{i}(struct dev *d, char *buf, int len) {
    int n = len;
    char *p = malloc(n);
    if (!p)
        return -1;
    handler = step{i};
    d->ops.start{i} = step{i};
    switch (n) {
    case 1:
        n = 2;
    case 2:
        memcpy(p, buf, n);
        break;
    default:
        goto out;
    }
    while (n > 0) {
        n--;
    }
    handler(n);
    d->start{i}(p);
out:
    free(p);
    return n;
}
int step{i}(int v) {
    int w = v + 1;
    return copy{j}(0, 0, w);
}
'''),
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lang, source): one file a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{j}"), (F.col("doc_id") + len(TEMPLATES)).cast("string"))
    of = lambda k: F.element_at(F.array(*(filled(t[k]) for t in TEMPLATES)), (F.col("doc_id") % len(TEMPLATES) + 1).cast("int"))
    return docs.select(of(1).alias("file"), of(0).alias("lang"), of(2).alias("source"))


def facts_sql() -> str:
    """The expected facts of every file, in DuckDB SQL."""
    rows = []
    for line in FACTS.strip("\n").split("\n"):
        k, relation, function, fn_line, first, end, kind, name, path, text, items, n = line.split("|")
        quote = lambda x: "NULL" if x == "~" else "'" + x.replace("'", "''").replace("¦", "|") + "'"
        number = lambda x: x if x != "~" else "NULL"
        listed = "NULL" if items == "~" else "[" + ", ".join(quote(x) for x in items.split("§") if x) + "]::varchar[]"
        rows.append(f"({k}, {quote(relation)}, {quote(function)}, {number(fn_line)}, {first}, {end}, {quote(kind)}, {quote(name)}, {quote(path)}, {quote(text)}, {listed}, {number(n)})")
    put = "replace(replace({0}, '{{i}}', doc_id::varchar), '{{j}}', (doc_id + 4)::varchar)".format
    names = "[" + ", ".join(f"'{t[1]}'" for t in TEMPLATES) + "][k + 1]"
    columns = ", ".join(f"{put(c)} AS {c}" if c not in ("fn_line", "line", "end_line", "items", "n") else f"list_transform(items, lambda x: {put('x')}) AS items" if c == "items" else c for c in ("relation", "function", "fn_line", "line", "end_line", "kind", "name", "path", "text", "items", "n"))
    return f"SELECT {put(names)} AS file, {columns} FROM (SELECT doc_id FROM documents) JOIN (VALUES {', '.join(rows)}) v(k, relation, function, fn_line, line, end_line, kind, name, path, text, items, n) ON doc_id % 4 = k"
