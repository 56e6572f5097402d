"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is the terms whose document frequency lies in a band. A text's distinct lexicon terms are sorted, and for
each of SUBSETS random subsets of the lexicon those that belong to it are hashed. Subsets come at several densities
(level l keeps a term with probability 2**-l); a fingerprint holds the levels at which its text has about one term a
subset, so long and short texts alike have subsets that survive an edit. Likeness is the share of equal hashes among
the subsets of common levels that are not empty in both.

Null texts are empty. A text without a lexicon term has the hash of its distinct terms as its fingerprint (like an
equal one, unlike any other). Equal texts have equal fingerprints. Rows with equal or null doc_id are ordered by a
hash of their text, null ids last. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: The band, as shares of the documents. A lexicon holds at most (mean distinct terms of a document) / LOW terms,
#: however large the corpus, since document frequencies sum to that mean times the documents.
LOW, HIGH = 0.001, 0.15
SUBSETS, LEVELS = 16, 3
#: Distinct terms that a task counts before it passes them on.
HELD = 400_000
TERM = re.compile(r"\w+")


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) over all documents, summed in each task first."""
    small_batches(documents.sparkSession)

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(terms(text))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return documents.select(documents.text.cast("string")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Lexicon:
    """Terms of the band with their random values, one for each subset."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.place = {w: i for i, w in enumerate(self.words)}
        base = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        odd = np.array([xxhash.xxh64_intdigest(f"subset {s}") | 1 for s in range(SUBSETS)], dtype=np.uint64)
        mixed = base[:, None] * odd[None, :]
        self.value = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).reshape(-1, SUBSETS)

    def fingerprint(self, text: str) -> str:
        found = terms(text)
        ids = sorted(i for w in found if (i := self.place.get(w)) is not None)
        if not ids:
            return "x:" + xxhash.xxh128_hexdigest("\n".join(sorted(found)) if found else text)
        value, first = self.value[ids], max(0, int(math.log2(len(ids))) - 1)
        names = [self.words[i] for i in ids]
        levels = []
        for level in range(first, first + LEVELS):
            kept = value < np.uint32(min(2 ** (32 - level), 2**32 - 1))
            hashes = [f"{xxhash.xxh32_intdigest(chr(10).join([names[i] for i in np.flatnonzero(kept[:, s])])):08x}" if kept[:, s].any() else "" for s in range(SUBSETS)]
            levels.append(f"{level}:{','.join(hashes)}")
        return ";".join(levels)


def likeness(a: str, b: str) -> float:
    """The share of equal subset hashes, 0 to 1."""
    if a == b:
        return 1.0
    if a[0] == "x" or b[0] == "x":
        return 0.0
    x, y = (dict(p.split(":") for p in f.split(";")) for f in (a, b))
    pairs = [(p, q) for level in x.keys() & y.keys() for p, q in zip(x[level].split(","), y[level].split(","), strict=True) if p or q]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def learn(documents: DataFrame) -> Lexicon:
    n = documents.count()
    band = frequencies(documents).where((F.col("df") >= math.ceil(LOW * n)) & (F.col("df") <= max(1, math.floor(HIGH * n))))
    return Lexicon([r[0] for r in band.select("term").toLocalIterator()])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """(range, sentinel, doc_id, key, packed) in partitions of whole doc_id ranges, sorted by descending doc_id.

    The ranges begin at doc_ids of the table; the first row of each range is also sent, as a sentinel, to the range
    before it, and the first of all to the last. So every row meets its successor in one shuffle of packed texts.
    """
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    share = [k / ranges for k in range(1, ranges + 1)]
    found = ids.agg(F.percentile_approx("doc_id", share, 10_000).alias("p"), F.max("doc_id").alias("top")).first()
    begins = sorted({*(found["p"] or []), *([found["top"]] if found["top"] is not None else [])}, reverse=True) or [0]

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())], names=["doc_id", "key", "packed"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(pack, "doc_id long, key long, packed binary")
    splits = F.array(*(F.lit(b).cast("long") for b in begins))
    own = F.when(F.col("doc_id").isNull(), len(begins) - 1).otherwise(F.size(F.filter(splits, lambda s: s >= F.col("doc_id"))) - 1)
    before = F.when(F.col("doc_id") == begins[0], len(begins) - 1).otherwise(own - 1)
    places = F.array(F.struct(own.alias("range"), F.lit(0).alias("sentinel")), F.struct(before.alias("range"), F.lit(1).alias("sentinel")))
    copies = F.when(F.array_contains(splits, F.coalesce(F.col("doc_id"), F.lit(-(2**63)))), places).otherwise(F.slice(places, 1, 1))
    rows = rows.withColumn("at", F.explode(copies)).select("at.range", "at.sentinel", "doc_id", "key", "packed")
    order = ["range", "sentinel", F.col("doc_id").desc_nulls_last(), "key"]
    return rows.repartition(max(1, len(begins) // 2), "range").sortWithinPartitions(*order)


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, and those of its edited text and of the next document for comparison."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(learn(documents))
    small_batches(spark)
    rows = with_next(documents, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        lexicon, press = shared.value, zstandard.ZstdDecompressor()
        last = None  # (range, doc_id, text, fingerprint) of the row that waits for its successor
        for batch in batches:
            out = []
            for place, sentinel, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if sentinel and (last is None or last[0] != place):
                    continue  # a further sentinel of a range that is done
                text = press.decompress(packed).decode()
                print_ = lexicon.fingerprint(text)
                if last is not None and last[0] == place:
                    n = len(last[2])
                    edited = last[2][: n - n // 3] + text[: n // 3]
                    other = last[3] if edited == last[2] else lexicon.fingerprint(edited)
                    out.append((last[1], n, hashlib.sha256(edited.encode()).hexdigest(), last[3], other, likeness(last[3], other), likeness(last[3], print_)))
                last = None if sentinel else (place, doc_id, text, print_)
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
