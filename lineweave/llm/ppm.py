"""LM scoring by prediction by partial matching, with a unigram base score.

The model is a pretrained byte-context trie of order ORDER over the training texts (A-Z lower-cased, UTF-8): a symbol
unseen in a context escapes to the next shorter one with PPMC's estimate, and the symbols of the longer context are
excluded there. Since a context's symbols are among those of its suffixes, the excluded set at each order is just the
longer context's symbols, so every escape and every denominator is a number stored at a trie node and a text's code
length is a sum of table look-ups. Texts end in one end symbol.

The trie holds every n-gram of the training texts. It lies in buckets: a node and all its suffixes but the two shortest
depend on n-grams with the same last two bytes of context alone, so each bucket holds whole contexts, and the counts of
the two shortest orders (65,536 at most) go to all. The scores of the most frequent codes are broadcast; each other one
that a text has is dealt to its bucket, scored there and added to its row.

Null texts are empty: one end token, one end symbol. Rows are scored one by one, so repeated ids do no harm. Without
training rows every symbol has probability 1/256. Extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_remainder, read, remainder_column, segment_sums, small_batches, utf8

#: Bytes of context; codes whose scores are broadcast at most, the codes of a bucket of the trie on average at most.
ORDER, TRIE = 5, 500_000
#: Token counts that are broadcast at most; the counts of all other tokens are joined by a shuffle.
FREQUENT = 100_000
#: Distinct tokens and n-grams that a task counts before it passes them on; codes to be scored that it holds.
HELD, ASKED = 1_500_000, 1 << 18
END = b""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte code that ends at each symbol of each row (its bytes, then 0), and the row boundaries."""
    n, size = len(offsets) - 1, np.diff(offsets)
    laid = np.zeros(len(data) + n * (ORDER + 1) + ORDER, dtype=np.uint64)
    row = np.repeat(np.arange(n), size)
    laid[np.arange(len(data)) + row * (ORDER + 1) + ORDER] = LOWER[data]
    code = np.zeros(len(laid) - ORDER, dtype=np.uint64)
    for k in range(ORDER + 1):
        code |= laid[ORDER - k : len(laid) - k] << np.uint64(8 * k)
    # code[i] ends at laid[i + ORDER]; each row has size + 1 symbols, then ORDER places of padding
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(bounds[-1]) + np.repeat(np.arange(n), size + 1) * ORDER
    return code[at], bounds


def rows_of(data: np.ndarray, offsets: np.ndarray):
    raw = data.tobytes().lower()  # ASCII letters only, for bytes
    for i in range(len(offsets) - 1):
        yield raw[offsets[i] : offsets[i + 1]]


def counted(documents: DataFrame) -> DataFrame:
    """(token, code, n) over the training rows: token counts (code null) and n-gram counts (token null)."""
    small_batches(documents.sparkSession)

    def out(tokens: Counter, grams: np.ndarray, times: np.ndarray):
        yield pa.RecordBatch.from_arrays([pa.array(tokens.keys(), pa.binary()), pa.nulls(len(tokens), pa.int64()), pa.array(tokens.values(), pa.int64())], names=["token", "code", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.binary()), pa.array(grams.astype(np.int64)), pa.array(times)], names=["token", "code", "n"])

    def run(batches):
        tokens: Counter = Counter()
        grams, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for text in rows_of(data, offsets):
                tokens.update(text.split())
            tokens[END] += batch.num_rows
            if batch.num_rows:
                new, n = np.unique(codes(data, offsets)[0], return_counts=True)
                both = np.concatenate([grams, new])
                grams, place = np.unique(both, return_inverse=True)
                times = np.bincount(place, weights=np.concatenate([times, n]), minlength=len(grams)).astype(np.int64)
            if len(tokens) + len(grams) > HELD:
                yield from out(tokens, grams, times)
                tokens, grams, times = Counter(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield from out(tokens, grams, times)

    learn = documents.where(remainder_column("doc_id", 10) != 0)
    return learn.select(F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, "token binary, code long, n long").groupBy("token", "code").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, at_most: int):
    """The condition of the largest counts: all at or above the least eighth-octave that keeps them within at_most."""
    step = F.floor(F.log2("n") * 8)
    held, least = 0, 0
    for row in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():
        if held + row["k"] > at_most:
            least = row["s"] + 1
            break
        held += row["k"]
    return step >= least


class Trie:
    """Log10 probabilities of a byte after up to ORDER bytes, by sorted tables of codes, one a length."""

    def __init__(self, grams: np.ndarray, times: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None):
        """short: codes and counts of two bytes over all buckets, where grams are those of one."""
        self.symbols, self.nodes = [], []  # by order: (codes, log10 count), and nodes
        tables = []
        whole = grams, times
        for order in range(ORDER + 1):
            grams, times = short if short is not None and order < 2 else whole
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            code, place = np.unique(grams & mask, return_inverse=True)
            tables.append((code, np.bincount(place, weights=times, minlength=len(code)) if len(grams) else np.zeros(0)))
        total = distinct = climb = None
        names = None
        for order, (code, n) in enumerate(tables):
            context, place = np.unique(code >> np.uint64(8), return_inverse=True)
            t, q = np.bincount(place, weights=n, minlength=len(context)), np.bincount(place, minlength=len(context)).astype(float)
            divisor, up = np.ones(len(context)), np.zeros(len(context))
            if order and len(context):
                mask = np.uint64((1 << (8 * (order - 1))) - 1)
                suffix = np.searchsorted(names, context & mask)
                shorter = np.searchsorted(tables[order - 1][0], code & np.uint64((1 << (8 * order)) - 1))
                excluded = np.bincount(place, weights=tables[order - 1][1][shorter], minlength=len(context))
                more = distinct[suffix] - q
                divisor = total[suffix] - excluded + more
                with np.errstate(divide="ignore", invalid="ignore"):
                    up = np.where(more > 0, np.log10(more / divisor), 0.0) + climb[suffix]
                divisor = np.where(divisor > 0, divisor, 1.0)
            self.symbols.append((code, np.log10(n)))
            self.nodes.append((context, np.log10(t + q), np.log10(q) - np.log10(t + q), up, np.log10(divisor)))
            names, total, distinct, climb = context, t, q, up
        self.unseen = -math.log10(max(1, 256 - len(tables[0][0])))

    @staticmethod
    def find(table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(table, code), max(len(table) - 1, 0))
        return place, (table[place] == code) if len(table) else np.zeros(len(code), bool)

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code after the bytes before it."""
        out, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        entered = np.zeros(len(code), bool)
        first = np.zeros(len(code))  # log10 of the escape from the longest context that exists
        start = np.zeros(len(code))  # climb from there to the root
        climb, divisor = np.zeros(len(code)), np.zeros(len(code))  # of the context one order longer
        for order in range(ORDER, -1, -1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            context, whole, escape, up, below = self.nodes[order]
            at, there = self.find(context, (code & mask) >> np.uint64(8))
            got, seen = self.find(self.symbols[order][0], code & mask)
            n = self.symbols[order][1]
            hit = open_ & seen
            if hit.any():
                value = n[got[hit]]
                fresh = ~entered[hit]
                out[hit] = np.where(fresh, value - whole[at[hit]], first[hit] + start[hit] - climb[hit] + value - divisor[hit])
                open_ &= ~seen
            new = there & ~entered
            if new.any():
                first[new], start[new] = escape[at[new]], up[at[new]]
            entered |= there
            if there.any():
                climb[there], divisor[there] = up[at[there]], below[at[there]]
        # not even at the root: the escape out of it is the last step of the climb
        out[open_] = (first + start)[open_] + self.unseen
        return out


def bucket_of(code, buckets: int):
    """The bucket of a code (array or column of longs) by its last two bytes of context."""
    context = F.shiftright(code, 8).bitwiseAND(65535) if isinstance(code, Column) else code.astype(np.int64) >> 8 & 65535
    return context * 40503 % 65536 % buckets


def slices(batches):
    """(bucket, slice) of batches sorted by bucket, which is the first column."""
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)] if len(bucket) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[a]), batch.slice(a, b - a)


def bucket_trie(held: list, short: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, Trie]:
    """Codes, counts and trie of the (codes, counts) of one bucket."""
    grams = np.concatenate([g for g, _ in held]) if held else np.zeros(0, np.int64)
    times = np.concatenate([n for _, n in held]) if held else np.zeros(0, np.int64)
    return grams, times, Trie(grams.astype(np.uint64), times.astype(float), short)


#: Layout of a row's own facts: null id, id, held out, tokens, known ones, base score, score; codes to be scored and
#: their numbers of times follow.
PACK = "<?q?qqdd"
SIZE = struct.calcsize(PACK)
#: What is dealt to buckets: n-grams (kind 0), codes to be scored with their rows and times (1), rows' facts (2).
DEALT = "bucket int, kind byte, code long, n long, row long, data binary"


def score(documents: DataFrame) -> DataFrame:
    """One row per row of documents: base score and model score of its whole text."""
    spark = documents.sparkSession
    counts = cut(counted(documents))
    tokens = counts.where("token is not null").select("token", "n")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    divisor = n + 0.1 * (v + 1)
    known = tokens.where(most_frequent(tokens, FREQUENT)).toPandas()
    grams = counts.where("code is not null").select("code", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(65536, max(4 * parts, -(-grams.count() // TRIE)))
    pairs = grams.groupBy(F.col("code").bitwiseAND(65535).alias("code")).agg(F.sum("n").alias("n")).toPandas()
    ends = spark.sparkContext.broadcast((pairs["code"].to_numpy().astype(np.uint64), pairs["n"].to_numpy().astype(float)))
    small_batches(spark)

    def learned(batches):
        """(code, n, score) of the n-grams of whole buckets."""

        def out():
            code, times, trie = bucket_trie(held, ends.value)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(times), pa.array(trie.score(code.astype(np.uint64)))], names=["code", "n", "score"])

        at, held = None, []
        for bucket, rows in slices(batches):
            if bucket != at and held:
                yield out()
                held = []
            at = bucket
            held.append((rows.column(1).to_numpy(), rows.column(2).to_numpy()))
        if held:
            yield out()

    placed = grams.select(bucket_of(F.col("code"), buckets).cast("int").alias("bucket"), "code", "n")
    scored = placed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(learned, "code long, n long, score double")
    common = scored.where(most_frequent(grams, TRIE)).select("code", "score").toPandas()
    shared = spark.sparkContext.broadcast(({bytes(t): math.log10((c + 0.1) / divisor) for t, c in zip(known["token"], known["n"], strict=True)}, common["code"].to_numpy().astype(np.uint64), common["score"].to_numpy().astype(float)))

    def run(batches):
        values, frequent, gains = shared.value
        index, gains = pd.Index(frequent), np.append(gains, 0.0)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            code, bounds = codes(data, offsets)
            place = index.get_indexer(code)
            total = segment_sums(gains[place], bounds[:-1], bounds[1:])
            # each other code once a row: the row above its 48 bits (small_batches() bounds the rows)
            other = np.flatnonzero(place < 0)
            owner = (np.searchsorted(bounds, other, side="right") - 1).astype(np.uint64)
            asked, many = np.unique(owner << np.uint64(48) | code[other], return_counts=True)
            ask = np.searchsorted(asked >> np.uint64(48), np.arange(batch.num_rows + 1).astype(np.uint64))
            asked, many = asked & np.uint64((1 << 48) - 1), many.astype(np.uint32)
            rows, words, times, facts = [], [], [], []
            for i, (row, doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows_of(data, offsets), strict=True)):
                found = text.split()
                base, hits = 0.0, 0
                for w, k in [*Counter(found).items(), (END, 1)]:
                    value = values.get(w)
                    if value is None:
                        rows.append(row)
                        words.append(w)
                        times.append(k)
                        facts.append(None)
                    else:
                        base += k * value
                        hits += k
                # the row's own facts travel under a key that is no token and that no other row has
                rows.append(row)
                words.append(b" %d" % row)
                times.append(0)
                own = struct.pack(PACK, doc_id is None, doc_id or 0, fold_remainder(doc_id, 10) == 0, len(found) + 1, hits, base, float(total[i]))
                facts.append(own + asked[ask[i] : ask[i + 1]].tobytes() + many[ask[i] : ask[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32()), pa.array(facts, pa.binary())], names=["row", "token", "times", "facts"])

    found = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, token binary, times int, facts binary")
    joined = found.join(tokens, "token", "left")
    value = F.when(F.col("facts").isNull(), F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(divisor)))
    sums = joined.groupBy("row").agg(F.max("facts").alias("facts"), F.coalesce(F.sum(value), F.lit(0.0)).alias("rare"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("rare_known"))

    def spread(batches):
        """The rows' facts without their codes, and the codes of many rows, a blob for each bucket."""

        def out():
            row, code, times = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = bucket_of(code, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, row, code, times = bucket[order], row[order], code[order], times[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            data = [row[a:b].tobytes() + code[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return dealt(bucket[cuts[:-1]], 1, None, data)

        def dealt(bucket, kind, row, data):
            none = pa.nulls(len(data), pa.int64())
            columns = [pa.array(bucket, pa.int32()), pa.array(np.full(len(data), kind, np.int8)), none, none, none if row is None else pa.array(row, pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "code", "n", "row", "data"])

        held, size = [], 0
        for batch in batches:
            rows, own = [], []
            for row, facts, rare, rare_known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                null, doc_id, out_, words, hits, base, total = struct.unpack_from(PACK, facts)
                rows.append(row)
                own.append(struct.pack(PACK, null, doc_id, out_, words, hits + rare_known, base + rare, total))
                many = (len(facts) - SIZE) // 12
                if many:
                    held.append((np.full(many, row), np.frombuffer(facts, np.uint64, many, SIZE), np.frombuffer(facts, np.uint32, many, SIZE + 8 * many)))
                    size += many
                if size >= ASKED:
                    yield out()
                    held, size = [], 0
            yield dealt([row % buckets for row in rows], 2, rows, own)
        if held:
            yield out()

    def answers(batches):
        """(row, facts, part): what the codes of a bucket add to their rows, and the rows' facts."""

        def out(row, facts, part):
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(facts, pa.binary()), pa.array(part, pa.float64())], names=["row", "facts", "part"])

        at, held, trie = None, [], None
        for bucket, rows in slices(batches):
            if bucket != at:
                at, held, trie = bucket, [], None
            kind = rows.column(1).to_numpy()
            first, last = np.searchsorted(kind, [1, 2])
            if first:
                learnt = rows.slice(0, first)
                held.append((learnt.column(2).to_numpy(), learnt.column(3).to_numpy()))
            for data in rows.column(5).slice(first, last - first).to_pylist():
                trie = trie or bucket_trie(held, ends.value)[2]
                many = len(data) // 20
                row, place = np.unique(np.frombuffer(data, np.int64, many), return_inverse=True)
                gain = trie.score(np.frombuffer(data, np.uint64, many, 8 * many)) * np.frombuffer(data, np.uint32, many, 16 * many)
                yield out(row, pa.nulls(len(row), pa.binary()), np.bincount(place, weights=gain, minlength=len(row)))
            own = rows.slice(last)
            yield out(own.column(4), own.column(5), np.zeros(len(own)))

    asked = sums.select("row", "facts", "rare", "rare_known").mapInArrow(spread, DEALT)
    taught = placed.selectExpr("bucket", "cast(0 as byte) as kind", "code", "n", "cast(null as long) as row", "cast(null as binary) as data")
    answered = taught.unionByName(asked).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answers, "row long, facts binary, part double")
    whole = answered.groupBy("row").agg(F.max("facts").alias("facts"), F.sum("part").alias("part"))

    def unpack(batches):
        for batch in batches:
            rows = []
            for facts, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                null, doc_id, held, size, hits, base, total = struct.unpack(PACK, facts)
                rows.append((None if null else doc_id, held, size, hits, n, base, total + part))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return whole.select("facts", "part").mapInArrow(unpack, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
