"""Language ID by multilingual mixture inference.

A text is cut into units of UNIT bytes; each unit's log-likelihood under a language is the sum of its byte n-gram
log-probabilities (letters lower-cased, everything else one separator). Expectation-maximisation over the units gives
the text's language proportions; of the nested language sets (largest proportions first) the one with the least
penalised likelihood is kept, and its largest language is the prediction.

Null texts, and texts without a letter, are `und` with score 0. Without any labelled row every text is `und`.
Ties go to the language that sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_remainder, read, remainder_column, segment_sums, small_batches, utf8

#: n-gram bins (a power of two), bytes in a unit, EM rounds, smoothing counts.
BINS, UNIT, ROUNDS, SMOOTH = 1 << 16, 24, 12, 0.1
#: Cost of one more language, in units of half the log of the number of text units.
PENALTY = 4.0

FOLD = np.full(256, 32, dtype=np.uint32)
FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[128:] = np.arange(128, 256)
LETTER = FOLD != 32


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bin of the four-byte gram that ends at each byte; separators stand before each row, so none reaches into another."""
    c = np.concatenate([np.full(3, 32, dtype=np.uint32), FOLD[data]])
    h = c[3:].copy()
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        before = c[3 - k : len(c) - k] * np.uint32(factor)
        for j in range(k):  # the first k bytes of a row have a separator there
            at = starts + j
            before[at[at < len(before)]] = np.uint32(32 * factor % 2**32)
        # a row shorter than k bytes has been overwritten into the next one, whose own start is set alike
        h += before
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def counted(documents: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(lang, bin, n) over the documents to learn from: one dense count vector a language and task, then a sum."""
    small_batches(documents.sparkSession)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            bins, langs = grams(data, offsets), np.array(batch.column(1).to_pylist(), dtype=object)
            row_lang = {x: k for k, x in enumerate(dict.fromkeys(langs))}
            of_byte = np.repeat(np.array([row_lang[x] for x in langs], dtype=np.int64), np.diff(offsets))
            dense = np.bincount(of_byte * BINS + bins, minlength=len(row_lang) * BINS).reshape(-1, BINS) if len(bins) else np.zeros((len(row_lang), BINS), np.int64)
            for x, k in row_lang.items():
                counts[x] = counts.get(x, 0) + dense[k]
        for x, c in counts.items():
            full = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(c[full], pa.int64())], names=["lang", "bin", "n"])

    learn = documents.where(remainder_column(doc_id, 3) != 1).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return learn.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def model(documents: DataFrame, **columns: str) -> tuple[list[str], np.ndarray]:
    """The languages and log-probabilities [bin, language]. At most BINS rows a language come to the driver."""
    found = counted(documents, **columns).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((BINS, max(len(langs), 1)), SMOOTH)
    if langs:
        np.add.at(counts, (found["bin"].to_numpy(), found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy()), found["n"].to_numpy())
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def mixture(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_unit: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM proportions [doc, language] and log-likelihoods of documents, each with its allowed languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    peak = units.max(1, keepdims=True)
    like = np.exp(units - peak)
    sizes = np.maximum(ends - starts, 1)[:, None]
    for _ in range(ROUNDS):
        weighted = like * share[of_unit]
        total = np.maximum(weighted.sum(1, keepdims=True), 1e-300)
        share = segment_sums(weighted / total, starts, ends) / sizes
        share = np.where(allowed > 0, np.maximum(share, 1e-9), 0)
        share /= share.sum(1, keepdims=True)
    total = np.log(np.maximum((like * share[of_unit]).sum(1), 1e-300)) + peak[:, 0]
    return share, segment_sums(total, starts, ends)


def identify(column: pa.Array, langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """lang_pred, score, the language set (comma-joined) of each text of an Arrow column, and whether the set explains the
    text better than grams drawn evenly from all bins do."""
    data, offsets = utf8(column)
    n = len(column)
    pred, score, chosen, likely = ["und"] * n, np.zeros(n), [""] * n, np.zeros(n, bool)
    letters = segment_sums(LETTER[data].astype(np.int64), offsets[:-1], offsets[1:]) > 0
    ascii_letters = segment_sums((LETTER[data] & (data < 128)).astype(np.int64), offsets[:-1], offsets[1:]) > 0
    for i in np.flatnonzero(letters & ~ascii_letters):
        letters[i] = any(c.isalpha() for c in column[int(i)].as_py())
    docs = np.flatnonzero(letters)
    if not langs or not len(docs):
        return pred, score, chosen, likely
    scores = table[grams(data, offsets)]
    # units: equal stretches of each document, the last one shorter
    per = -(-np.diff(offsets)[docs] // UNIT)
    ends = np.cumsum(per)
    starts = ends - per
    of_unit = np.repeat(np.arange(len(docs)), per)
    begin = offsets[docs][of_unit] + (np.arange(ends[-1]) - starts[of_unit]) * UNIT
    units = segment_sums(scores, begin, np.minimum(begin + UNIT, offsets[docs + 1][of_unit]))
    single = segment_sums(units, starts, ends)
    best = single.argmax(1)
    cost = PENALTY * 0.5 * np.log(per + 1)
    value, pick = single.max(1), np.zeros(single.shape, bool)
    pick[np.arange(len(docs)), best] = True
    share = pick.astype(float)
    # no mixture is likelier than each unit's own best language: where even that can't pay for a second one, stop
    open_ = np.flatnonzero(segment_sums(units.max(1), starts, ends) - cost > value) if len(langs) > 1 else np.zeros(0, int)
    if len(open_):
        rows = np.flatnonzero(np.isin(of_unit, open_))
        u, k = units[rows], per[open_]
        e = np.cumsum(k)
        s, of = e - k, np.repeat(np.arange(len(open_)), k)
        full, _ = mixture(u, s, e, of, np.ones((len(open_), len(langs))))
        order = np.argsort(-full, axis=1, kind="stable")
        kept, bound = value[open_], segment_sums(u.max(1), s, e)
        for m in range(2, len(langs) + 1):
            # larger sets go on only where each unit's own best language could still pay for them
            live = np.flatnonzero(bound - (m - 1) * cost[open_] > kept)
            if not len(live):
                break
            at = np.flatnonzero(np.isin(of, live))
            ends_, size = np.cumsum(k[live]), k[live]
            allowed = np.zeros((len(live), full.shape[1]))
            np.put_along_axis(allowed, order[live][:, :m], 1.0, axis=1)
            part, like = mixture(u[at], ends_ - size, ends_, np.repeat(np.arange(len(live)), size), allowed)
            gain = like - (m - 1) * cost[open_[live]]
            better = gain > kept[live]
            kept[live[better]] = gain[better]
            share[open_[live[better]]] = part[better]
            pick[open_[live[better]]] = allowed[better] > 0
        value[open_] = kept
    # against an even draw from the bins, without what the set costs
    likely[docs] = value + (pick.sum(1) - 1) * cost > -np.log(BINS) * np.diff(offsets)[docs]
    sure = np.exp(single - np.logaddexp.reduce(single, axis=1)[:, None])
    top = share.argmax(1)
    # the share of the language; for a single one its posterior against the others
    top_share = np.where(pick.sum(1) > 1, share[np.arange(len(docs)), top], sure[np.arange(len(docs)), top])
    for i, d in enumerate(docs):
        pred[d], chosen[d] = langs[top[i]], ",".join(langs[j] for j in np.flatnonzero(pick[i]))
    score[docs] = np.clip(top_share, 0, 1)
    return pred, score, chosen, likely


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def predict(documents: DataFrame, learned: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row per document; the text alone decides the prediction."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(learned or model(documents))
    small_batches(spark)

    def run(batches):
        langs, table = shared.value
        for batch in batches:
            pred, score, chosen, _ = identify(batch.column(1), langs, table)
            held = [fold_remainder(d, 3) == 1 for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return documents.select(documents.doc_id.cast("long"), documents.text.cast("string")).mapInArrow(run, SCHEMA)


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents whose text is in learned languages; their columns stay as they are, whatever their names and values.

    Rejected are texts that are null or without a letter, and those that an even draw from all bins explains better than
    the text's own language set (noise, or a language that nothing was learned of). Each row is judged by its text alone,
    so repeated rows and null ids stay or go alike. Without any labelled row nothing can be told apart, and all rows stay.
    An empty table stays empty.
    """
    spark = documents.sparkSession
    learned = model(documents)
    if not learned[0]:
        return documents
    shared = spark.sparkContext.broadcast(learned)
    small_batches(spark)
    at = documents.columns.index("text")

    def run(batches):
        langs, table = shared.value
        for batch in batches:
            yield batch.filter(pa.array(identify(batch.column(at), langs, table)[3], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(read(spark, sf_dir, "documents"))
