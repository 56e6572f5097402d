"""MinHash near-duplicates by order MinHash, verified by banded alignment.

A text's k-mers are its SHINGLE-word shingles (lower-cased words), each labelled with its occurrence number. A sketch
takes the TAKEN least labelled k-mers under a random order and hashes them in the order in which they stand in the
text. Documents that agree in a band are candidates. A candidate pair is linked if the word
edit similarity, 1 - distance / longer length, is at least SIMILARITY; the distance comes from a bit-parallel alignment
that never leaves the band of diagonals that this similarity allows.

Equal texts are one class before anything else. In a bucket every member is aligned with the bucket's least member.
Then all members of a bucket, linked to it or not, are compared pair by pair, in blocks of BLOCK members, so that a large
bucket is dealt over many tasks. Pairs are skipped only where that loses nothing: texts that are linked already, be it by
way of others, and texts whose numbers of words, in all or in BINS classes of words, show that too many words must be
edited. So a group of near copies costs about one alignment a member; the comparison of the numbers alone grows with the
square of a bucket's members of like length, and none of it is dropped.

A text without words (null, empty, blank) is in a class of its own; a text of fewer words than a shingle is one
shingle. Rows with one doc_id share a class; a null doc_id has a null class and is kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, read, small_batches, utf8
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: k-mers in a sketch, sketches, sketches in a band. Texts that share a part J of their shingles agree
#: in a sketch with probability about J**3: of pairs with J of 0.8, 0.6, 0.5 and 0.4 all, all, 99.5 % and 93 % meet.
TAKEN, SKETCHES, ROWS = 3, 40, 1
#: Members of a block of a bucket, classes of words that are counted, the count that stands for all greater ones, pairs
#: that are compared at once, tasks that a leader's pairs are dealt over, bytes of texts that are sent at once, rows of
#: numbers in an Arrow batch.
BLOCK, BINS, MANY, AT_ONCE, SALTS, SENT, NUMBERS = 4096, 128, 255, 1 << 20, 256, 4 << 20, 1 << 16

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
POWERS = np.cumprod(np.full(4096, 0x100000001B3, dtype=np.uint64))
BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a batch's words, end to end, and the row boundaries among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begins[cuts] = ink[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    value = np.where(ink, BYTES[data] * POWERS[place % len(POWERS)] + (place // len(POWERS)).astype(np.uint64), np.uint64(0))
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def sketches(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[row, band] keys of rows that have words; rows without have zeros."""
    n, size = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((n, SKETCHES // ROWS), dtype=np.int64)
    live = np.flatnonzero(size)
    if not len(live):
        return out
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    kmers = np.maximum(size[live] - SHINGLE + 1, 1)
    ends = np.cumsum(kmers)
    starts = ends - kmers
    row = np.repeat(np.arange(len(live)), kmers)
    at = bounds[live][row] + np.arange(ends[-1]) - starts[row]
    shingle = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < bounds[live + 1][row]
        shingle = mixed(shingle + np.where(inside, padded[at + k], np.uint64(0)) + np.uint64(0x632BE59BD9B4E019))
    # occurrence numbers: ranks among equal shingles of a row
    order = np.lexsort((shingle, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (shingle[order][1:] != shingle[order][:-1]) | (row[order][1:] != row[order][:-1])
    run = np.flatnonzero(fresh)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = (np.arange(len(order)) - run[np.cumsum(fresh) - 1]).astype(np.uint64)
    label = mixed(shingle + occurrence * np.uint64(0xD6E8FEB86659FD93))
    key = np.zeros(len(live), np.uint64)
    top = np.uint64(2**64 - 1)
    for s in range(SKETCHES):
        value = mixed(label ^ (np.uint64((s + 1) * 0xA24BAED4963EE407 % 2**64)))
        picks = []
        for _ in range(TAKEN):
            least = np.minimum.reduceat(value, starts)
            hits = np.flatnonzero(value == np.repeat(least, kmers))
            first = hits[np.searchsorted(row[hits], np.arange(len(live)))]
            picks.append(np.where(least == top, -1, first))
            value[first] = top
        picks = np.sort(np.stack(picks), axis=0)  # the order of the text
        if s % ROWS == 0:
            key = np.full(len(live), s + 1, np.uint64)
        for p in picks:
            key = mixed(key * np.uint64(0x9FB21C651E98DF25) + np.where(p >= 0, shingle[np.maximum(p, 0)], np.uint64(1)))
        if s % ROWS == ROWS - 1:
            out[live, s // ROWS] = key.view(np.int64)
    return out


# ---- alignment -------------------------------------------------------------------------------------------------------


def distance(x: Sequence[int], y: Sequence[int], most: int) -> int:
    """Edit distance of two word sequences, or most + 1 if it is larger.

    Only the band of diagonals within most is visited, column by column: the vertical differences of a column's part of
    the band are the bits of two integers, which one addition and some logic carry over to the next column.
    """
    head, short = 0, min(len(x), len(y))
    while head < short and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < short - head and x[len(x) - 1 - tail] == y[len(y) - 1 - tail]:
        tail += 1
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > most or not len(y):
        return min(len(x), most + 1)
    band = min(most, len(x))
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << (2 * band + 1)) - 1
    up, down = ((1 << (band + 1)) - 1) << band, 0  # where the column rises and falls by one
    far, straight = band, len(x) - band
    below, foot = 1 << (2 * band), 1 << (2 * band - 1) if band else 0
    give_up = band + len(y) - straight
    for j, w in enumerate(y):
        same = places.get(w, 0)
        same = (same >> (j - band) if j > band else same << (band - j)) & full
        flat = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | (full & ~(flat | up)), flat & up
        if j < straight:  # along the band's last diagonal, then along the last row
            far += not flat & below
        else:
            far += bool(rise & foot) - bool(fall & foot)
            foot >>= 1
        if far > give_up:
            return most + 1
        flat >>= 1
        up, down = fall | (full & ~(flat | rise)), flat & rise
    return min(far, most + 1)


def allowed(n: int, m: int) -> int:
    """The largest distance at which texts of n and m words are still similar."""
    return int((1 - SIMILARITY) * max(n, m) + 1e-9)


def similar(a: list[str], b: list[str]) -> bool:
    """Whether the edit similarity of two word lists is at least SIMILARITY."""
    return Leader(" ".join(a).encode()).similar(" ".join(b).encode())


# ---- the operator ----------------------------------------------------------------------------------------------------


def bags(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[row, class]: how many words of each of BINS classes a row has; MANY everywhere in a row that has as many of one."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    bag = np.bincount(row * BINS + (words % np.uint64(BINS)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    bag[(bag >= MANY).any(1)] = MANY
    return bag.astype(np.uint8)


def sketched(documents: DataFrame) -> DataFrame:
    """(doc_id, key, words, bands, bag) of every row; key is the text's digest."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            words, bounds = word_hashes(data, offsets)
            bands, raw = sketches(words, bounds), data.tobytes()
            keys = [hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest() for i in range(batch.num_rows)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.ravel()))
            bag = [x.tobytes() for x in bags(words, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(bounds), pa.int64()), flat, pa.array(bag, pa.binary())], names=["doc_id", "key", "words", "bands", "bag"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, key binary, words long, bands array<long>, bag binary")


def packed(documents: DataFrame) -> DataFrame:
    """(id, pack): the compressed texts by doc_id."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(raw[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)], pa.binary())], names=["id", "pack"])

    rows = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "id long, pack binary")


def texts_of(ids: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, pack): the distinct rows of packs (id, pack) whose id is among ids, a column that may hold copies.

    One shuffle and one sort; nothing but the last row is held.
    """
    asked = ids.toDF("id").select("id", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("binary").alias("pack"))
    rows = asked.unionByName(packs.select("id", F.lit(1).cast("byte").alias("kind"), "pack"))

    def run(batches):
        now, last = None, None
        for batch in batches:
            found, texts = [], []
            for id_, kind, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    now, last = id_, None
                elif id_ == now and pack != last:
                    last = pack
                    found.append(id_)
                    texts.append(pack)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(texts, pa.binary())], names=["id", "pack"])

    return rows.repartition("id").sortWithinPartitions("id", "kind", "pack").mapInArrow(run, "id long, pack binary")


def met_in(members: DataFrame) -> DataFrame:
    """(rep, words, bucket, leader, leader_words): the members (rep, words, bucket) of buckets of two or more, with the least one.

    Nearly all buckets have one member, so an aggregate would hold about every row. Here members are shuffled and sorted
    once, and a bucket is streamed, whatever its size: nothing but its first row is held.
    """

    def run(batches):
        held, sent = None, False  # the first row of the bucket that is open, and whether it went out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], rows[2, 1:] != rows[2, :-1]]))
            size = np.diff(starts, append=rows.shape[1])
            out = np.repeat(size > 1, size)
            out[0] &= not sent
            first = np.repeat(starts, size)[out]
            held, sent = rows[:, starts[-1] : starts[-1] + 1], bool(size[-1] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:, out], rows[0, first], rows[1, first])], names=["rep", "words", "bucket", "leader", "leader_words"])

    rows = members.select("rep", "words", "bucket").repartition("bucket").sortWithinPartitions("bucket", "rep", "words")
    return rows.mapInArrow(run, "rep long, words long, bucket long, leader long, leader_words long")


class Leader:
    """One text that many others are compared with."""

    def __init__(self, text: bytes):
        self.names: dict[bytes, int] = {}
        self.words = [self.names.setdefault(w, len(self.names)) for w in text.lower().split()]
        self.count = np.bincount(self.words, minlength=len(self.names)) if self.words else np.zeros(0, np.int64)

    def similar(self, text: bytes) -> bool:
        """Whether the edit similarity of the two texts' words is at least SIMILARITY."""
        found = text.lower().split()
        most, longer = allowed(len(self.words), len(found)), max(len(self.words), len(found))
        if abs(len(self.words) - len(found)) > most:
            return False
        words = [self.names.get(w, -1) for w in found]
        # words that the two do not share in number must be edited
        shared = np.bincount(np.array(words, dtype=np.int64) + 1, minlength=len(self.count) + 1)[1:]
        if longer - np.minimum(self.count, shared).sum() > most:
            return False
        return distance(self.words, words, most) <= most


def verified(pairs: DataFrame, packs: DataFrame) -> DataFrame:
    """The similar ones (a, b) of distinct pairs (a, b); an id that has several texts is similar if one of them is. Each text is sent once by its id, then to each leader a that asks for it.

    A leader's pairs are dealt over SALTS tasks, each of which gets the leader's text once.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    one = F.lit(1).cast("byte")
    none = F.lit(None).cast("binary")
    asked = pairs.select(F.col("b").alias("id"), one.alias("kind"), "a", "salt", none.alias("pack"))
    led = pairs.select("a", "salt").distinct().select(F.col("a").alias("id"), one.alias("kind"), "a", "salt", none.alias("pack"))
    texts = packs.select("id", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("salt"), "pack")
    by_id = texts.unionByName(asked).unionByName(led).repartition("id").sortWithinPartitions("id", "kind")

    def send(batches):
        """(a, salt, id, pack): the texts of ids that somebody asks for."""
        now, texts = None, []
        for batch in batches:
            out, size = [], 0
            for id_, kind, a, salt, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if id_ != now:
                    now, texts = id_, []
                if kind == 0:
                    texts.append(pack)
                    continue
                for text in texts:
                    out.append((a, salt, id_, text))
                    size += len(text)
                    if size > SENT:
                        yield rows_of(out)
                        out, size = [], 0
            yield rows_of(out)

    def rows_of(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["a", "salt", "id", "pack"])

    def run(batches):
        press, now, leaders = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            left, right = [], []
            for a, salt, id_, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, salt) != now:
                    now, leaders = (a, salt), []
                text = press.decompress(pack)
                if id_ == a:
                    leaders.append(Leader(text))
                    continue
                if any(leader.similar(text) for leader in leaders):
                    left.append(a)
                    right.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    met = by_id.mapInArrow(send, "a long, salt int, id long, pack binary")
    met = met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("id") != F.col("a"))
    return met.mapInArrow(run, "a long, b long")


def fits(words: str, other: str) -> Column:
    """Whether texts of so many words can be similar."""
    return F.abs(F.col(words) - F.col(other)) <= F.floor((1 - SIMILARITY) * F.greatest(words, other) + 1e-9)


#: The columns of a member of a group, in the order in which open_pairs() reads them.
MEMBER = ["bucket", "low", "high", "words", "block", "rep", "component", "first", "bag", "bands"]
GROUP = "bucket long, low long, high long, words long, block long, rep long, component long, first boolean, bag binary, bands array<long>"


def open_pairs(rows: pa.Table):
    """Index arrays of the pairs of groups (bucket, low, high), sorted by words, that still have to be aligned.

    Left out are pairs that are linked already, that the numbers of words rule out, that were aligned with the bucket's
    first member before, and that meet in a bucket of an earlier sketch too: they are aligned there.
    """
    n = rows.num_rows
    bucket, low, high, words, block, component = (rows.column(k).to_numpy() for k in (0, 1, 2, 3, 4, 6))
    first = rows.column(7).to_numpy(zero_copy_only=False) if isinstance(rows.column(7), pa.Array) else rows.column(7).combine_chunks().to_numpy(zero_copy_only=False)
    bag = np.frombuffer(b"".join(rows.column(8).to_pylist()), dtype=np.uint8).reshape(n, BINS)
    bands = np.concatenate([c.flatten().to_numpy() for c in rows.column(9).chunks]).reshape(n, -1)
    full = bag[:, 0] == MANY
    fresh = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    group = np.concatenate([[0], np.cumsum(fresh)])
    # a row meets the rows after it in its group, up to the most words that can still be similar
    span = int(words.max()) + 2
    ends = np.searchsorted(group * span + words, group * span + np.minimum((words + 1) / SIMILARITY, span - 1).astype(np.int64), side="right")
    count = np.maximum(ends - np.arange(n) - 1, 0)
    done, start = np.concatenate([[0], np.cumsum(count)]), 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(done, done[start] + AT_ONCE, side="right")) - 1)
        i = np.repeat(np.arange(start, stop), count[start:stop])
        j = i + 1 + np.arange(len(i)) - (done[i] - done[start])
        most = ((1 - SIMILARITY) * np.maximum(words[i], words[j]) + 1e-9).astype(np.int64)
        good = (component[i] != component[j]) & (np.abs(words[i] - words[j]) <= most) & ((low[i] == high[i]) | (block[i] != block[j])) & ~first[i] & ~first[j]
        i, j, most, start = i[good], j[good], most[good], stop
        for k in range(0, len(i), 1 << 13):
            x, y, m = i[k : k + (1 << 13)], j[k : k + (1 << 13)], most[k : k + (1 << 13)]
            ok = full[x] | full[y] | (np.maximum(words[x], words[y]) - np.minimum(bag[x], bag[y]).sum(1, dtype=np.int64) <= m)
            x, y = x[ok], y[ok]
            met = bands[x, (bands[x] == bands[y]).argmax(1)] == bucket[x]
            if met.any():
                yield x[met], y[met]


def by_group(batches, each):
    """Calls each(table) with whole groups (bucket, low, high) of rows that come sorted by them."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        keys = [rows.column(k).to_numpy() for k in range(3)]
        fresh = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        last = int(fresh[-1]) + 1 if len(fresh) else 0
        if last:
            yield from each(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield from each(held)


def unlinked(met: DataFrame, parts: DataFrame, own: DataFrame, packs: DataFrame) -> DataFrame:
    """(a, b): links between members (rep, words, bucket, leader) of a bucket whose components differ so far.

    parts: (node, component); own: (rep, bag, bands). Every block of a bucket meets itself and each other one. Members that
    have a pair to align are found by their numbers alone; only they are sent their texts, and they are aligned where they
    stand, so that no pair is ever a row.
    """
    members = met.select("rep", "words", "bucket", (F.col("rep") == F.col("leader")).alias("first")).join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    many = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("x <> y")
    rows = members.join(many.select("bucket", "blocks"), "bucket").join(own, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).select(*MEMBER)
    keys = ["bucket", "low", "high"]

    def involved(table):
        found = np.zeros(table.num_rows, dtype=bool)
        for x, y in open_pairs(table):
            found[x] = found[y] = True
        if found.any():
            yield from table.filter(pa.array(found)).to_batches()

    def align(table):
        press, root, texts = zstandard.ZstdDecompressor(), {}, table.column(len(MEMBER))
        rep = table.column(5).to_numpy()

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in open_pairs(table):
            last, leader, left, right = -1, None, [], []
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                a, b = find(rep[i]), find(rep[j])
                if a == b:
                    continue
                if i != last:
                    last, leader = i, Leader(press.decompress(texts[i].as_py()))
                if leader.similar(press.decompress(texts[j].as_py())):
                    root[max(a, b)] = min(a, b)
                    left.append(rep[i])
                    right.append(rep[j])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    wanted = cut(rows.repartition(*keys).sortWithinPartitions(*keys, "words").mapInArrow(lambda batches: by_group(batches, involved), GROUP))
    small_batches(met.sparkSession)
    sent = wanted.join(packs.withColumnRenamed("id", "rep"), "rep").select(*MEMBER, "pack").repartition(*keys).sortWithinPartitions(*keys, "words")
    return sent.mapInArrow(lambda batches: by_group(batches, align), "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, component_id (the least doc_id of its class) and kept."""
    rows = cut(sketched(documents))
    known = rows.where("doc_id is not null and words > 0")
    classes = cut(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min("words").alias("words"), F.min("bag").alias("bag")))
    members = classes.select("rep", "words", F.explode("bands").alias("bucket"))
    small_batches(documents.sparkSession, NUMBERS)
    met = cut(met_in(members))
    small_batches(documents.sparkSession)
    packs = cut(texts_of(met.select("rep"), packed(documents)))
    pairs = met.where("leader <> rep").where(fits("words", "leader_words")).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = cut(verified(pairs, packs))
    parts = cut(components(first))
    second = cut(unlinked(met, parts, classes.select("rep", "bag", "bands"), packs))
    free(met, packs, first)
    parts = components(second.union(parts.where("node <> component")))
    whole = classes.select("key", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component"))
    # rows that share an id share a class, whatever their texts
    found = rows.select("doc_id", "key", "words").join(whole, "key", "left")
    own = F.when(F.col("words") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents of which doc_id is the least of its class; the columns stay as they are, whatever their names.

    Of rows that repeat an id one stays. Rows with a null id stay, and so do texts without words (null, empty, blank), each
    a class of its own. An empty table stays empty.
    """
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = near_duplicates(documents).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = rows.join(kept.withColumnRenamed("doc_id", "id"), "id")
    # ids that repeat, as a rule none: one row of each
    many = found.where("n > 1").dropDuplicates(["id"])
    return found.where("n = 1").select("row").unionByName(many.select("row")).unionByName(rows.where("id is null").select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
