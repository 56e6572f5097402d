"""SentencePiece encoding and decoding over a relational lattice.

A text is a row of units that no piece crosses (a run of blanks with the letters or the other signs after it). Each
distinct unit is looked up once: its substrings of up to the longest piece are exploded and equi-joined to the piece
table, the matches are the lattice's edges, and they are grouped by unit again. A unit's edges are then folded with the
higher-order function aggregate. The fold follows the model's kind: the public vocabulary is a BPE model, whose pieces
are merged by rank, so an edge is taken, best rank first, if both its ends are still boundaries with exactly one
boundary between them; the state is a bit mask of boundaries. (Viterbi over its rank scores is what a unigram model
needs; on this vocabulary it gives other pieces than the model's own encoder for 42 % of the words.)

Units that a bit mask cannot hold (over WIDEST characters), that start with several blanks, or in which taking an edge
made room for an edge of better rank, are encoded by the library, which gives the same pieces; n_library counts them.

Null and empty texts have no ids. U+2581 in a text reads as a blank, as in the library. Decoding is exact for every
text without it. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, utf8

#: Blanks with the letters, or with the other signs, after them; piece_table() makes sure that no piece crosses units.
UNIT = re.compile(r" *[^\W\d_²³¹¼½¾]+| *(?:[^\w ]|[\d_²³¹¼½¾])+| +")
BLANK = "▁"
WIDEST = 60
#: Rows of a task that share one table of units.
CHUNK = 8192


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def ordinary(sp) -> list[tuple[int, str]]:
    """(id, piece) of the pieces that stand for characters, blanks as blanks."""
    return [(i, sp.id_to_piece(i).replace(BLANK, " ")) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


class Coder:
    """Ids of a unit from its boundaries, and bytes of an id."""

    def __init__(self, model: bytes):
        self.sp = processor(model)
        self.ids = {p: i for i, p in ordinary(self.sp)}
        self.bytes = [b""] * self.sp.get_piece_size()
        self.byte_ids, self.has_byte = [0] * 256, np.zeros(256, dtype=bool)
        for i, p in ordinary(self.sp):
            self.bytes[i] = p.encode()
        for i in range(len(self.bytes)):
            if self.sp.is_byte(i):
                value = int(self.sp.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte_ids[value], self.has_byte[value] = bytes([value]), i, True
        self.pieces, self.piece_ids = pa.array(self.ids.keys(), pa.large_string()), np.fromiter(self.ids.values(), dtype=np.int32)

    def spelled(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def from_masks(self, units: pa.Array, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of units that are not empty, from their boundaries: laid end to end, how many each has, which do not decode to it."""
        data, offsets = utf8(units)
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        owner = np.searchsorted(offsets, begins, side="right") - 1
        size = np.bincount(owner, minlength=len(units))
        nth = np.arange(len(begins)) - np.repeat(np.cumsum(size) - size, size)
        cut = (masks[owner] >> nth & 1).astype(bool)
        start, owner = begins[cut], owner[cut]
        bounds = np.append(start, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(data.tobytes()))
        place = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()
        # a piece that the model lacks is spelled byte by byte
        many = np.where(place < 0, np.diff(bounds), 1)
        first = np.cumsum(many) - many
        ids = np.empty(int(many.sum()), dtype=np.int32)
        ids[first[place >= 0]] = self.piece_ids[place[place >= 0]]
        spelled = np.flatnonzero(place < 0)
        step = np.arange(int(many[spelled].sum())) - np.repeat(np.cumsum(many[spelled]) - many[spelled], many[spelled])
        byte = data[np.repeat(start[spelled], many[spelled]) + step]
        ids[np.repeat(first[spelled], many[spelled]) + step] = np.array(self.byte_ids, dtype=np.int32)[byte]
        wrong = np.zeros(len(units), dtype=bool)
        wrong[np.repeat(owner[spelled], many[spelled])[~self.has_byte[byte]]] = True
        return ids, np.bincount(owner, weights=many, minlength=len(units)).astype(np.int64), wrong

    def by_library(self, unit: str) -> list[int]:
        """The library puts a blank before every text; a text of that blank alone makes it visible where it is not wanted."""
        if unit[0] == " ":
            return self.sp.encode(unit[1:]) if len(unit) > 1 else self.spelled(unit)
        ids = self.sp.encode("\n" + unit)  # blank, newline (a byte that no piece merges with), unit
        return ids[len(self.sp.encode("\n")) :]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def piece_table(spark: SparkSession, model: bytes) -> DataFrame:
    """(piece, rank) of the pieces of two characters or more, and the empty one (-1); a vocabulary file bounds its size."""
    sp = processor(model)
    rows = [(p, sp.get_score(i)) for i, p in ordinary(sp) if len(p) > 1]
    for _, p in ordinary(sp):
        if len(UNIT.findall(p)) > 1:
            raise ValueError(f"piece {p!r} crosses units")
    ranks = {s: k for k, s in enumerate(sorted({s for _, s in rows}, reverse=True))}
    return spark.createDataFrame([("", -1), *((p, ranks[s]) for p, s in rows)], "piece string, rank long")


def lattice(distinct: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, mask) for a table of distinct units, dealt by unit: explode, equi-join, group, fold."""
    n = F.length("unit")
    spans = distinct.select("unit", F.explode(F.sequence(F.lit(0), n - 2)).alias("start"))
    sizes = F.sequence(F.lit(2), F.least(F.lit(longest), n - F.col("start")))
    # the empty piece at the start keeps units in which no piece stands
    spans = spans.select("unit", "start", F.explode(F.when(F.col("start") == 0, F.concat(F.array(F.lit(0)), sizes)).otherwise(sizes)).alias("size"))
    spans = spans.withColumn("piece", F.expr("substring(unit, start + 1, size)"))
    packed = F.col("rank") * 65536 + F.col("start") * 256 + F.col("size")
    edges = spans.join(F.broadcast(pieces), "piece").groupBy("unit").agg(F.sort_array(F.collect_list(packed)).alias("edges"))

    # the folds are interpreted, so their expressions are kept short; the empty piece's edge is never open
    def at(edge):
        return F.shiftright(edge, 8).bitwiseAND(255).cast("int")

    def power(base, edge):
        return F.call_function("shiftleft", F.lit(base).cast("long"), edge.bitwiseAND(255).cast("int"))

    def within(mask, edge):
        """The boundaries from an edge's start to its end, shifted down to the start."""
        return F.call_function("shiftright", mask, at(edge)).bitwiseAND(power(2, edge) - 1)

    def open_(mask, edge):
        ends = power(1, edge) + 1
        return (F.bit_count(within(mask, edge)) == 3) & (within(mask, edge).bitwiseAND(ends) == ends)

    def take(mask, edge):
        between = F.call_function("shiftleft", within(mask, edge).bitwiseXOR(power(1, edge) + 1), at(edge))
        return F.when(open_(mask, edge), mask.bitwiseXOR(between)).otherwise(mask)

    first = F.pow(F.lit(2.0), F.length("unit") + 1).cast("long") - 1
    folded = edges.select("unit", "edges", F.aggregate("edges", first, take).alias("mask"))
    late = F.exists("edges", lambda e: open_(F.col("mask"), e))
    return folded.select("unit", F.when(late, F.lit(None)).otherwise(F.col("mask")).alias("mask"))


class Texts:
    """The rows of an Arrow column cut into units: the distinct units, the place of each unit among them, the rows' ends."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.n_chars = pc.utf8_length(column).to_numpy().astype(np.int64)
        # a blank goes before every text that is not empty, and U+2581 reads as a blank
        shown = pc.replace_substring(column, BLANK, " ")
        one, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        shown = pc.if_else(pc.equal(column, none), none, pc.binary_join_element_wise(one, shown, none))
        self.plain = pc.invert(pc.match_substring(column, BLANK)).to_numpy(zero_copy_only=False)
        data, offsets = utf8(shown)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kind = kinds()[code]
        begins = np.ones(len(code), dtype=bool)
        # a unit begins where blanks do, and where the kind of sign changes without a blank between
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        row_starts = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
        begins[row_starts] = True
        starts = at[begins]
        bounds = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data.tobytes()))
        coded = units.dictionary_encode()
        self.distinct, self.place = coded.dictionary, coded.indices.to_numpy()
        self.ends = np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point in UNIT: 0 blank, 1 letter, 2 any other sign."""
    out = np.full(0x110000, 2, dtype=np.uint8)
    signs = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    letters = re.compile(r"[^\W\d_²³¹¼½¾]+")
    for m in letters.finditer(signs):
        out[[ord(c) for c in m[0]]] = 1
    out[ord(" ")] = 0
    return out


def regular_ones(units: pa.Array) -> pa.Array:
    """The units that the lattice handles."""
    size = pc.utf8_length(units)
    keep = pc.and_(pc.and_(pc.greater(size, 1), pc.less_equal(size, WIDEST)), pc.invert(pc.starts_with(units, "  ")))
    return units.filter(keep)


SCHEMA = "doc_id long, n_chars long, n_ids long, n_library long, ids array<int>, exact boolean"
#: Bytes of text that travel as one blob, and units that do.
BLOB, BLOB_UNITS = 1 << 20, 1 << 16
DEALT = "place long, kind byte, data binary"


def blob(*columns: pa.Array) -> bytes:
    """Columns as compressed Arrow bytes."""
    batch = pa.RecordBatch.from_arrays(list(columns), names=[str(k) for k in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def unblob(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


class Spelled:
    """The ids of a place's units: those with boundaries at once, each other one when a text has it first."""

    def __init__(self, coder: Coder, held: list[pa.RecordBatch]):
        self.coder = coder
        whole = pa.Table.from_batches(held).drop_null().combine_chunks() if held else None
        units = whole.column(0).combine_chunks() if held else pa.array([], pa.string())
        self.ids, self.size, self.wrong = coder.from_masks(units, whole.column(1).to_numpy() if held else np.zeros(0, np.int64))
        self.start = np.cumsum(self.size) - self.size
        self.by_library = np.zeros(len(units), dtype=bool)
        self.at = dict(zip(units.to_pylist(), range(len(units)), strict=True))

    def places(self, names: list[str]) -> np.ndarray:
        """The numbers of units in the tables here, which take up those that they lack."""
        new = [u for u in names if u not in self.at]
        if new:
            found = [self.coder.by_library(u) if len(u) > 1 else self.coder.spelled(u) for u in new]
            size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.at.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), dtype=np.int32))
            self.wrong = np.append(self.wrong, [b"".join([self.coder.bytes[i] for i in x]) != u.encode() for u, x in zip(new, found, strict=True)])
            self.by_library = np.append(self.by_library, [len(u) > 1 for u in new])
        return np.fromiter(map(self.at.__getitem__, names), dtype=np.int64, count=len(names))


def encode(documents: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row per document: the ids of its whole text, whether they decode to it again, and how many units came from the library.

    Every task cuts its rows into places of CHUNK rows. The distinct units of each place go to the lattice, dealt by
    unit, and come back to the place with their boundaries, many to a blob; the texts go to the place too, many to a
    blob, and are put together there. Where a second reading of the input deals rows otherwise than the first one, units
    without boundaries go to the library, and n_library counts them.
    """
    spark = documents.sparkSession
    small_batches(spark, 4096)
    with open(model_file or default_model(), "rb") as f:
        model = f.read()
    shared = spark.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def placed(batches):
        """(place, batch): the rows in stretches that end where a place does."""
        part, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, CHUNK - seen % CHUNK)
                yield part + seen // CHUNK, batch.slice(at, take)
                at, seen = at + take, seen + take

    def distinct_units(batches):
        """(place, unit): the distinct units of each place."""

        def out(place, held):
            found = pa.chunked_array(held).unique()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), place), pa.int64()), found.cast(pa.string())], names=["place", "unit"])

        held, now, size = [], None, 0
        for place, batch in placed(batches):
            if held and (place != now or size > BLOB_UNITS * 16):
                yield out(now, held)
                held, size = [], 0
            now = place
            held.append(regular_ones(Texts(batch.column(1)).distinct))
            size += len(held[-1])
        if held:
            yield out(now, held)

    def packs(batches):
        """(place, kind, data): doc_ids and texts of stretches of rows."""
        for place, batch in placed(batches):
            text = batch.column(1).cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy())
            cuts = np.append(np.unique(np.searchsorted(size, np.arange(0, (size[-1] if len(size) else 0) + 1, BLOB), side="left")), batch.num_rows)
            cuts = np.unique(np.concatenate([[0], cuts]))
            out = [blob(batch.column(0).slice(a, b - a), text.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for data in out:
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([1], pa.int8()), pa.array([data], pa.binary())], names=["place", "kind", "data"])

    def bundles(batches):
        """(place, kind, data): units with their masks, from rows sorted by place; a place has a blob in each task."""
        held, size = [], 0

        def out():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            place = whole.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            data = [blob(whole.column(1).slice(a, b - a), whole.column(2).slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(place[cuts[:-1]]), pa.array(np.zeros(len(data), np.int8)), pa.array(data, pa.binary())], names=["place", "kind", "data"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOB_UNITS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(distinct_units, "place long, unit string").repartition(n, "unit")
    # the least place is taken, and looked at, so that both uses of dealt read the same columns and share one exchange
    distinct = dealt.groupBy("unit").agg(F.min("place").alias("first")).where("first >= 0").select("unit")
    pieces = piece_table(spark, model)
    longest = max(len(p) for _, p in ordinary(processor(model)))
    masks = lattice(distinct, pieces, longest)
    found = dealt.join(masks, "unit").select("place", "unit", "mask").sortWithinPartitions("place").mapInArrow(bundles, DEALT)
    # the texts come first in the union, so that their tasks keep the numbers that they had above
    together = rows.mapInArrow(packs, DEALT).unionByName(found).repartition(n, "place").sortWithinPartitions("place", "kind")

    def run(batches):
        coder = Coder(shared.value)
        at, held, table = None, [], None
        for batch in batches:
            for place, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    at, held, table = place, [], None
                if kind == 0:
                    held.append(unblob(data))
                    continue
                table = table or Spelled(coder, held)
                packed = unblob(data)
                texts = Texts(packed.column(1))
                unit = table.places(texts.distinct.to_pylist())
                size, wrong, by_library = table.size[unit], table.wrong[unit], table.by_library[unit]
                start = table.start[unit]
                many = size[texts.place]
                ends = np.concatenate([[0], np.cumsum(many)])
                ids = table.ids[np.repeat(start[texts.place] - ends[:-1], many) + np.arange(ends[-1])] if len(many) else np.zeros(0, np.int32)
                bounds = ends[texts.ends]
                count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[texts.place])])[texts.ends])
                exact = texts.plain & (count(wrong) == 0)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([packed.column(0), pa.array(texts.n_chars), pa.array(np.diff(bounds)), pa.array(count(by_library).astype(np.int64)), lists, pa.array(exact)], names=["doc_id", "n_chars", "n_ids", "n_library", "ids", "exact"])

    return together.mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids; null ids give a null text."""
    spark = encoded.sparkSession
    small_batches(spark)
    with open(model_file or default_model(), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
