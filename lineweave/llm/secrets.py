"""Secrets: base patterns, and strings near sensitive words that a primed zstandard dictionary cannot compress.

Null texts are empty; every text is searched whole; offsets are code points. A candidate outside the base spans counts
as a secret of kind assign when a sensitive word stands shortly before it and its marginal cost (bytes that it adds
to the compressed text around it, with a dictionary of code and identifier words) is at least NOVELTY of its length.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import byte_class, read, rows_at, small_batches, utf8

# The kinds in order, the base pattern of each, and the least length that counts.
KINDS = ("assign", "access", "hex")
PATTERNS = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
)
LEAST = (12, 18, 16)
BASE_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make a context sensitive beyond the base ones.
CONTEXT_WORDS = (b"pwd", b"passphrase", b"credential", b"bearer", b"authorization", b"private_key", b"private key", b"access_key", b"access key", b"auth_key", b"client_secret", b"signing_key")
CONTEXT = re.compile("|".join(re.escape(w.decode()) for w in (*BASE_WORDS, *CONTEXT_WORDS)), re.IGNORECASE | re.ASCII)
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters between a sensitive word's end and a candidate, at most; characters of context on either side.
REACH, AROUND = 24, 96
#: Compressed bytes a character that ordinary identifiers stay below and random strings exceed.
NOVELTY = 0.62
HEX = byte_class("0123456789abcdef")

# Words of programs from which the dictionary is primed.
IDENTIFIERS = """
abstract access account address algorithm alias application argument array assert async attribute authentication authorization backend
balance base64 bearer boolean branch broadcast buffer builder bytes cache callback catch certificate channel character class cleanup
client close cluster collection column command commit component configuration connection const constructor container content context
controller cookie counter create credential currency current customer cursor database dataset debug declare decode default define delete
dependency description destination development dictionary directory dispatch document domain double download duplicate element else
email encode encrypt endpoint engine entity enumerate environment error event example exception execute export expression extension
factory false field filename filter final finally float format function generate global handler hashmap header hidden hostname identifier
ignore implement import include index information initialize input insert instance integer interface internal invalid iterator javascript
json key kubernetes label lambda language length library license limit listener local location logger login lookup manager mapping
master maximum message metadata method minimum module mutable namespace native network notification null number object offset operation
option order organization output package parameter parent parse partition password path pattern payload permission pipeline placeholder
platform pointer policy position prefix previous primary private process production profile project property protected protocol provider
public publish query queue random readonly receive record redirect reference refresh register release remote remove render replace
request require reset resource response result return revision router runtime sample schedule schema scope search secret section
security select sequence serialize server service session setting shared signature signing snapshot source sqlite stack standard state
statement static status storage stream string struct subject submit success suffix support switch symbol synchronized system table
target template temporary terminal test thread throw timeout timestamp token topic transaction transform translate trigger true tuple
type undefined unique update upload username utf validate value variable vector verify version virtual visible void volatile warning
while widget window workspace wrapper write xml yaml your_api_key_here changeme example_token my_secret_value test_password
"""


@lru_cache(maxsize=1)
def primer() -> zstandard.ZstdCompressionDict:
    words = IDENTIFIERS.split()
    forms = " ".join(f"{a}_{b} {a}{b.title()} {a.upper()}_{b.upper()}" for a, b in zip(words, words[7:] + words[:7], strict=True))
    return zstandard.ZstdCompressionDict(f"{forms} {' '.join(words)} 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@lru_cache(maxsize=1)
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, dict_data=primer(), write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that text[start:end] adds to its compressed surroundings, a character."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    cost = lambda t: len(compressor().compress(t.encode("utf-8", "replace")))
    return (cost(before + after + " " + text[start:end]) - cost(before + after + " ")) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if len(m[2] if k == 0 else m[0]) >= LEAST[k]]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that no base span touches and that do not compress."""
    out, done, k = [], 0, 0
    # both lists are in text order, so one walk along them meets every word with the runs within its reach
    words = [w.end() for w in CONTEXT.finditer(text)]
    runs = [m.span() for m in CANDIDATE.finditer(text)] if words else []
    base, first = sorted((a, b) for a, _, b in base), 0
    for end in words:
        while k < len(runs) and max(runs[k][0], end, done) <= end + REACH:
            start, stop = max(runs[k][0], end, done), runs[k][1]
            k += 1
            if stop - start < SHORTEST:
                continue  # what later words leave of it is shorter still
            done, value = stop, text[start:stop]
            mixed = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]")) >= 2
            while first < len(base) and base[first][1] <= start:
                first += 1
            at, touched = first, False
            while at < len(base) and base[at][0] < stop and not touched:
                touched, at = base[at][1] > start, at + 1
            if mixed and not touched and novelty(text, start, stop) >= NOVELTY:
                out.append((start, 0, stop))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def rows_to_search(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows that may hold a span: 16 hex digits cover an aligned block of 8, the other kinds a fixed word."""
    blocks = len(data) // 8
    full = (HEX[data[: blocks * 8]].reshape(blocks, 8)).view(np.uint64).ravel() == np.uint64(0x0101010101010101)
    at = [np.flatnonzero(full) * 8, np.flatnonzero(full) * 8 + 7]
    raw = data.tobytes()
    lower = raw.lower()
    for word, where in [(b"AKIA", raw), *((w, lower) for w in (*BASE_WORDS, *CONTEXT_WORDS))]:
        found, p = [], where.find(word)
        while p >= 0:
            found.append(p)
            p = where.find(word, p + 1)
        at.append(np.array(found, dtype=np.int64))
    return rows_at(offsets, np.concatenate(at))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
NOTHING = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def scan_texts(column: pa.Array) -> list[tuple]:
    """(n_assign, n_access, n_hex, base_sha256, spans) of each text of an Arrow column."""
    data, offsets = utf8(column)
    rows = [NOTHING] * len(column)
    hit = rows_to_search(data, offsets) if len(data) else np.zeros(0, int)
    for i, text in zip(hit, column.take(pa.array(hit)).to_pylist() if len(hit) else [], strict=True):
        base = base_spans(text)
        rows[i] = (*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(written(base).encode()).hexdigest(), written(base + novel_spans(text, base)))
    return rows


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans. Extra columns are ignored."""
    small_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            columns = list(zip(*scan_texts(batch.column(1)), strict=True)) if batch.num_rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.select(documents.doc_id.cast("long"), documents.text.cast("string")).mapInArrow(run, SCHEMA)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every secret's characters replaced by one asterisk each; the other columns stay."""
    small_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, row in enumerate(scan_texts(batch.column(at))):
                for span in filter(None, row[-1].split(",")):
                    _, a, b = span.split(":")
                    texts[i] = texts[i][: int(a)] + "*" * (int(b) - int(a)) + texts[i][int(b) :]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
