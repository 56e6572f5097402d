"""Personal data: base patterns, and a linear-chain CRF over word shapes that adds disguised forms.

Null texts are empty. Every text is searched whole; offsets are code points. A CRF span is added only if it does not
overlap a base span of its kind and its characters pass the kind's own test (digit counts, Luhn, octets, a domain).
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_class, read, rows_at, small_batches, utf8

# The kinds in order, and the base pattern of each.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
TRIGGER = byte_class("0123456789@+([")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The weight of every label but O on a plain word.
HELD = -60.0
#: Padded window cells that one Viterbi call holds at most.
CELLS = 1 << 18


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[0::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def octets(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p and len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in parts)


def accepted(kind: str, found: str) -> bool:
    """Whether a base match counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return octets(found.split("."))
    digits = re.sub(r"[^0-9]", "", found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that begins within a run of digits needs what the one at the run's start needs.
IP_RUN = re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)


def emails(text: str):
    """The matches of the email pattern, found from each @: in time that grows with the text alone."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    for k, kind in enumerate(KINDS[1:], 1):
        pattern = IP_RUN if kind == "ip" else PATTERNS[kind]
        found += [(k, m.start(), m.end()) for m in pattern.finditer(text) if accepted(kind, m[0])]
    return found


# ---- the CRF ---------------------------------------------------------------------------------------------------------

PLAIN = "plain"


def shape(word: str) -> str:
    """A word's shape: letter runs as x, digit runs as a code of their length, other ASCII signs as they are."""
    return known_shape(word) if len(word) <= 64 else shape_of(word)


@lru_cache(maxsize=1 << 16)
def known_shape(word: str) -> str:
    return shape_of(word)


def shape_of(word: str) -> str:
    core = word.rstrip(".,;:!?")
    if not any(c in "0123456789@+([" for c in core):
        return PLAIN
    out = re.sub(r"[^\W\d_]+", "x", core)
    out = re.sub(r"[0-9]+", lambda m: "d" if len(m[0]) < 4 else "D" if len(m[0]) == 4 else "N" if len(m[0]) < 13 else "M", out)
    return re.sub(r"[^\x21-\x7e]+", "#", out)


JOINERS = {"(at)", "[at]", "(dot)", "[dot]"}


def shapes_of(words: list[str]) -> list[str]:
    """The shapes of a sentence's words; a plain word beside a written-out @ or dot has a shape of its own."""
    forms = [shape(w) for w in words]
    for i, w in enumerate(words):
        if forms[i] != PLAIN and w.lower().rstrip(".,;:!?") in JOINERS:
            for j in (i - 1, i + 1):
                if 0 <= j < len(words) and forms[j] == PLAIN:
                    forms[j] = "joined"
    return forms


def coarse(form: str) -> str:
    """The class in which a neighbour sees a shape."""
    if form == PLAIN:
        return PLAIN
    return "at" if "@" in form or "(x)" in form or "[x]" in form else "number" if "x" not in form and any(c in "dDNM" for c in form) else "mixed"


CLASSES = (PLAIN, "at", "number", "mixed")


def labelled_table(rows: int = 800, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The training sentences: invented words around written-out forms of each kind, and numbers that are none."""
    rng = random.Random(seed)
    syllables = "ba ko ri ten mu sol ve dar lin qu as er on".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    octet = lambda: str(rng.randint(0, 255))

    def entity(kind: str) -> str:
        if kind == "email":
            at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), ("[at]", ".")])
            return f"{word()}{rng.choice(['', n(2), '.' + word()])}{at}{word()}{rng.choice(['', n(1)])}{dot}{rng.choice(['com', 'org', 'net'])}"
        if kind == "ip":
            return rng.choice([".", "[.]", "(.)"]).join(octet() for _ in range(4))
        if kind == "card":
            return rng.choice(["", " ", "-", ".", "/"]).join(n(4) for _ in range(4))
        return rng.choice([f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(4)} {n(3)}", f"({n(3)}){n(3)}-{n(4)}"])

    def other() -> str:
        return rng.choice([n(1), n(2), n(3), n(4), n(5), n(6), n(8), f"{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{n(4)}-{n(2)}-{n(2)}", f"({n(4)})", f"[{n(1)}]", f"{n(2)}:{n(2)}", f"({word()})", f"{word()}{n(2)}", f"{n(12)}a{n(3)}", f"{word()}({n(1)})", f"+{n(1)}", f"{n(2)}%"])

    table = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 4)):
                words.append(word() + rng.choice(["", "", "", ",", "."]))
                labels.append("O")
            kind = rng.choice([*KINDS, "other", "other"])
            parts = (other() if kind == "other" else entity(kind)).split(" ")
            words += [*parts[:-1], parts[-1] + rng.choice(["", "", ".", ","])]
            labels += ["O"] * len(parts) if kind == "other" else [f"B-{kind}", *[f"I-{kind}"] * (len(parts) - 1)]
        table.append((words, labels))
    return table


class Crf:
    """Emission weights by own shape and by the neighbours' classes, and label transitions."""

    def __init__(self, shapes: dict[str, int], own: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray):
        self.shapes, self.own, self.before, self.after, self.move = shapes, own, before, after, move

    def emissions(self, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.own[own] + self.before[before] + self.after[after]

    def plain_is_o(self) -> bool:
        """Whether O beats every other label on a plain word by more than the transitions around it can win back.

        Then a plain word is O in every best path, whatever stands beside it, and the chain can be decoded in the
        windows between plain words without changing any label.
        """
        plain = self.own[self.shapes[PLAIN]]
        lead = (plain[0] - plain[1:]) + (self.before[:, :1] - self.before[:, 1:]).min(0) + (self.after[:, :1] - self.after[:, 1:]).min(0)
        return bool(lead.min() > 2 * (self.move.max() - self.move.min()))

    def codes(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Shape and neighbour-class codes; a shape not met in training has code 0."""
        return np.array([self.shapes.get(f, 0) for f in forms]), np.array([CLASSES.index(coarse(f)) for f in forms])

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label paths of a padded batch [windows, words, labels]."""
        rows, steps, _ = scores.shape
        best, back = scores[:, 0], np.zeros(scores.shape, dtype=np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + self.move
            back[:, t] = through.argmax(1)
            best = np.where((t < lengths)[:, None], through.max(1) + scores[:, t], best)
        path, at = np.zeros((rows, steps), dtype=np.int8), best.argmax(1)
        for t in range(steps - 1, -1, -1):
            live = t < lengths
            path[live, t] = at[live]
            if t:
                at = np.where(live, back[np.arange(rows), t, at], at)
        return path


@lru_cache(maxsize=1)
def trained(steps: int = 60) -> Crf:
    """Maximum-likelihood weights on labelled_table(), by forward-backward and Adam. A fixed seed: reruns agree.

    A plain word (no digit, @, bracket or plus) cannot be part of a span: its weights are held at HELD, not learned.
    """
    table = labelled_table()
    shapes = {"": 0, PLAIN: 1}
    for words, _ in table:
        for form in shapes_of(words):
            shapes.setdefault(form, len(shapes))
    model = Crf(shapes, np.zeros((len(shapes), len(LABELS))), np.zeros((len(CLASSES), len(LABELS))), np.zeros((len(CLASSES), len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    rows, steps_t, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    own, near, gold = np.zeros((rows, steps_t), int), np.zeros((rows, steps_t + 2), int), np.zeros((rows, steps_t), int)
    mask = np.zeros((rows, steps_t))
    for i, (words, labels) in enumerate(table):
        a, b = model.codes(shapes_of(words))
        own[i, : len(a)], near[i, 1 : len(b) + 1], gold[i, : len(a)], mask[i, : len(a)] = a, b, [LABELS.index(x) for x in labels], 1
    before, after = near[:, :-2], near[:, 2:]
    model.own[shapes[PLAIN], 1:] = HELD
    moments = [np.zeros_like(p) for p in (model.own, model.before, model.after, model.move) for _ in "mv"]
    for step in range(1, steps + 1):
        e, live = model.emissions(own, before, after), mask[:, :, None] > 0
        peak = model.move.max()
        m = np.exp(model.move - peak)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps_t):
            top = alpha[:, t - 1].max(1, keepdims=True)
            alpha[:, t] = np.where(live[:, t], e[:, t] + np.log(np.exp(alpha[:, t - 1] - top) @ m) + top + peak, alpha[:, t - 1])
        for t in range(steps_t - 2, -1, -1):
            x = beta[:, t + 1] + e[:, t + 1]
            top = x.max(1, keepdims=True)
            beta[:, t] = np.where(live[:, t + 1], np.log(np.exp(x - top) @ m.T) + top + peak, 0)
        total = np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(1, keepdims=True)).sum(1)) + alpha[:, -1].max(1)
        p = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * mask[:, :, None]
        move = np.zeros((k, k))
        for t in range(1, steps_t):
            on = mask[:, t] > 0
            pair = alpha[on, t - 1][:, :, None] + model.move + (e[on, t] + beta[on, t])[:, None, :] - total[on, None, None]
            move -= np.exp(np.minimum(pair, 0)).sum(0)
            np.add.at(move, (gold[on, t - 1], gold[on, t]), 1)
        error = -p
        error[np.arange(rows)[:, None], np.arange(steps_t), gold] += mask
        flat = error.reshape(-1, k)
        for j, (name, codes) in enumerate((("own", own), ("before", before), ("after", after), ("move", None))):
            weights = getattr(model, name)
            if codes is None:
                grad = move
            else:
                grad = np.zeros_like(weights)
                np.add.at(grad, codes.ravel(), flat)
            grad = grad / rows - 1e-3 * weights * (3 if name == "move" else 0.1)
            if name == "own":
                grad[shapes[PLAIN]] = 0
            moments[2 * j] = 0.9 * moments[2 * j] + 0.1 * grad
            moments[2 * j + 1] = 0.99 * moments[2 * j + 1] + 0.01 * grad**2
            weights += 0.15 * (moments[2 * j] / (1 - 0.9**step)) / (np.sqrt(moments[2 * j + 1] / (1 - 0.99**step)) + 1e-8)
    return model


AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?", re.I)
DOT = re.compile(r"\x20?(?:\.|\(dot\)|\[dot\])\x20?", re.I)


def plausible(kind: str, found: str) -> bool:
    """The test of a kind on the characters of a CRF span."""
    if kind == "email":
        parts = AT.split(found)
        return len(parts) == 2 and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", parts[0])) and len(d := DOT.split(parts[1])) > 1 and all(re.fullmatch(r"[A-Za-z0-9-]+", x) for x in d)
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return octets(re.split(r"\[\.\]|\(\.\)|\.", found))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9][0-9\x20./-]*[0-9]", found)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9().\x20-]*[0-9]", found)) and re.search(r"[().-]|^\+", found) is not None and 9 <= len(digits) <= 15


def windows(text: str, model: Crf, certified: bool) -> list[tuple[list[re.Match], list[str]]]:
    """The stretches of words to decode: runs without plain words, each with the plain word on either side."""
    words = list(TOKEN.finditer(text))
    forms = shapes_of([m[0] for m in words])
    if not certified:
        return [(words, forms)] if words else []
    odd = np.flatnonzero(np.array([f != PLAIN for f in forms], dtype=bool))
    out = []
    for run in np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1) if len(odd) else []:
        a, b = max(int(run[0]) - 1, 0), min(int(run[-1]) + 2, len(words))
        out.append((words[a:b], forms[a:b]))
    return out


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the CRF finds in each text, decoded in padded batches of like length."""
    certified, out = model.plain_is_o(), [[] for _ in texts]
    todo = sorted(((i, *w) for i, t in enumerate(texts) for w in windows(t, model, certified)), key=lambda x: len(x[1]))
    while todo:
        size = len(todo[-1][1])
        take, todo = todo[-max(1, CELLS // (size * len(LABELS))) :], todo[: -max(1, CELLS // (size * len(LABELS)))]
        lengths = np.array([len(x[1]) for x in take])
        own, near = np.zeros((len(take), size), int), np.zeros((len(take), size + 2), int)
        for r, (_, _, forms) in enumerate(take):
            a, b = model.codes(forms)
            own[r, : len(a)], near[r, 1 : len(b) + 1] = a, b
        paths = model.viterbi(model.emissions(own, near[:, :-2], near[:, 2:]), lengths)
        for (i, words, _), path in zip(take, paths, strict=True):
            at = 0
            while at < len(words):
                if path[at] % 2 == 0:  # O, or I without its B
                    at += 1
                    continue
                kind, end = (path[at] - 1) // 2, at + 1
                while end < len(words) and path[end] == path[at] + 1:
                    end += 1
                last = words[end - 1]
                span = (int(kind), words[at].start(), last.start() + len(last[0].rstrip(".,;:!?")))
                if plausible(KINDS[kind], texts[i][span[1] : span[2]]):
                    out[i].append(span)
                at = end
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
NOTHING = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def find(documents: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans. Extra columns are ignored."""
    spark = documents.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = [NOTHING] * batch.num_rows
            hit = rows_at(offsets, np.flatnonzero(TRIGGER[data]))
            texts = batch.column(1).take(pa.array(hit)).to_pylist() if len(hit) else []
            for i, text, more in zip(hit, texts, crf_spans(texts, model.value), strict=True):
                base = base_spans(text)
                more = [s for s in more if not any(k == s[0] and a < s[2] and s[1] < b for k, a, b in base)]
                rows[i] = (*(sum(k == n for k, _, _ in base) for n in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return documents.select(documents.doc_id.cast("long"), documents.text.cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))
