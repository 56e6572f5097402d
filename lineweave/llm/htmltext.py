"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of text runs and tags. Words score by where they stand (an article, plain page, a link, or a
menu-like element) and tags score below zero; the weights are log-odds from labelled pages. One linear scan finds the
contiguous region with the highest sum; its blocks outside menu-like elements are the text.

Null and empty pages give the empty text. Markup that never ends (a comment, a script, a cut-off tag) runs to the end
of the page. Of regions with equal sums the first wins. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^"'<>]|"[^"<]*"|'[^'<]*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

# Element names by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
OUTSIDE = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "head", "button", "select", "fieldset", "label", "title"}
INSIDE = {"article", "main"}
#: Places whose words are no main text wherever the region ends, and how many of a run's words count at most.
DROPPED, OUT_WORDS = {"out", "inset", "beside"}, 2
#: Words in class, id or role that mark an element as menu-like.
BOILER = re.compile(
    r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side-bar|aside|ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|notice|gdpr"
    r"|popup|modal|overlay|comment|comments|commentlist|disqus|discussion|replies|reply|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|breadcrumb|breadcrumbs|pagination|pager|toolbar|widget|complementary|contentinfo|alert|dialog|form)(?:$|[^a-z])"
)
CONTENT = re.compile(r"(?:^|[^a-z])(?:article-body|article-content|post-content|post-body|entry-content|main-content|story-body|articlebody)(?:$|[^a-z])")


def context_of(name: str, tag: str) -> str | None:
    """The landmark that an opening tag makes: in, out or none."""
    if name in OUTSIDE:
        return "out"
    marks = " ".join(re.sub(r"([a-z])([A-Z])", r"\1-\2", m.strip("\"'")) for m in MARKS.findall(tag)).lower() if "=" in tag else ""
    if marks and name not in ("html", "body") and name not in INSIDE:
        if CONTENT.search(marks):
            return "in"
        if BOILER.search(marks):
            return "out"
    return "in" if name in INSIDE else None


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, feature, text) in page order: text runs with their place, and tags with whether they end a block."""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str | None]] = []
    at, links, landmarked = 0, 0, False
    outs = ins = 0
    lower = None

    def text(run: str) -> None:
        if run:
            place = ("inset" if ins else "out") if outs else "in" if ins else "link" if links else "page"
            out.append(("text", place, run))

    def close(to: int) -> None:
        nonlocal outs, ins
        for _, c in stack[to:]:
            outs -= c == "out"
            ins -= c == "in"
        del stack[to:]

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at, tag = m.end(), m[0]
        found = NAME.match(tag)
        if not found:
            continue  # a comment or declaration
        name, inset = found[1].lower(), outs and ins
        if name in RAW:
            if tag[1] != "/" and not tag.endswith("/>"):
                lower = page.lower() if lower is None else lower
                lower = lower if len(lower) == len(page) else re.sub(r"[A-Z]", lambda x: x[0].lower(), page)
                end = lower.find(f"</{name}", at)
                at = len(page) if end < 0 else end
            continue
        if tag[1] == "/":
            links -= name == "a" and links > 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
        else:
            if name in BLOCK and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            links += name == "a" and not links
            if name not in VOID and not tag.endswith("/>"):
                c = context_of(name, tag)
                if c or name in BLOCK:
                    stack.append((name, c))
                    outs += c == "out"
                    ins += c == "in"
                    landmarked |= c == "in"
        out.append(("block" if name in BLOCK else "space" if name == "br" else "tag", "inset" if inset or outs and ins else name, ""))
    text(page[at:])
    return [("text", "beside" if f == "page" and landmarked else f, t) if k == "text" else (k, f, t) for k, f, t in out]


# ---- weights ---------------------------------------------------------------------------------------------------------


def labelled_pages(n: int = 240, seed: int = 5) -> list[tuple[str, set[str]]]:
    """Pages of invented words in several layouts, with the set of words that belong to the main text."""
    rng = random.Random(seed)
    serial = iter(range(10**9))

    def words(k: int, own: set[str] | None = None) -> str:
        made = [f"w{next(serial)}" for _ in range(k)]
        if own is not None:
            own.update(made)
        return " ".join(made)

    pages = []
    for _ in range(n):
        own: set[str] = set()
        body = f"<h1>{words(rng.randint(1, 9), own)}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<p>{} <a href='/z'>" + words(1, own) + "</a> " + words(4, own) + "</p>"]).format(words(rng.randint(1, 60), own)) for _ in range(rng.randint(1, 12)))
        menu = "".join(f'<li><a href="/x">{words(rng.randint(1, 2))}</a></li>' for _ in range(rng.randint(3, 9)))
        top = rng.choice([f"<nav><ul>{menu}</ul></nav>", f'<div class="menu"><ul>{menu}</ul></div>', f"<header><h2>{words(3)}</h2></header><ul>{menu}</ul>"])
        ad = rng.choice([f'<div class="ad">{words(rng.randint(3, 15))}</div>', f"<aside><p>{words(rng.randint(3, 20))}</p></aside>", f'<div id="cookie-notice">{words(12)}</div>', f"<div>{words(4)} <a href='/y'>{words(2)}</a></div>"])
        end = rng.choice([f"<footer>&copy; {words(rng.randint(4, 12))}</footer>", f'<div class="comments"><p>{words(30)}</p></div><footer>{words(5)}</footer>', f"<form><label>{words(2)}</label></form>"])
        main = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div>{}</div>"]).format(body)
        pages.append((f"<html><head><title>{words(4)}</title></head><body>{top}{ad}{main}{rng.choice(['', ad])}{end}</body></html>", own))
    return pages


@lru_cache(maxsize=1)
def weights() -> dict[tuple[str, str], float]:
    """Log-odds of main text for a word by its place; a tag's are those of what surrounds it, and always below zero."""
    inside: Counter = Counter()
    total: Counter = Counter()
    for page, own in labelled_pages():
        seq = tokens(page)
        mark = [None if k != "text" else (sum(w in own for w in t.split()), len(t.split())) for k, _, t in seq]
        flags = [m and m[0] * 2 > m[1] for m in mark]
        for i, (kind, feature, _) in enumerate(seq):
            if kind == "text":
                inside["text", feature] += mark[i][0]
                total["text", feature] += mark[i][1]
            else:
                near = [f for f in flags[max(0, i - 2) : i + 3] if f is not None]
                inside["tag", feature] += bool(near) and all(near)
                total["tag", feature] += 1
    odds = {k: math.log((inside[k] + 1) / (total[k] - inside[k] + 1)) for k in total}
    out = {k: max(-4.0, min(2.0, v)) for k, v in odds.items() if k[0] == "text"}
    return out | {k: min(-0.05, max(-3.0, v) / 4) for k, v in odds.items() if k[0] == "tag"}


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous stretch [a, b) with the largest sum; empty where no score is above zero."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    seq, table = tokens(page), weights()
    # words that never reach the text count few times, so that an advert within an article does not part it
    size = lambda t: len((html.unescape(t) if "&" in t else t).split())
    scores = [0.0 if f == "inset" else table.get(("text", f), 0.0) * min(size(t), OUT_WORDS if f in DROPPED else len(t)) if k == "text" else table.get(("tag", f), -0.25) for k, f, t in seq]
    a, b = best_region(scores)
    while 0 < a < b and seq[a - 1][0] != "block":
        a -= 1
    while a < b < len(seq) and seq[b][0] != "block":
        b += 1
    blocks, parts = [], []

    def flush() -> None:
        if line := " ".join(html.unescape("".join(parts)).split()):
            blocks.append(line)
        parts.clear()

    for kind, feature, t in seq[a:b]:
        if kind == "block":
            flush()
        elif kind == "space":
            parts.append(" ")
        elif kind == "text" and feature not in DROPPED:
            parts.append(t)
    flush()
    return "\n".join(blocks)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: its main text and the text's length in code points."""
    small_batches(pages.sparkSession, 512)

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages.page_id.cast("long"), pages.url.cast("string"), pages.html.cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
