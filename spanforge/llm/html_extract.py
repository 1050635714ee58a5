"""Main text of web pages as a maximum-scoring run of words and tags.

A page is a sequence of words and tags.  Words score positive, tags negative,
and words of menus, forms, adverts, comments and the like negative; one linear
scan finds the contiguous run with the largest sum.  Within it, text outside the
unwanted containers forms the blocks.

Weights come from labelled pages: pages with one ``article`` element say
themselves what their content is, and a weight is the log odds of a word kind or
tag inside against outside.  They are learned on ``SAMPLE`` pages (by hash order
of the id); words are held to [0.1, 2], tags to [-2, -0.05], words of unwanted
containers to [-0.5, -0.1].  Tags outside the fixed list share one weight.

Defined results: null or empty html, or a page without a positive run, gives an
empty text; unclosed comments, tags and containers are read to the end of the
page; repeated rows are treated alike; all of a long page is read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, saved, scan

SAMPLE = 2000

PIECE = re.compile(r"""<!--.*?(?:-->|$)|<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+(?:>|$)|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: raw text up to their own end tag, never shown
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "noframes", "xmp", "canvas", "math"}
#: containers without article text
UNWANTED = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "datalist"}
CONTAINERS = {"article", "aside", "blockquote", "body", "button", "datalist", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "head", "header", "main", "menu", "nav", "ol", "p", "section", "select", "span", "table", "ul"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACES = {"br", "td", "th", "wbr", "img", "input", "option"}
#: parts of class, id or role that name an unwanted container
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|sidebar|side-bar|sidenav|menu|nav|navbar|navigation|breadcrumbs?|"
    r"masthead|site-header|page-header|topbar|footer|comments?|comment-\w+|disqus|replies|responses|login|signup|search|searchbox|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|complementary|contentinfo)(?:$|[\s_-]|\d)", re.I)  # fmt: skip
KNOWN = BLOCKS | SPACES | UNWANTED | RAW | {"a", "abbr", "b", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "meta", "link", "label"}

DEFAULT = {"word": 1.0, "link": 0.1, "unwanted": -0.5, "tag": -0.3}



def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, text): kind ``text`` with its state, or ``tag`` with its key."""
    stack: list[tuple[str, int]] = []  # open containers; 1 unwanted by tag, 2 by its marks
    link = 0
    pos, end = 0, len(page)
    while pos < end:
        m = PIECE.match(page, pos)
        piece, pos = m.group(), m.end()
        name_at = NAME.match(piece) if piece[0] == "<" and len(piece) > 1 else None
        if name_at is None:
            if piece[:2] not in ("<!", "<?", "</"):
                yield "text", "unwanted" if any(x[1] for x in stack) else "link" if link else "word", piece
            continue
        name, close = name_at.group(1).lower(), piece[1] == "/"
        if name in RAW and not close:
            if not piece.endswith("/>"):
                stop = re.compile(rf"</{name}\s*>|</{name}$", re.I).search(page, pos)
                pos = stop.end() if stop else end
            yield "tag", name if name in KNOWN else "tag", " " if name not in BLOCKS else ""
            continue
        if name == "a":
            link = 0 if close else 1
        if name in CONTAINERS and not piece.endswith("/>"):
            if close:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if at is not None:
                    del stack[at:]
            else:
                if name in ("article", "main", "body") and any(x[1] == 1 for x in stack):
                    stack = [(n, 0 if u == 1 else u) for n, u in stack]
                marks = " ".join("".join(a[1:]) for a in ATTRIBUTE.findall(piece)) if "=" in piece else ""
                inside = any(n in ("article", "main") for n, _ in stack)
                unwanted = 1 if name in UNWANTED or (name == "header" and not inside) else 0
                if name not in ("body", "main") and marks and MARKS.search(marks):
                    unwanted = 2
                if name == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                if unwanted or name not in ("p", "span"):
                    stack.append((name, unwanted))
        yield "tag", ("/" if close else "") + (name if name in KNOWN else "tag"), "\n" if name in BLOCKS else " " if name in SPACES else ""


def count_kinds(page: str) -> tuple[Counter, Counter] | None:
    """Kinds inside and outside the one article of a labelled page; None for other pages."""
    if len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return None
    inside, outside, within = Counter(), Counter(), False
    for kind, value, text in events(page):
        if kind == "tag" and value in ("article", "/article"):
            within = value == "article"
        else:
            (inside if within else outside)[value if kind == "text" else f"<{value}"] += len(text.split()) if kind == "text" else 1
    return inside, outside


def learn_weights(pages: DataFrame, html: str = "html", ident: str = "page_id", sample: int = SAMPLE) -> dict[str, float]:
    def make():
        def work(texts):
            inside, outside = Counter(), Counter()
            for t in texts:
                both = count_kinds(t.decode("utf-8", "replace")) if t else None
                if both:
                    inside += both[0]
                    outside += both[1]
            kinds = sorted(set(inside) | set(outside))
            rows = [[(k, inside[k], outside[k]) for k in kinds]] if texts else []
            return [rows + [[] for _ in texts[1:]]]

        return work

    key = F.xxhash64(F.col(f"`{ident}`").cast("string"))
    first = saved(pages.where(F.col(f"`{html}`").isNotNull()).select(key.alias("h")).distinct().orderBy("h").limit(sample))
    few = pages.select(F.col(f"`{html}`").alias("html"), key.alias("h")).join(F.broadcast(first), "h")  # at most `sample` keys
    seen = scan(few, make, "kinds array<struct<kind:string,inside:long,outside:long>>", "html", ["h"]).select(F.explode("kinds").alias("k"))
    rows = seen.groupBy("k.kind").agg(F.sum("k.inside").alias("inside"), F.sum("k.outside").alias("outside")).collect()
    weights = dict(DEFAULT)
    for r in rows:
        odds = math.log((r["inside"] + 1) / (r["outside"] + 1))
        if r["kind"].startswith("<"):
            weights[r["kind"][1:]] = max(-2.0, min(-0.05, odds))
        elif r["kind"] == "unwanted":
            weights["unwanted"] = max(-0.5, min(-0.1, odds))
        elif r["kind"] == "word":
            weights["word"] = max(0.1, min(2.0, odds))
    return weights


def extract(page: str, weights: dict[str, float]) -> str:
    """Text of the best run; blocks joined by an empty line."""
    seq = list(events(page))
    unknown = weights["tag"]
    best, start, stop, total, since = 0.0, 0, 0, 0.0, 0
    for k, (kind, value, text) in enumerate(seq):
        if total <= 0:
            total, since = 0.0, k
        total += weights[value] * len(text.split()) if kind == "text" else weights.get(value, unknown)
        if total > best:
            best, start, stop = total, since, k + 1
    blocks, current = [], []
    for kind, value, text in seq[start:stop]:
        if kind == "text":
            if value != "unwanted":
                current.append(text)
        elif text == "\n":
            blocks.append("".join(current))
            current = []
        elif text:
            current.append(text)
    blocks.append("".join(current))
    joined = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def main_text(pages: DataFrame, html: str = "html", weights: dict[str, float] | None = None, ident: str = "page_id", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``carry``, default all) with ``text`` and ``n_chars``."""
    learned = learn_weights(pages, html, ident) if weights is None else weights

    def make():
        def work(texts):
            out = [extract(t.decode("utf-8", "replace"), learned) if t else "" for t in texts]
            return [out, [len(x) for x in out]]

        return work

    return scan(pages, make, "text string, n_chars long", html, carry)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, carry=["page_id", "url"]).select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", "n_chars")
