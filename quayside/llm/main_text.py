"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of text segments and tags. Every word scores +1 unless an element around it belongs to
the surroundings of an article, which the element's weight tells; then it scores -1. Tags score a little below
zero. One linear scan finds the contiguous stretch with the greatest score (Kadane); the words inside it that score
positive are the main text.

Weights come from labelled pages: pages whose publisher marks the content with one article or main element. For every element
name and every word of a class or id, the words inside and outside the marked content are counted; the weight is the log ratio of
the two counts, with the names below counted beforehand as if seen outside. Words in surroundings that are nested in the
marked content (comments, adverts, share boxes) are no evidence of content; only a header element there is, as it holds the title. At most
``most_pages`` labelled pages are used (the documented bound: those with the smallest hash of the id).

Defined cases: null or empty html, and pages without scoring words, give an empty text; unclosed and misnested tags are tolerated; rows that
repeat are each extracted; an empty table gives no rows; ties between stretches go to the first; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.shared import smallest_hashes, text_of
from quayside.llm.words import pieces

MOST_PAGES = 500
# Names of elements, and words of classes and ids, that stand around an article.
SURROUNDINGS = (
    "ad ads advert advertisement adverts alert aside banner breadcrumb breadcrumbs button captcha combox comment comments consent cookie cookies copyright dialog disqus footer footnav form gdpr header iframe label "
    "login masthead menu modal nav navbar navigation newsletter notice noscript option pagination pager popup promo promoted recommended related reply replies responses search select share "
    "sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe subscription toolbar topbar widget"
).split()
_KNOWN = frozenset(SURROUNDINGS)
CONTENT = ("article", "main")
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav "
    "noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title template svg math object canvas audio video".split())  # never text
CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
# block elements that end an open paragraph
ENDS_P = BLOCKS - {"br", "button", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "body", "html", "head", "title", "iframe", "noscript", "template", "textarea"}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    for m in NAMED.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        found += value.split()
        found += [x for x in re.split(r"[^a-z]+", value) if x]
    return tuple(dict.fromkeys(found))


def events(page: str) -> Iterator[tuple[str, object]]:
    """("text", segment) and ("tag", name, opening, names) in page order; raw elements and comments are left out."""
    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if m[1]:
            yield "text", m[1]
        if m[3]:
            tag, opening = m[3].lower(), not m[2]
            if opening and tag in RAW and not m[4].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            yield "tag", (tag, opening, names_of(tag, m[4]) if opening else ())
    if at < len(page):
        yield "text", page[at:]


def segments(page: str) -> Iterator[tuple[str | None, int, tuple[tuple[str, ...], ...]]]:
    """(text, block, names of the elements around it); the text is None for a tag."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    block = 0
    for kind, value in events(page):
        if kind == "text":
            yield html.unescape(value), block, tuple(n for _, n in stack)
            continue
        tag, opening, names = value
        block += tag in BLOCKS
        if opening:
            if tag in ENDS_P and any(t == "p" for t, _ in stack):
                while stack.pop()[0] != "p":
                    pass
            elif tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in CLOSES[tag]:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "select"):
                        break
            if tag not in VOID:
                stack.append((tag, names))
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        yield None, block, ()


class Weights:
    """Weights of names, from the words that labelled pages have inside and outside their marked content."""

    def __init__(self, labelled: list[str]):
        inside, outside = Counter(), Counter(dict.fromkeys(SURROUNDINGS, 30))
        for page in labelled:
            for text, _, around in segments(page):
                n = len(text.split()) if text else 0
                if n:
                    content = next((i for i, a in enumerate(around) if a[0] in CONTENT), None)
                    marked = content is not None
                    if marked and any(x in _KNOWN for a in around[content + 1 :] for x in (a[1:] if a[0] == "header" else a)):
                        continue
                    names = {x for a in around for x in a} - {*CONTENT, "html", "body"}
                    if not marked and (known := names & _KNOWN):
                        names = known  # these explain the words; a plain div or link around them is not to blame
                    for name in names:
                        (inside if marked else outside)[name] += n
        self.of = {x: min(0.0, math.log((inside[x] + 1) / (outside[x] + 1))) for x in {*inside, *outside}}

    def word(self, around: tuple[tuple[str, ...], ...]) -> float:
        worst = min((self.of.get(x, 0.0) for a in around for x in a), default=0.0)
        return -1.0 if worst <= -1 else 1.0


def main_text(page: str | None, weights: Weights, tag_score: float = -0.05) -> str:
    """The text of the best stretch: white space inside a block as one space, blocks joined by one space."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    kept: list[tuple[str | None, int, bool]] = []
    for text, block, around in segments(page or ""):
        if text is None:
            score = tag_score
        else:
            word = weights.word(around)
            score = word * len(text.split())
        kept.append((text, block, text is not None and word > 0))
        if total <= 0:
            total, start = 0.0, len(kept) - 1
        total += score
        if total > best:
            best, low, high = total, start, len(kept)
    blocks: dict[int, list[str]] = {}
    for text, block, good in kept[low:high]:
        if good:
            blocks.setdefault(block, []).append(text)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most_pages: int = MOST_PAGES) -> Weights:
    """Weights from pages with one marked content element."""
    marked = pages.select(F.col(id_col).alias("id"), text_of(html_col).alias("html"))
    ones = [F.size(F.regexp_extract_all("html", F.lit(rf"(?i)<{t}[\s>]"), 0)) for t in CONTENT]
    picked = marked.where((ones[0] + ones[1]) == 1).select("html", F.xxhash64("id", "html").alias("h"))
    picked = smallest_hashes(picked, "h", most_pages)
    return Weights([r["html"] for r in picked.collect()])


def main_texts(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Id, url where there is one, and main text of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    rest = [c for c in ("url",) if c in pages.columns]

    def run(batches):
        for batch, found in pieces(batches, "html"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", *rest)), pa.array([main_text(p, weights) for p in found], pa.string())], ["key", *rest, "text"])

    plain = pages.select(F.col(id_col).alias("key"), *rest, F.col(html_col).alias("html"))
    return plain.mapInArrow(run, f"key {kind}, {''.join(f'{c} string, ' for c in rest)}text string").withColumnRenamed("key", id_col)
