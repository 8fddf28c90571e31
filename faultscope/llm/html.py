"""HTML extraction: flat text blocks, features of the block and its neighbours, a decision tree.

The page is cut at block tags into flat blocks in page order. Each block has its number of
words and its link density (share of words inside links), those of its neighbours, and where
it stands: inside an article, inside a navigation-like element, inside an element whose
class or id names an extra (advert, cookie notice, comments ...), inside one whose name is a
weak sign only (menu, share, widget ...: there words, links and neighbours tell), or a heading.
An extra's name on an element that is or encloses an article or main element marks nothing there, save
comments, teasers and adverts that follow an article as articles of their own. A small
decision tree, fitted on the blocks of the labelled pages in ``html_labels``, keeps or drops
each block; kept blocks are joined.

Scripts, styles, markup comments, templates and the document head hold no text at all.
Character references are decoded first, then white space becomes one space.

Edge cases: null html is empty and gives an empty text; unclosed tags and cut pages are read
to the end, an unfinished last tag or comment is dropped; a link that is never closed ends with
the block element around it, an anchor without href is no link; the work is linear in the page; ``<`` that opens no tag is text;
an empty table gives an empty table; repeated rows are read each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_of, by_batch, share, table
from .html_labels import PAGES

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.IGNORECASE)
_NAMES = re.compile(r"[a-z]+")
#: Elements without readable text.
SILENT = frozenset("script style template noscript svg iframe canvas head title textarea select button audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that belong to the page rather than its article.
FRAME = frozenset("nav aside footer form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BREAKS = HEADINGS | FRAME | frozenset("""address article blockquote body br caption center dd details dir div dl dt fieldset figcaption figure header hgroup hr html legend li main ol
    optgroup option p pre search section summary table tbody td tfoot th thead tr ul head title script style template noscript""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id, role and label that name an extra. A fixed list; plural forms are meant too.
EXTRAS = frozenset("""ad advert advertisement advertising alert banner breadcrumb comment commentlist consent cookie disqus dialog footer gdpr login masthead menu menubar modal nav navbar
    navigation newsletter notice notification pager pagination popup promo promotion related reply respond search share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription teaser toolbar widget""".split())
#: Of these, what follows an article and may be an article element itself; the others also name parts of a layout.
FOLLOWS = frozenset("ad advert advertisement advertising comment commentlist disqus promo promotion related reply respond sponsor sponsored teaser".split())
#: Of these, names of link lists that article text also carries: words, links and neighbours decide there.
WEAK = frozenset("breadcrumb menu menubar nav navbar navigation pager pagination search share sharing skip social toolbar widget".split())
#: On a paragraph or inside a line these are weak as well.
WEAK_INLINE = WEAK | frozenset("alert banner dialog footer masthead notice notification sidebar".split())
#: What stands after these in a name says what a layout has or lacks: with-sidebar, page-no-nav.
HAS = frozenset("with without has have no non".split())
HEADER = frozenset("header banner masthead".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    article: bool
    frame: bool
    extra: bool
    heading: bool
    weak: bool


def extra_named(attributes: str, weak: frozenset[str] = WEAK) -> int:
    """0: no extra; 1: a weak sign; 2: an extra; 3: one of ``FOLLOWS``.

    A name counts by its first and its last part (ad-slot, cookie-banner), cut before ``--``
    and before with-, has-, no-: page-sidebar-right and layout--sidebar name no extra.
    """
    found = 0
    if "=" not in attributes:
        return found
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _NAMES.findall(name.partition("--")[0])
            parts = parts[:next((k for k, w in enumerate(parts) if w in HAS), len(parts))]
            for w in {*parts[:1], *parts[-1:]}:
                w = w if w in EXTRAS else w.removesuffix("s")
                if w in EXTRAS:
                    found = max(found, 1 if w in weak else 2 + (w in FOLLOWS))
    return found


class _Open(NamedTuple):
    tag: str
    article: bool
    frame: bool
    extra: int
    silent: bool


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    text: list[str] = []  # pieces of the open block; links alternate
    linked: list[str] = []
    link = heading = False
    depth = 0  # of the stack where the open link began
    stack = [_Open("", False, False, 0, False)]
    count: Counter[str] = Counter()  # open elements by tag
    told = False  # text of an article that is no extra

    def close() -> None:
        nonlocal told
        raw = "".join(text)
        if raw and not raw.isspace():
            words = unescape(raw).split()
            if words:
                top = stack[-1]
                inside = len(unescape(" ".join(linked)).split())
                out.append(Block(" ".join(words), len(words), min(inside, len(words)), top.article, top.frame, top.extra > 1, heading, top.extra == 1))
                told = told or top.article and not top.frame and not top.extra
        text.clear()
        linked.clear()

    def push(o: _Open) -> None:
        stack.append(o)
        count[o.tag] += 1

    def pop() -> None:
        count[stack.pop().tag] -= 1

    def add(s: str) -> None:
        if s and not stack[-1].silent:
            text.append(s)
            if link:
                linked.append(s)

    page = page or ""
    at = 0
    while True:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        end, tag, attributes, empty = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], "")
        if not tag:
            continue
        if not m[0].endswith(">"):
            break  # cut inside a tag
        tag = tag.lower()
        if tag == "a":
            link, depth = not end and _HREF.search(attributes) is not None, len(stack)
            continue
        if tag in BREAKS:
            close()
            heading = tag in HEADINGS and not end
            if stack[-1].tag == "p":  # any block ends a paragraph
                pop()
                if tag == "br":  # but not its links
                    depth = min(depth, len(stack))
                link = link and len(stack) >= depth
        elif tag not in SILENT:
            if not end and not empty and tag not in VOID and (named := extra_named(attributes, WEAK_INLINE)):
                close()
                push(stack[-1]._replace(tag=tag, extra=max(stack[-1].extra, named)))
            elif end and stack[-1].tag == tag:
                close()
                pop()
            continue
        if end:
            if count[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
                link = link and len(stack) >= depth
            continue
        if tag in VOID or empty and tag in SILENT:
            continue
        top = stack[-1]
        frame = top.frame or tag in FRAME or tag == "header" and not top.article
        extra = top.extra if tag in ("html", "body") else max(top.extra, extra_named(attributes, WEAK_INLINE if tag == "p" or tag in HEADINGS else WEAK))
        if tag in ("article", "main") and not (extra == 3 and told):  # a layout's name says nothing of its article; comments after an article are extras
            extra = 0
        push(_Open(tag, top.article or tag in ("article", "main"), frame, extra, top.silent or tag in SILENT))
        if tag in RAW:  # up to its own end tag, whatever stands between
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else len(page)
    close()
    return out


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "article", "frame", "extra", "heading", "page_has_article", "weak"]


def block_features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked / b.words for b in found], float)
    before, after = (lambda v: np.r_[0.0, v[:-1]]), (lambda v: np.r_[v[1:], 0.0])
    flags = np.array([(b.article, b.frame, b.extra, b.heading) for b in found], float).reshape(n, 4)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), flags, np.full(n, float(flags[:, 0].any())), np.array([b.weak for b in found], float)])


class Node(NamedTuple):
    feature: int
    most: float
    left: Node | bool
    right: Node | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> Node | bool:
    """Gini tree; ties go to the first feature and the lowest cut."""
    keep = bool(y.mean() >= 0.5)
    if not depth or y.all() or not y.any():
        return keep
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, k] <= cut
            p, q, w = y[left].mean(), y[~left].mean(), left.mean()
            impurity = 2 * (w * p * (1 - p) + (1 - w) * q * (1 - q))
            if impurity < best[0] - 1e-12:
                best = (impurity, k, float(cut))
    _, k, cut = best
    if k < 0:
        return keep
    left = x[:, k] <= cut
    return Node(k, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def decide(node: Node | bool, x: np.ndarray) -> np.ndarray:
    if isinstance(node, bool):
        return np.full(len(x), node)
    out = np.empty(len(x), bool)
    left = x[:, node.feature] <= node.most
    out[left], out[~left] = decide(node.left, x[left]), decide(node.right, x[~left])
    return out


def labelled(pages: list[str] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels: in the labelled pages a kept block begins with +, a dropped one with -."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        y += [b.text[0] == "+" for b in found]
        x.append(block_features(found))
    return np.concatenate(x), np.array(y)


def main_text(page: str | None, tree: Node | bool) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, decide(tree, block_features(found)).tolist(), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: id, the columns in ``also`` (strings), text, n_chars."""
    tree = share(pages.sparkSession, grow(*labelled()))
    schema = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in also), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(h.as_py(), tree.value) for h in b.column(b.num_columns - 1)]
            return batch_of(schema, [*b.columns[:-1], text, [len(t) for t in text]])
        return one

    rows = pages.select(F.col(id_col).cast("bigint"), *(F.col(c).cast("string") for c in also), F.col(html_col))
    kinds = "".join(f"`{c}` string, " for c in also)
    return rows.mapInArrow(by_batch(make), f"id long, {kinds}text string, n_chars long").withColumnRenamed("id", id_col)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
