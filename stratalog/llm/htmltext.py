"""Main text of web pages by two passes of block rules.

A page is read once as tags and text. Block tags cut it into blocks; containers that are never part of an article
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles) mark theirs as outside,
by tag, role, or whole class and id names. A name counts if all its parts are known: ``comment-list``, not
``comments-open``. What names alone put outside comes back in where it holds the page's first ``article`` or ``main``,
and where nothing else is left and it has a block that the first pass calls good.

The first pass decides blocks by length, stop-word density and link density and leaves short or unclear ones open. Long
text in sentences is good in any language; stop words of four only help to tell shorter ones. The second pass gives an
open block the label of its nearest decided neighbour, of two as near ones the better if it stands in the article, else
the worse. Where a page marks its article (``article``, ``main``), neighbours are looked for inside it alone, its links
and lists are open and not bad, and open blocks without any decided neighbour are kept. So is all but links on a page
without any good block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|noscript|template|textarea|title|svg|iframe|select|audio|video)(?=[\s/>])(?:[^=>]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the next of the same group.
_IMPLIED = {"p": "p", "li": "li", "dt": "d", "dd": "d", "td": "t", "th": "t", "tr": "r", "option": "o"}
_SAME = {group: [x for x, g in _IMPLIED.items() if g == group] for group in _IMPLIED.values()}
_OUTSIDE_TAGS = frozenset("nav footer aside dialog menu button fieldset head".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: Parts of class and id names: of adverts and other articles, which never hold the page's own; of reader comments; of layout and notices, which may.
_OTHER_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsbox adslot adunit adsbygoogle sponsor sponsored sponsors promo promos promotion promotions "
    "related recommended recommendations teaser teasers".split()
)
_LAYOUT_PARTS = frozenset(
    "cookie cookies consent gdpr newsletter newsletters subscribe subscription signup popup modal overlay breadcrumb breadcrumbs pagination pager share sharing sharethis addthis social toolbar login search skip "
    "masthead navbar topbar copyright nav menu menus navigation navigate footer sidebar sidebars side aside banner banners notice notices alert alerts widget widgets header headers".split()
)
_COMMENT_PARTS = frozenset("comment comments commentlist commenter commenters discussion discussions feedback reaction reactions respond replies disqus".split())
#: Parts that say nothing alone; a name is judged only if all its parts are in one of these sets.
_NEUTRAL_PARTS = frozenset(
    "a area article articles bar block blocks body bottom box buttons button center col column container content entry fixed float form global google group holder home icons image images inner item items "
    "js left links link list lower main media more msg message messages module outer page pages pane panel post posts primary reader right row secondary section site sky skyscraper slot small stories story sub "
    "text the thread title to top unit upper user users web wrap wrapper wrapping zone id".split()
)
#: Whole class names of what holds an article; beside them other names count for nothing, but those of comments.
_HOLDERS = frozenset("article articles entry post story main content hentry single body page".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Common words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for as with was on are be by at from this an or not but they have had his her which you we "
    "de la le les et des un une du en que qui dans pour est au pas sur par ne se plus avec ce il elle on "
    "el los las del y por con una su para es al lo como más o pero sus este no si "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()
)
LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_HIGH, SENTENCES = 70, 200, 0.15, 0.25, 0.5, 2
GOOD, OPEN, BAD = 1, 0, -1
_SENTENCE_END = re.compile(r"[.!?\u2026\u061f\u06d4\u0964\u3002\uff01\uff1f]")


def _named(name: str) -> str | None:
    """What a whole class or id name says: "comments", "other", "layout" or nothing. Digits in it are overlooked."""
    parts = {p.lower() for p in _PARTS.findall(name)}
    if not parts <= _OTHER_PARTS | _LAYOUT_PARTS | _COMMENT_PARTS | _NEUTRAL_PARTS:
        return None
    return next((kind for kind, known in (("comments", _COMMENT_PARTS), ("other", _OTHER_PARTS), ("layout", _LAYOUT_PARTS)) if parts & known), None)


@lru_cache(maxsize=20_000)
def _judged(attributes: str, inside: bool) -> tuple[bool, bool]:
    """(outside for good, outside by names alone) of an element with these attributes, ``inside`` an article or not."""
    hard, said, holder = False, set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hard = True
        elif name == "aria-hidden":
            hard |= value.lower() == "true"
        elif name == "role":
            hard |= value.lower() in _OUTSIDE_ROLES
        elif name == "style":
            hard |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "itemprop":
            hard |= value.lower() == "comment"
        elif name in ("class", "id"):
            for one in value.split():
                kind = _named(one)
                if kind == "comments" or not inside or name == "class" and "header" not in one.lower():
                    said.add(kind)  # in an article ids name its headings, and its header is its own
                holder |= name == "class" and one.lower() in _HOLDERS
    return hard or "comments" in said or "other" in said and not holder, "layout" in said and not holder


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, characters in links, outside: 0 no, 1 by names or a form alone, 2 for good, in an article, heading) of the blocks of a page, in order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[list] = []  # [name, outside for good, outside by names or a form, in article]
    text: list[str] = []
    linked = breaks = links = 0
    open_names: Counter = Counter()  # of the stack: what is not open need not be looked for
    hard = inside = heading = first = False
    soft = 0

    def flush():
        nonlocal linked, breaks, heading
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, linked, 2 if hard else soft, inside, heading))
            text.clear()
        linked = breaks = 0

    def state():
        nonlocal hard, soft, inside
        hard, soft, inside = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (False, 0, False)

    def push(*item):
        stack.append(list(item))
        open_names[item[0]] += 1

    def cut(k):
        open_names.subtract(x[0] for x in stack[k:])
        del stack[k:]

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            piece = page[last : m.start()]
            text.append(piece)
            if links:
                linked += len(piece.strip())
            if not piece.isspace():
                breaks = 0
        last = m.end()
        if m[1]:
            text.append(" ")
            continue
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if name == "a":
            links = 0 if m[2] else 1
        if not m[2]:
            if name in _BLOCK:
                flush()
                links = links if name == "a" else 0
                heading = name in _HEADINGS
                group = _IMPLIED.get(name)
                if group and any(open_names[x] for x in _SAME[group]):
                    for k in range(len(stack) - 1, -1, -1):
                        if _IMPLIED.get(stack[k][0]) == group:
                            cut(k)
                            break
                        if stack[k][0] not in _IMPLIED and stack[k][0] in _BLOCK:
                            break
                elif not group and stack and stack[-1][0] == "p":
                    cut(len(stack) - 1)
                state()
            if name in _VOID or m[4].endswith("/") and name not in _BLOCK:
                continue
            own_hard, own_soft = (_judged if len(m[4]) < 500 else _judged.__wrapped__)(m[4], inside) if m[4] and m[4].strip() else (False, False)
            if name in ("html", "body"):
                own_hard = own_soft = False
            whole = name in ("article", "main") or "main" in (m[4] or "") and re.search(r"role\s*=\s*[\"']?main", m[4], re.I)
            if whole and not own_hard:
                while stack and stack[-1][0] in ("nav", "header", "head"):
                    cut(len(stack) - 1)
                state()
                around = own_soft or bool(soft) and first
                push(name, hard, int(around), not hard and not around)
                first = first or not hard and not around
            elif name in _BLOCK or own_hard or own_soft:
                outside = own_hard or name in _OUTSIDE_TAGS or name == "header" and not inside
                push(name, hard or outside, int(soft or own_soft or name == "form"), inside)
            state()
        else:
            if name in _BLOCK:
                flush()
                heading = False
            for k in range(len(stack) - 1, -1, -1) if open_names[name] else ():
                if stack[k][0] == name:
                    cut(k)
                    break
            state()
    if last < len(page):
        text.append(page[last:])
        if links:
            linked += len(page[last:].strip())
    flush()
    return out


def first_pass(text: str, linked: int, inside: bool) -> int:
    """GOOD, OPEN or BAD by length, stop-word density and link density; ``inside`` a marked article no block is bad."""
    size = len(text)
    if linked > LINKS_HIGH * size:
        return OPEN if inside else BAD
    if size < LENGTH_LOW:
        return OPEN
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH or size >= LENGTH_HIGH and (stops >= STOP_LOW or len(_SENTENCE_END.findall(text)) >= SENTENCES):
        return GOOD
    return BAD if size >= LENGTH_HIGH and stops < STOP_LOW and not inside else OPEN


def second_pass(labels: list[int], headings: list[bool], marked: bool) -> list[bool]:
    """Which blocks stay: open ones take the label of their nearest decided neighbour, a heading that of good text within two blocks below it.

    Without a marked article the ends of the page count as outside, and of two as near neighbours the worse decides.
    """
    n, alone = len(labels), GOOD not in labels  # nothing to tell by: what is not plainly outside stays
    after, at = [n] * n, n
    for k in range(n - 1, -1, -1):
        after[k] = at
        at = k if labels[k] else at
    kept, before = [], -1
    for k, label in enumerate(labels):
        if label:
            before = k
        edge = OPEN if marked else BAD
        left, right = (labels[before] if before >= 0 else edge), (labels[after[k]] if after[k] < n else edge)
        if headings[k] and right == GOOD and after[k] - k <= 2:
            label = GOOD
        elif not label:
            near = (k - before if left else 1 << 60) - (after[k] - k if right else 1 << 60)
            if left == right or not near:
                label = left if left == right else GOOD if marked else BAD
            else:
                label = left if near < 0 else right
            if label == OPEN or alone:
                label = GOOD if marked or alone else BAD
        kept.append(label == GOOD)
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; no page or no article: empty."""
    if not page:
        return ""
    every = blocks(page)
    found = [b for b in every if not b[2]]
    if not found and any(b[2] == 1 and first_pass(b[0], b[1], False) == GOOD for b in every):
        found = [b for b in every if b[2] == 1]
    marked = any(b[3] for b in found)
    if marked:
        found = [b for b in found if b[3]]
    labels = [first_pass(text, linked, marked) for text, linked, *_ in found]
    if GOOD not in labels:  # without any good block lack of sentences says nothing
        labels = [BAD if linked > LINKS_HIGH * len(text) and not marked else OPEN for text, linked, *_ in found]
    return "\n".join(b[0] for b, stays in zip(found, second_pass(labels, [b[4] for b in found], marked)) if stays)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` but ``html_col``, and the main text; a column already named ``text_col`` gives way.

    Null and empty pages have an empty text. Pages that end early are read as far as they go.
    """
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = pages.select(*rest).withColumn(text_col, F.lit("")).schema

    def run(batch):
        column = batch.column(batch.schema.get_field_index(html_col))
        texts = pa.array([main_text(x.as_py()) for x in column], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), texts], names=[*rest, text_col])

    return map_batches(pages.select(*rest, html_col), run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null and empty html, and pages without an article, give an empty text and 0. Null ids and urls and repeated rows come
    out as they came in; an empty table gives an empty result; further columns are not read.
    """
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
