"""Main text of web pages by tree scoring.

The tags of a page make a tree of light nodes. Every paragraph passes points for its length and
its commas to its parent, half to the next ancestor and less further up; an ancestor's points
are discounted by the share of its text that lies in links. If the best container is or lies in an
article, main or articleBody element, the outermost of these is kept whole. Else the best container
is kept, and of its siblings, and of the text that stands between them, what is not mostly links or
scores alike. Their blocks are returned in page order, without what is never part of an article: menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts and styles.

A form, or an element that only its class or id names as no part of an article (`sidebar`), is the
page itself if it holds most of its text and the main heading, or nearly all of its text. A name
counts only if all its words tell the same: `related-work` and `no-sidebar` are names like others.

Edge cases: a null or empty page gives the empty text, a page without paragraphs its headings. Tags
that are left open end with their container; stray end tags are ignored; a page cut off anywhere keeps what
was read. Depth is not limited by recursion. Nothing is capped, whatever the length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, declaration or instruction, or how a tag begins; `_WITHIN` is the rest of a tag.
_OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/<>]*)", re.S)
_WITHIN = re.compile(r"(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no markup and no text of the page: skipped up to the end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends these, if they are open in its container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
#: A search for an open element to end does not pass these.
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
NEVER = frozenset(
    "nav header footer aside form button menu dialog label fieldset head noscript template svg select object canvas audio video annotation annotation-xml".split()
)
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: A class or id names what is never part of an article if one of these words is in it and all
#: its other words are in `_NEUTRAL`: `cookie-banner` and `main-nav`, not `related-work` or `no-sidebar`.
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
_NEVER_WORDS = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead related recommended share sharing social toolbar pagination pager login signup".split()
)
_NEUTRAL = frozenset(
    "main site page global primary secondary top bottom left right side upper lower mobile desktop inner outer wrapper wrap container box bar area "
    "block section row col column list item items link links post posts article articles story stories content body text button buttons icon icons "
    "form panel region zone slot unit user reader media module group title form thread section count us this on".split()
)
#: Of elements that are never part of an article, these may hold the whole page.
_WRAPPERS = frozenset("form fieldset".split())
#: Points of a paragraph reach so many ancestors.
REACH = 64
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6 figcaption".split())


class Node:
    __slots__ = ("tag", "parent", "children", "never", "wraps", "likely", "points")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, wraps: bool = False, likely: bool = False) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.never, self.wraps, self.likely, self.points = never, wraps, likely, 0.0


def _never_named(name: str) -> str:
    """The word for which a class or id names no part of an article; empty if there is none."""
    words = [w for w in re.split(r"[-_\d]+", name.lower()) if w]
    found = [w for w in words if w in _NEVER_WORDS]
    return found[0] if found and all(w in _NEVER_WORDS or w in _NEUTRAL for w in words) else ""


def _judge(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(never part of an article, unless it holds the page, likely the article's container)."""
    never, likely = tag in NEVER, tag in ("article", "main")
    wraps = tag in _WRAPPERS
    if not attributes or tag in ("body", "html", "article", "main"):
        return never, wraps, likely
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            for word in filter(None, map(_never_named, value.split())):
                wraps = word not in _COMMENTS and (wraps or not never)
                never = True
        elif name == "role":
            if value.lower() in _NEVER_ROLES:
                never, wraps = True, wraps and value.lower() == "form"
            likely = likely or value.lower() in ("main", "article")
        elif name == "itemprop":
            likely = likely or value.lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            never, wraps = True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            never, wraps = True, False
    return never, wraps, likely


def _end(node: Node, names: tuple[str, ...], stop: tuple[str, ...]) -> Node:
    """The node to go on in after the innermost open element of these names ends."""
    at = node
    while at.parent is not None and at.tag not in stop:
        if at.tag in names:
            return at.parent
        at = at.parent
    return node


_P_STOP = tuple(BLOCKS - {"p"})


_P_END = {tag: tuple(BLOCKS - {tag}) for tag in ("p", *_TITLES)}
_FOREIGN = ("svg",)


def parse(page: str) -> Node:
    """The tree of a page; text children are strings, references are decoded.

    A quote that stays open ends with its tag, and a tag that meets another ends there.
    """
    root = at = Node("html", None)
    #: Open elements by tag, so that an end tag without a partner costs nothing.
    open_tags: dict[str, int] = {}
    place, n = 0, len(page)

    def end(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        nonlocal at
        if any(open_tags.get(name) for name in names):
            after = _end(at, names, stop)
            while at is not after:
                open_tags[at.tag] -= 1
                at = at.parent

    while place < n:
        m = _OPENING.search(page, place)
        text = page[place : m.start() if m else n]
        if m is None and (cut := re.search(r"<[a-zA-Z/!?][^<]*\Z", text)):
            text = text[: cut.start()]  # a tag cut off at the end of the page
        if text:
            at.children.append(html.unescape(text))
        if m is None:
            break
        place = m.end()
        if m[2] is None:
            continue
        tag, closes = m[2].lower(), _WITHIN.match(page, place).end()
        if closes < n and page[closes] == "<":
            place = closes
            continue
        if closes == n or page[closes] != ">":
            closes = page.find(">", place)
            if closes < 0:
                break
        within, place = page[place:closes], closes + 1
        if m[1]:
            if tag == "br":
                at.children.append(" ")
            elif tag in _P_END:
                end((tag,), _P_END[tag])
            else:
                end((tag,), ("table",) if tag not in BLOCKS else ())
            continue
        if tag in RAW:
            if not within.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, place)
                place = close.end() if close else n
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                at.children.append(" " if tag == "br" else Node("hr", at))
            continue
        if tag in BLOCKS:
            end(_FOREIGN, ())
            end(("p",), _P_STOP)
        if tag in CLOSES:
            end(CLOSES[tag], SCOPES.get(tag, ()))
        if tag in ("html", "body") and at.parent is None:
            continue
        node = Node(tag, at, *_judge(tag, within))
        at.children.append(node)
        if tag in ("svg", "object") and within.endswith("/"):
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        at = node
    return root


def _admit_wrappers(root: Node) -> None:
    """What only by its name or as a form is no article, but holds most of the page's text and a
    main heading or container, or nearly all of the text, is taken for the page itself."""
    order, wraps = [root], False
    for node in order:
        order += [child for child in node.children if not isinstance(child, str)]
        wraps = wraps or node.wraps
    if not wraps:
        return
    size, heads = {}, {}
    for node in reversed(order):
        size[node] = sum(len(child.strip()) if isinstance(child, str) else size[child] for child in node.children)
        heads[node] = node.tag in ("h1", "main") or any(heads[child] for child in node.children if not isinstance(child, str))
        if node.never and not node.wraps:
            size[node], heads[node] = 0, False
    for node in order:
        if node.never and node.wraps and (2 * size[node] > size[root] and heads[node] or 10 * size[node] >= 9 * size[root] > 0):
            node.never = False


def _walk(root: Node) -> Iterator[tuple[Node, object, bool]]:
    """(node, child, leaving) in page order, leaving out what is never part of an article."""
    stack = [(root, iter(root.children))]
    while stack:
        node, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                yield node, child, False
            elif not child.never:
                yield child, None, False
                stack.append((child, iter(child.children)))
                break
        else:
            stack.pop()
            yield node, None, True


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(nearest block element, text, characters in links) of each run of text, in page order."""
    found: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked, links, holder = 0, 0, root

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append((holder, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    for node, text, leaving in _walk(root):
        if text is not None:
            if not parts:
                holder = node
                while holder.tag not in BLOCKS and holder.parent is not None:
                    holder = holder.parent
            parts.append(text)
            linked += len(text.strip()) if links else 0
        elif node.tag in BLOCKS:
            flush()
        elif node.tag == "a":
            links += -1 if leaving else 1
    flush()
    return found


def _up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _admit_wrappers(root)
    found = blocks(root)
    if not found:
        return ""
    # Elements in page order, parents first; sums go up from the last to the first.
    order = [root]
    for node in order:
        order += [child for child in node.children if not isinstance(child, str) and not child.never]
    length: dict[Node, list[int]] = {}
    for holder, text, linked in found:
        sums = length.setdefault(holder, [0, 0])
        sums[0] += len(text)
        sums[1] += linked
        if holder.tag in _TITLES or 2 * linked > len(text):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        # Text that stands in a container itself counts for that container.
        above = _up(holder.parent if holder.tag in _PARAGRAPHS and holder.parent is not None else holder)
        for level, node in enumerate(islice(above, REACH)):
            node.points += points / (1 if level == 0 else 2 * level)
    for node in reversed(order):
        if node in length and node.parent is not None:
            sums = length.setdefault(node.parent, [0, 0])
            sums[0] += length[node][0]
            sums[1] += length[node][1]
    score = {}
    for node, (total, linked) in length.items():
        score[node] = (node.points + (25 if node.likely and node.points else 0)) * (1 - linked / total)
    best = max(score, key=score.get)
    if score[best] <= 0:
        # No paragraph at all: headings are all the text there is.
        return " ".join(text for holder, text, linked in found if holder.tag in _TITLES and 2 * linked <= len(text))
    keep, beside = {best}, None
    articles = [node for node in _up(best) if node.likely]
    if articles:
        keep = {articles[-1]}
    elif best.parent is not None:
        beside, enough = best.parent, max(10, 0.2 * score[best])
        for sibling in beside.children:
            if isinstance(sibling, str) or sibling not in length:
                continue
            total, linked = length[sibling]
            if score[sibling] >= enough or 2 * linked <= total:
                keep.add(sibling)
    for node in order:
        if node.parent in keep:
            keep.add(node)
    return " ".join(text for holder, text, linked in found if holder is beside and 2 * linked <= len(text) or holder in keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text of the article and n_chars, its code points."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                # Lone surrogates, as from &#xD800;, have no UTF-8 form.
                texts = [t.encode("utf-8", "replace").decode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(scan, f"page_id {id_type}, url string, text string, n_chars bigint")
