"""Main text of web pages by tree scoring.

The page becomes a light tree.  Parts that are never the article (menus, footers,
adverts, forms, comments, hidden parts and the like) are pruned by element, role,
class or id.  Every paragraph then passes points for its length and its commas to
its ancestors, fewer the farther; an ancestor's points are discounted by the share
of its text inside links.  The best container is kept with those siblings that
score well or read like text; inside an article, parts that are mostly links go.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import slices

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'/>]+)")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp template svg math canvas object audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody tfoot thead tr dd dt li legend body html".split()) | frozenset(("p",))
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
SCOPE = frozenset("table td th ul ol dl html body button article section div".split())
JUNK = frozenset("head nav footer aside form button select dialog menu input label script style noscript template iframe svg math canvas object audio video textarea title noframes noembed".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted cookie cookies "
    "consent gdpr notice notices alert popup modal overlay lightbox newsletter subscribe subscription signup signin login register "
    "sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs crumbs footer foot masthead topbar toolbar "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommend recommended "
    "recommendations more widget widgets pager pagination paging search skip hidden outbrain taboola copyright legal disclaimer paywall "
    "tags taglist byline metadata thread threads reactions".split()
)
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adsense sponsored promo promoted outbrain taboola".split())
#: Junk words that titles and topics hold as well; they tell only of a part that also looks like no text.
TOPIC_WORDS = frozenset(
    "more search related legal social copyright notice notices tags promotion respond login alert hidden skip register subscription "
    "discussion share sharing reply replies recommend recommended recommendations sponsor consent disclaimer cookies menu menus rail "
    "navigation foot overlay metadata".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORM = frozenset("form input select textarea".split())
HEADER_WORDS = frozenset(("header", "head"))
GOOD_WORDS = frozenset("article body content entry main page post story text blog hentry".split())
MODIFIERS = frozenset("has with no without show is".split())
SCORED = frozenset("p pre td blockquote div section li dd article main".split())
MIN_PARAGRAPH = 25
#: A text of more characters, and a share in links below this, is no list of links.
MIN_TEXT, MAX_LINKS = 80, 0.25
#: Parts of an article that are no text if so much of them is in links, and of so many.
LISTS, MOSTLY_LINKS, LEAST_LINKS = frozenset("ul ol dl div section table".split()), 0.5, 3
#: Elements nested deeper hang, with their texts, from the one at this depth.
MAX_DEPTH = 200
_SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)


class Node:
    __slots__ = ("tag", "words", "ids", "parent", "items", "junk", "score", "text", "links", "depth")

    def __init__(self, tag, parent):
        self.tag, self.parent, self.items = tag, parent, []
        self.depth = parent.depth + 1 if parent is not None else 0
        self.words, self.ids, self.junk, self.score = frozenset(), frozenset(), tag in JUNK, None


def _words(value: str) -> frozenset:
    out, last = [], ""
    for word in _WORD.findall(value):
        word = word.lower()
        if last not in MODIFIERS:
            out.append(word)
        last = word
    return frozenset(out)


def _describe(node: Node, attrs: str) -> None:
    for m in _ATTR.finditer(attrs):
        name = (m[1] or m[5]).lower()
        if name not in ("class", "id", "role", "style", "hidden", "aria-hidden"):
            continue
        value = unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words = _words(value)
            if name == "class":
                node.words |= words
            else:
                node.ids |= words
        elif name == "role":
            node.junk |= value.strip().lower() in JUNK_ROLES
        elif name == "style":
            node.junk |= bool(_HIDDEN.search(value))
        else:
            node.junk |= name == "hidden" or value.strip().lower() == "true"


def parse(html: str) -> Node:
    """A tree of nodes whose items are nodes and pieces of text."""
    root = Node("#root", None)
    at, top, pos, endless = root, html.lower(), 0, set()
    if len(top) != len(html):  # lower-casing has moved places
        top = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
    match = _TAG.search
    while True:
        m = match(html, pos)
        if m is None:
            if pos < len(html):
                at.items.append(unescape(html[pos:]))
            return root
        if m.start() > pos:
            at.items.append(unescape(html[pos : m.start()]))
        pos = m.end()
        tag = m[3] or m[6]
        if tag is None:
            if m[1]:
                at.items.append(m[1])
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
            elif tag == "p" or tag == "br":
                at.items.append(Node(tag, at))
            continue
        attrs = m[4] or m[7] or ""
        if tag in CLOSES_P:
            at = _close(at, ("p",), root)
        if tag in CLOSED_BY:
            at = _close(at, CLOSED_BY[tag], root)
        if tag[0] == "h" and tag[1:].isdigit() and at.tag[0] == "h" and at.tag[1:].isdigit():
            at = at.parent
        node = Node(tag, at)
        if attrs:
            _describe(node, attrs)
        at.items.append(node)
        if tag in RAW:
            end = -1 if tag in endless else top.find("</" + tag, pos)
            if end < 0 and tag in ("script", "style", "textarea", "title"):
                return root
            if end < 0:  # never closed: an empty part, and the page goes on
                endless.add(tag)
                continue
            close = html.find(">", end)
            pos = len(html) if close < 0 else close + 1
        elif tag not in VOID and node.depth < MAX_DEPTH:
            at = node


def _close(at: Node, tags: tuple, root: Node) -> Node:
    """Close the innermost open element of ``tags``, up to its scope."""
    node = at
    while node is not root:
        if node.tag in tags:
            return node.parent
        if node.tag in SCOPE:
            break
        node = node.parent
    return at


def _no_text(node: Node) -> bool:
    """Whether a part is short, mostly links or has fields of a form."""
    size = links = 0
    todo = [(node, node.tag == "a")]
    while todo:
        at, in_link = todo.pop()
        for item in at.items:
            if not isinstance(item, Node):
                size += len(item.strip())
                links += len(item.strip()) * in_link
            elif item.tag in FORM:
                return True
            elif not item.junk:
                todo.append((item, in_link or item.tag == "a"))
    return size <= MIN_TEXT or links >= MAX_LINKS * size


def _junk_words(node: Node) -> bool:
    """Whether class and id tell of junk.  Headings and sections often have ids made of
    their titles: a section's id counts if it has no other words, a heading's never."""
    ids = node.ids
    if node.tag in HEADINGS or (node.tag == "section" and not ids <= JUNK_WORDS):
        ids = frozenset()
    found = (node.words | ids) & JUNK_WORDS
    if node.tag not in BLOCK:  # part of a sentence, unless it is an advert
        return bool(found & AD_WORDS)
    return bool(found - TOPIC_WORDS) or (bool(found) and node.tag not in HEADINGS and _no_text(node))


def _has_heading(node: Node) -> bool:
    return node.tag in HEADINGS or any(_has_heading(item) for item in node.items if isinstance(item, Node))


def _prune(node: Node, in_article: bool) -> bool:
    """Mark what isn't the article; true if the part holds an article, main or h1."""
    holds = node.tag in ("article", "main", "h1")
    inside = in_article or node.tag in ("article", "main")
    for item in node.items:
        if isinstance(item, Node) and not item.junk:
            holds |= _prune(item, inside)
    if node.tag in ("body", "html", "#root", "article", "main"):
        node.junk = node.junk and node.tag not in ("body", "html", "#root")
        return holds
    if node.tag == "header":
        node.junk |= not in_article
        for item in node.items:  # of an article's own header headings stay, and what reads like text
            if isinstance(item, Node) and item.tag in BLOCK and not _has_heading(item):
                item.junk |= _no_text(item)
    elif (node.words or node.ids) and not holds and not (node.tag in "h1 h2 h3 p span a b i em strong".split() and (node.words | node.ids) & GOOD_WORDS):
        node.junk |= _junk_words(node) or bool((node.words | node.ids) & HEADER_WORDS and not in_article and node.tag not in HEADINGS)
    return holds and not node.junk


def _measure(node: Node, in_link: bool) -> None:
    """Text, characters in links, and points passed to ancestors."""
    parts, links = [], 0
    in_link = in_link or node.tag == "a"
    block = node.tag in BLOCK
    own = []
    for item in node.items:
        if isinstance(item, Node):
            if item.junk:
                continue
            _measure(item, in_link)
            parts.append(item.text)
            links += item.links
            if item.tag not in BLOCK:
                own.append(item.text)
        else:
            parts.append(item)
            own.append(item)
            if in_link:
                links += len(item.strip())
    node.text = " ".join(parts) if block else "".join(parts)
    node.links = links
    if node.tag not in SCORED or in_link:
        return
    text = " ".join("".join(own).split())
    if len(text) < MIN_PARAGRAPH:
        return
    points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
    at = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") else node
    for share in _SHARES:
        if at is None or at.tag == "#root":
            break
        if at.score is None:
            at.score = 0.0
        at.score += points * share
        at = at.parent


def _density(node: Node) -> float:
    size = len(node.text.strip())
    return min(1.0, node.links / size) if size else 0.0


def _value(node: Node) -> float:
    prior = 5.0 if node.tag in ("article", "main") else 0.0
    if (node.words | node.ids) & GOOD_WORDS:
        prior += 5.0
    return (node.score + prior) * (1 - _density(node))


def _candidates(node: Node):
    for item in node.items:
        if isinstance(item, Node) and not item.junk:
            if item.score is not None:
                yield item
            yield from _candidates(item)


def _keep(node: Node) -> list[Node]:
    """The best container, or it and its good siblings, in page order."""
    best, most = None, 0.0
    for c in _candidates(node):
        value = _value(c)
        if value > most:
            best, most = c, value
    if best is None:
        found = [n for n in _all(node) if n.tag in ("article", "main")]
        return found[:1] or [n for n in _all(node) if n.tag == "body"][:1] or [node]
    at = best
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    if at is not None:
        _drop_link_lists(at)
        return [at]
    if best.tag in ("body", "html") or best.parent is None:
        return [best]
    kept = []
    for item in best.parent.items:
        if not isinstance(item, Node) or item.junk:
            continue
        good = item is best
        if not good and item.score is not None:
            good = _value(item) + (most * 0.2 if item.words | item.ids and item.words | item.ids == best.words | best.ids else 0) >= max(10, most * 0.2)
        text, dense = item.text.strip(), _density(item)
        good = good or (len(text) > MIN_TEXT and dense < MAX_LINKS)
        if not good and item.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol"):
            good = item.tag[0] == "h" or (0 < len(text) and dense == 0 and re.search(r"[.!?…](\s|$)", text) is not None)
        if good:
            kept.append(item)
    return kept


def _drop_link_lists(node: Node) -> None:
    """Inside an article, lists and sections that are mostly links score nothing, so they go."""
    for item in node.items:
        if isinstance(item, Node) and not item.junk:
            if item.tag in LISTS and _density(item) >= MOSTLY_LINKS and sum(n.tag == "a" for n in _all(item)) >= LEAST_LINKS:
                item.junk = True
            else:
                _drop_link_lists(item)


def _all(node: Node):
    for item in node.items:
        if isinstance(item, Node) and not item.junk:
            yield item
            yield from _all(item)


def _blocks(node: Node, out: list[list[str]]) -> None:
    block = node.tag in BLOCK
    if block:
        out.append([])
    for item in node.items:
        if isinstance(item, Node):
            if item.junk:
                continue
            if item.tag == "br" or item.tag in ("td", "th"):
                out[-1].append(" ")
            _blocks(item, out)
        else:
            out[-1].append(item)
    if block:
        out.append([])


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line; '' if there is none."""
    if not html:
        return ""
    root = parse(html)
    _prune(root, False)
    _measure(root, False)
    out: list[list[str]] = [[]]
    for node in _keep(root):
        _blocks(node, out)
    blocks = (" ".join("".join(parts).split()) for parts in out if parts)
    return "\n\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``.

    A null or empty page has the text ''; repeated rows are extracted each; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.

    A null or empty page has the text ''; repeated rows are extracted each; an empty table
    gives no rows.
    """
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
