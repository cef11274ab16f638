"""Main text of web pages by tag-path ratios.

A page is cut in text blocks, each with its path of tags from the root; a block whose text is
mostly linked has ``a`` as its leaf. For every path the unlinked characters and the punctuation
marks a block are aggregated and fused: log(1 + characters * (1 + marks)), at most ``MOST``.
Runs of blocks of one path and one parent are laid out in page order. A run's score is its
path's value plus weights, smoothed with the runs beside it where that lifts it (a heading does
not sink its text), and the scores are thresholded against their mean by characters:

* Runs of ``STRONG`` times the mean or more are content wherever they stand. The innermost
  elements that hold half of the content's text or more are its container.
* Inside the container ``WITHIN`` times the mean is enough, so headings and short items between
  paragraphs stay, and link lists and other thin paths go, named or not.

Names only weigh: elements that are menus, heads, feet, sidebars, notices, adverts, forms or
comments by tag, role or a word of their class or id lose ``NAMED``; words that an article's own
section may bear too lose ``HINTED``; headings gain ``HEADING``; text outside ``article`` and
``main`` loses ``OUTSIDE`` where a page has text inside. A form that holds at least half of the page's
text is the page's frame and no form. Neighbours smooth each other only if they have the
same weight and are siblings (fully) or parent's siblings (half); link runs are not smoothed.
Scripts, styles, controls and hidden elements are no text at all.

Defined cases: a null or empty page, a page of links only and a page of named clutter only have
empty text; a page without tags is one block; tags left open are closed by their parents or by a
new block of their kind; a ``<`` that starts no tag is text; repeated rows are extracted again;
other columns are ignored by the query.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import text_pass

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
#: Elements whose start closes an open element of the same group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody", "tfoot"), "tbody": ("tr", "td", "th", "thead", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
BARRIER = frozenset("table ul ol dl select body html article section main div td th aside nav".split())
NO_TEXT = frozenset("head button select option menu svg canvas object audio video map math datalist".split()) | RAW
CLUTTER = frozenset("nav header footer aside form dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo banner sidebar nav navbar navigation menu
    breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription
    signup login share sharing comment comments commentlist disqus pagination pager toolbar topbar""".split()
)
#: Words that name clutter or a section of an article.
HINTS = frozenset("promotion alert social related recommended recommendations reply replies respond response form search widget skip side".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("html body article main".split())
MODIFIERS = frozenset("no not without with has is".split())
OWN = frozenset("article post entry content main story".split())
MARKS = re.compile(r"[.,;:!?…。，！？،؟]")
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in RAW}

MOST, STRONG, WITHIN = 8.0, 0.75, 0.4
NAMED, HINTED, HEADING, OUTSIDE = -6.0, -1.5, 2.0, -2.0
MIDDLE, BESIDE = 0.5, 0.25


class Node:
    """An element: parent, whether it holds no text, lies in article or main, lies in a link; its weight; its form."""

    __slots__ = ("tag", "up", "out", "body", "link", "weight", "form", "chars")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.up, self.chars = tag, up, 0
        if up is None:
            self.out, self.body, self.link, self.weight, self.form = False, False, False, 0.0, None
            return
        said, hidden = told(tag, attrs, up)
        self.out = up.out or hidden or tag in NO_TEXT
        self.body = up.body or tag in ("article", "main")
        self.link = up.link or tag == "a"
        self.weight = min(up.weight, said)
        self.form = self if tag == "form" else up.form


def told(tag: str, attrs: str, up: Node) -> tuple[float, bool]:
    """(weight of the element's names, whether it is hidden)."""
    weight = 0.0
    if tag in CLUTTER and tag != "form" and not (tag == "header" and up.body):  # an article's own header holds its title
        weight = NAMED
    if not attrs or tag in NEVER:
        return weight, False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return weight, True
        if name == "role" and value.lower() in ROLES and tag != "form":
            weight = NAMED
        elif name in ("class", "id"):
            weight = min([weight, *map(named, value.split())])
    return weight, False


def named(name: str) -> float:
    """Weight of one class or id; ``no-sidebar`` and the like have none."""
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()))
    found = words & WORDS
    if words & MODIFIERS or found == {"header"} and words & OWN:
        return 0.0
    return NAMED if found else HINTED if words & HINTS else 0.0


def text_blocks(page: str) -> list[tuple[Node, str, bool]]:
    """(element, text, whether it is mostly linked) of all blocks that are text, in page order."""
    root = Node("", "", None)
    here, out, parts, owner, linked = root, [], [], root, 0
    at, n = 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((owner, text, 2 * linked > sum(len(x.strip()) for x in parts)))
            parts, linked = [], 0

    def take(upto):
        nonlocal owner, linked
        if upto > at and not here.out:
            piece = page[at:upto]
            if not any(map(str.strip, parts)):
                owner = here
            parts.append(piece)
            if here.link:
                linked += len(piece.strip())

    while (m := TAG.search(page, at)) is not None:
        take(m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            if tag == "br" and parts:
                parts.append(" ")
            elif tag != "img":
                flush()
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                if inline and node.tag not in INLINE:
                    node = root  # an inline end tag doesn't close blocks
                    break
                node = node.up
            if node is not root:
                here = node.up
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if not inline:
            names = CLOSES.get(tag, ()) + ("p",)
            node = here
            while node is not root and (node.tag not in BARRIER or node.tag in names):
                if node.tag in names:
                    here = node.up
                    if node.tag != "p":
                        node = here
                        continue
                node = node.up
        here = Node(tag, m[3], here)
    take(n)
    flush()
    return out


def block_of(node: Node) -> Node:
    """The innermost element that is no inline one."""
    while node.tag in INLINE and node.up is not None:
        node = node.up
    return node


def path_of(node: Node, linked: bool) -> str:
    names = ["a"] if linked else []
    while node.up is not None:
        if node.tag not in INLINE:
            names.append(node.tag)
        node = node.up
    return "/".join(reversed(names))


class Run:
    """Neighbouring blocks of one path and one parent."""

    __slots__ = ("path", "leaf", "parent", "linked", "weight", "chars", "first", "last", "value", "score")

    def __init__(self, path, leaf, parent, linked, weight, first):
        self.path, self.leaf, self.parent, self.linked, self.weight, self.chars, self.first = path, leaf, parent, linked, weight, 0, first


def runs_of_page(blocks: list[tuple[Node, str, bool]]) -> tuple[list[Run], dict[str, float]]:
    """(runs, fused ratio of each path)."""
    sums: dict[str, list[int]] = {}
    forms: dict[Node, int] = {}
    runs: list[Run] = []
    total = in_body = 0
    for k, (owner, text, linked) in enumerate(blocks):
        leaf = block_of(owner)
        path = path_of(leaf, linked)
        s = sums.setdefault(path, [0, 0, 0])
        s[1] += 1
        if not linked:
            s[0] += len(text)
            s[2] += len(MARKS.findall(text))
        total += len(text)
        if owner.weight > NAMED:
            in_body += owner.body
        if owner.form is not None:
            forms[owner.form] = forms.get(owner.form, 0) + len(text)
        parent = leaf.up or leaf
        now = runs[-1] if runs else None
        if now is None or now.path != path or now.parent is not parent or now.weight[0] != owner.weight:
            now = Run(path, leaf, parent, linked, (owner.weight, owner), k)
            runs.append(now)
        now.last = k
        now.chars += len(text)
    for r in runs:
        weight, owner = r.weight
        if owner.form is not None and 2 * forms[owner.form] < total:
            weight = NAMED
        if in_body and not owner.body:
            weight += OUTSIDE
        r.weight = weight
    return runs, {p: min(MOST, math.log1p(c / k * (1 + m / k))) for p, (c, k, m) in sums.items()}


def kinship(a: Run, b: Run) -> float:
    """How far two neighbouring runs vouch for each other."""
    if a.weight != b.weight or a.linked or b.linked:
        return 0.0
    if a.parent is b.parent:
        return 1.0
    return 0.5 if a.parent is b.parent.up or b.parent is a.parent.up or a.leaf is b.parent or b.leaf is a.parent else 0.0


def score(runs: list[Run], fused: dict[str, float]) -> None:
    for r in runs:
        r.value = fused[r.path] + r.weight + (HEADING if r.leaf.tag in HEADINGS and not r.linked else 0)
    for k, r in enumerate(runs):
        sum_of, weight = MIDDLE * r.value, MIDDLE
        for j in (k - 1, k + 1):
            if 0 <= j < len(runs) and (kin := kinship(r, runs[j])):
                sum_of += BESIDE * kin * runs[j].value
                weight += BESIDE * kin
        r.score = max(r.value, sum_of / weight)


def chosen_runs(runs: list[Run]) -> list[Run]:
    """The runs that are content, by the two thresholds."""
    likely = [r for r in runs if r.score > 0 and r.weight > NAMED]
    if not likely:
        return []
    mean = sum(r.score * r.chars for r in likely) / sum(r.chars for r in likely)
    sure = [r for r in likely if r.score >= STRONG * mean]
    total = sum(r.chars for r in sure)
    held: dict[Node, int] = {}
    for r in sure:
        node = r.parent
        while node is not None:
            held[node] = held.get(node, 0) + r.chars
            node = node.up
    # the innermost elements with half of the text: no element inside them has as much
    half = {n for n, c in held.items() if 2 * c >= total}
    inner = half - {n.up for n in half}

    def inside(node):
        while node is not None:
            if node in inner:
                return True
            node = node.up
        return False

    return [r for r in runs if r.score >= STRONG * mean and r.weight > NAMED or r.score >= WITHIN * mean and inside(r.parent)]


def main_text(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    blocks = text_blocks(page)
    runs, fused = runs_of_page(blocks)
    score(runs, fused)
    return " ".join(text for r in chosen_runs(runs) for _, text, _ in blocks[r.first : r.last + 1])


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``text`` (never null) and ``n_chars`` (its code points)."""

    def kernel(col: pa.Array) -> list[pa.Array]:
        texts = [main_text(x.as_py()) for x in col]
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return text_pass(df, html_col, kernel, "text string, n_chars bigint", keep)


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"])
