"""HTML extraction against a slow plain version, and pages on which only the ratios can decide."""

import html
import math
import random

import pytest

from hearthframe.llm import html_extract

LONG = "A first sentence, long enough; a second one, too. " * 4
TEXT = LONG.strip()


def test_unnamed_clutter_without_article(monkeypatch):
    menu = "<div><ul><li>Home</li><li>News</li><li>Shop</li></ul></div>"
    links = "<ul><li><a href=1>Some linked story, with a longer name</a></li><li><a>Another one of them</a></li></ul>"
    foot = "<div><div>2020 Some company. All rights reserved.</div></div>"
    page = f"<body>{menu}<div><section><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></section></div>{links}{foot}</body>"
    want = f"Title {TEXT} Short one. {TEXT}"
    assert html_extract.main_text(page) == want
    inside = f"<body><article><h1>Title</h1><p>{LONG}</p>{links}<h2>Part</h2><p>{LONG}</p><ul><li>First point, short.</li><li>Yes.</li></ul><p>{LONG}</p></article></body>"
    got = f"Title {TEXT} Part {TEXT} First point, short. Yes. {TEXT}"
    assert html_extract.main_text(inside) == got
    # with one ratio for all paths neither comes out right
    measured = html_extract.runs_of_page

    def flat(blocks):
        runs, fused = measured(blocks)
        return runs, dict.fromkeys(fused, 5.0)

    monkeypatch.setattr(html_extract, "runs_of_page", flat)
    assert html_extract.main_text(page) != want and html_extract.main_text(inside) != got


def test_markup_does_not_leak():
    for script in ("<!-- x ", "it's a<b and c>d", 'var s = "<!--', "if (a<b && c>'d') {"):
        page = f"<body><article><script>{script}</script><p>{LONG}</p></article><nav>Menu, of things.</nav></body>"
        assert html_extract.main_text(page) == TEXT, script
    assert html_extract.main_text(f"<body><p>{LONG}</p><!-- <p>{LONG}</p> --><style>p > a{{}}</style></body>") == TEXT


def test_forms_and_ambiguous_names():
    frame = f"<body><form id='aspnetForm'><nav><a>Menu</a></nav><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><footer>Foot, foot.</footer></form></body>"
    assert html_extract.main_text(frame) == f"Title {TEXT} {TEXT}"
    small = f"<body><div><p>{LONG}</p><p>{LONG}</p><form><p>Your name, please. Your mail, too.</p></form></div></body>"
    assert html_extract.main_text(small) == f"{TEXT} {TEXT}"
    for name in ("related-work", "form-fields", "promotion-test", "search-results"):
        page = f"<body><article><h1>Title</h1><p>{LONG}</p><section class='{name}'><p>{LONG}</p></section><p>{LONG}</p></article></body>"
        assert html_extract.main_text(page) == f"Title {TEXT} {TEXT} {TEXT}", name
    comments = f"<body><article><p>{LONG}</p><div class='comments'><p>{LONG}</p><p>{LONG}</p></div></article><div id='comments'><p>{LONG * 9}</p></div></body>"
    assert html_extract.main_text(comments) == TEXT


def test_long_and_odd_pages():
    words = "word, " * 200_000
    assert html_extract.main_text(f"<article><h1>T</h1><p>{words}</p></article>") == f"T {words.strip()}"
    deep = "<div>" * 3000 + f"<p>{LONG}</p>"
    assert html_extract.main_text(deep) == TEXT
    assert html_extract.main_text("<nav>Only a menu.</nav><footer>And a foot.</footer>") == ""
    assert html_extract.main_text("<ul><li><a>One</a></li><li><a>Two</a></li></ul>") == ""


class Box:
    def __init__(self, tag, cls, up):
        self.tag, self.cls, self.up, self.kids = tag, cls, up, []

    def line(self):
        return [self] + (self.up.line() if self.up else [])


def grow(rng, up, depth, blocks):
    """A random tree; blocks in page order as (box, text, linked)."""
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "p", "h2", "li", "div", "section", "nav", "footer", "article"] if depth < 3 else ["p", "h2"])
        if kind == "li":
            box = Box("ul", None, up)
            up.kids.append(box)
            for _ in range(rng.randint(1, 3)):
                leaf = Box("li", None, box)
                box.kids.append(leaf)
                leaf.kids.append((words(rng, 6), rng.random() < 0.5))
                blocks.append((leaf, *leaf.kids[0]))
            continue
        box = Box(kind, rng.choice([None, None, "comments", "story", "related", "ad"]) if kind in ("div", "section") else None, up)
        up.kids.append(box)
        if kind in ("p", "h2"):
            box.kids.append((words(rng, 60 if kind == "p" else 5), kind == "p" and rng.random() < 0.1))
            blocks.append((box, *box.kids[0]))
        else:
            grow(rng, box, depth + 1, blocks)


def words(rng, most):
    return " ".join(rng.choice(["tea", "house,", "river.", "of", "stone;", "a"]) for _ in range(rng.randint(1, most)))


def spell(box):
    if isinstance(box, tuple):
        text, linked = box
        return f"<a href='#'>{html.escape(text)}</a>" if linked else html.escape(text)
    named = f" class='{box.cls}'" if box.cls else ""
    return f"<{box.tag}{named}>{''.join(map(spell, box.kids))}</{box.tag}>"


def plain(blocks):
    """The docstring's rules, block by block, without running sums."""
    if not blocks:
        return ""

    def names(box):
        low = 0.0
        for b in box.line():
            if b.tag in ("nav", "footer") or b.cls in ("comments", "ad"):
                return -6.0
            if b.cls == "related":
                low = -1.5
        return low

    def in_body(box):
        return any(b.tag == "article" for b in box.line())

    path = [tuple(b.tag for b in box.line()) + (("a",) if linked else ()) for box, _, linked in blocks]
    bodied = any(in_body(box) and names(box) > -6 for box, _, _ in blocks)
    own = []
    for k, (box, _, linked) in enumerate(blocks):
        alike = [(t, ln) for p, (_, t, ln) in zip(path, blocks) if p == path[k]]
        chars = sum(len(t) for t, ln in alike if not ln) / len(alike)
        marks = sum(sum(c in ".,;:" for c in t) for t, ln in alike if not ln) / len(alike)
        weight = names(box) - (2.0 if bodied and not in_body(box) else 0.0)
        own.append((min(8.0, math.log(1 + chars * (1 + marks))) + weight + (2.0 if box.tag == "h2" and not linked else 0.0), weight))
    groups = []
    for k, (box, _, _) in enumerate(blocks):
        j = k - 1
        if k and path[k] == path[j] and box.up is blocks[j][0].up and names(box) == names(blocks[j][0]):
            groups[-1].append(k)
        else:
            groups.append([k])

    def kin(a, b):
        (x, _, lx), (y, _, ly) = blocks[a], blocks[b]
        if lx or ly or own[a][1] != own[b][1]:
            return 0.0
        if x.up is y.up:
            return 1.0
        return 0.5 if x.up is y.up.up or y.up is x.up.up else 0.0

    score = {}
    for g, members in enumerate(groups):
        top, low = 0.5 * own[members[0]][0], 0.5
        for h in (g - 1, g + 1):
            if 0 <= h < len(groups):
                w = 0.25 * kin(members[0], groups[h][0])
                top, low = top + w * own[groups[h][0]][0], low + w
        for k in members:
            score[k] = max(own[members[0]][0], top / low)
    free = [k for k, (box, _, linked) in enumerate(blocks) if score[k] > 0 and not linked and own[k][1] > -6]
    if not free:
        return ""
    size = lambda ks: sum(len(blocks[k][1]) for k in ks)
    mean = sum(score[k] * len(blocks[k][1]) for k in free) / size(free)
    sure = [k for k in free if score[k] >= 0.75 * mean]
    over = {id(a): a for k in sure for a in blocks[k][0].up.line()}
    half = [a for a in over.values() if 2 * size(k for k in sure if a in blocks[k][0].up.line()) >= size(sure)]
    inner = [a for a in half if not any(b.up is a for b in half)]
    keep = [k for k, (box, _, linked) in enumerate(blocks) if not linked and (own[k][1] > -6 and score[k] >= 0.75 * mean or score[k] >= 0.4 * mean and any(a in inner for a in box.up.line()))]
    return " ".join(blocks[k][1] for k in keep)


@pytest.mark.parametrize("seed", range(300))
def test_against_plain_version(seed):
    rng = random.Random(seed)
    top = Box("html", None, Box("", None, None))
    body = Box("body", None, top)
    blocks = []
    grow(rng, body, 0, blocks)
    assert html_extract.main_text(f"<html>{spell(body)}</html>") == plain(blocks)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(df).count() == 0
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>")] * 3, "page_id bigint, url string, html string")
    assert [r.text for r in html_extract.extract(df).collect()] == [TEXT] * 3
