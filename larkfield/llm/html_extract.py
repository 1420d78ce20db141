"""Main text of web pages: a linear-chain CRF over the DOM's leaf blocks, decoded by Viterbi.

A page becomes its sequence of text blocks, each with the roles of its ancestors (from tag names and the words of
class, id and role) and with features of its own text. Names that state a condition (``has-sidebar``, ``no-js``) give no
role, nor do names on html and body; an element that wraps nearly all text of a page is no menu, form or notice, whatever
its name (``WRAPPER``). Words that name a place or a topic as often as a part of the page (``WEAK``) count for little. Roles of the nearest ancestors that have any are told from those further out.

The model is trained once a driver process on pages from seeded generators that mark the article (``labelled_page``),
so it needs no table; ``FAMILIES`` differ in markup and names, and tests hold each out in turn. Scripts, styles, form
controls and templates are left out while reading; all other text, formulas and fallbacks included, is a block's.

Defined results: null, empty or text-free html gives the empty text; broken markup is read as far as it goes
(unclosed elements end with their parent, stray end tags are passed over); pages are read whole; repeated rows give
the same text, and so do ties of the decoder, which go to the rest of the page; an empty table stays empty; where
the decoder keeps nothing, running text outside menus, headers, footers and the like (by tag) is the page's text; input
columns of the names written (text, n_chars) are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkfield.llm import crf
from larkfield.llm.common import append_columns

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.DOTALL,
)
_OPEN_COMMENT = re.compile(r"<!--.*", re.DOTALL)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|data-truth|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: Elements whose content is no text, inline elements, void elements, and those that end their like.
SILENT = frozenset("script style template title textarea select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover "
    "munderover mstyle mfenced mpadded semantics annotation svg g text tspan path noscript object canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Roles of ancestors by tag, and by words of their class, id, role or itemprop.
ROLES = ("article", "main", "nav", "header", "footer", "aside", "ad", "form", "notice", "comment", "social", "list", "table", "heading", "para", "figure", "quote")
TAG_ROLES = {
    "article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "notice", "ul": "list", "ol": "list", "dl": "list",
    "table": "table", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "p": "para", "figure": "figure", "figcaption": "figure", "blockquote": "quote", "pre": "quote", "head": "header",
}
WORD_ROLES = {
    "article": "article articlebody post entry story content text body prose main",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs sitemap links skip",
    "header": "header masthead topbar logo branding hero site",
    "footer": "footer foot bottom copyright colophon legal credits",
    "aside": "aside sidebar side rail widget widgets related recommended popular trending tags complementary teaser teasers",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner adsense",
    "form": "form subscribe subscription newsletter login signup signin register search searchbox contact",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer warning paywall announcement toast",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback review reviews",
    "social": "share sharing social follow likes twitter facebook",
}
_BIT = {role: 1 << i for i, role in enumerate(ROLES)}
_TRUTH = 1 << len(ROLES)
_WORD_BIT = {word: _BIT[role] for role, words in WORD_ROLES.items() for word in words.split()}
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words by which a name states a condition of an element and not what it is.
STATES = frozenset("has have no not with without is are js enabled disabled supports show hide open closed active layout free".split())
#: Words that name a place or a topic as often as a part of the page. One counts only as the last
#: word of its name (generic ones aside), where no word of the same attribute names the article, and on an element of no more than ``LARGE`` of the text.
WEAK = frozenset("bottom foot top side rail legal credits site hero widget widgets".split())
LARGE = 0.4
#: Words that say no more than that there is an element, passed over at the end of a name.
GENERIC = frozenset("area list column col box block wrap wrapper container section inner bar panel item items module zone group".split())
#: Roles of what is not the article, and the share of a page's text beyond which an element with one is but a wrapper.
OUT = ("nav", "ad", "comment", "notice", "form", "aside", "footer", "social", "header")
_OUT = sum(_BIT[r] for r in OUT)
_IN = _BIT["article"] | _BIT["main"]
WRAPPER = 0.85
N_FEATURES = 2 * len(ROLES) + 25


@dataclass(frozen=True)
class Block:
    """``near`` are the roles of the innermost ancestor that has any, ``roles`` those of all ancestors."""

    text: str
    roles: int
    near: int
    linked: int
    tag: str
    #: Roles of all ancestors by their tags alone.
    tags: int = 0


def _mask(name: str, attrs: str) -> tuple[int, int]:
    """Roles of an element, and those that only weak words give it."""
    strong, weak = _BIT.get(TAG_ROLES.get(name, ""), 0), 0
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            if m[1].lower() == "data-truth":
                strong |= _TRUTH
            elif name not in ("html", "body"):
                firm = loose = 0
                for value in (m[2] or m[3] or m[4] or "").split():
                    words = [w.lower() for w in _CAMEL.findall(value)]
                    if STATES.isdisjoint(words):
                        for word in words:
                            if word not in WEAK:
                                firm |= _WORD_BIT.get(word, 0)
                        head = next((w for w in reversed(words) if w not in GENERIC), "")
                        loose |= _WORD_BIT.get(head, 0) if head in WEAK else 0
                # The main element is the page's own statement; names of its layout do not count against it.
                strong |= firm & ~_OUT if name == "main" else firm
                if not firm & _IN and name != "main":
                    weak |= loose
    return strong | weak, weak & ~strong


def blocks(page: str | None) -> list[Block]:
    """The text blocks in page order, white space made single, character references decoded."""
    leaves, elements = _leaves(page)
    sizes = [0] * len(elements)
    for text, element, _, _ in leaves:
        sizes[element] += len(text)
    for k in range(len(elements) - 1, 0, -1):  # elements come after their parents
        sizes[elements[k][0]] += sizes[k]
    roles, near, tags = [0] * len(elements), [0] * len(elements), [0] * len(elements)
    for k, (parent, mask, weak, by_tag) in enumerate(elements):
        if mask & _OUT and sizes[k] > WRAPPER * sizes[0]:
            mask &= ~_OUT
        elif weak & _OUT and sizes[k] > LARGE * sizes[0]:
            mask &= ~(weak & _OUT)
        roles[k] = roles[parent] | mask
        near[k] = mask & ~_TRUTH or near[parent]
        tags[k] = tags[parent] | by_tag
    return [Block(text, roles[k], near[k], linked, tag, tags[k]) for text, k, linked, tag in leaves]


def _leaves(page: str | None) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int, int, int]]]:
    """(text, element, linked characters, tag) in page order, and (parent, roles, weak roles, roles by tag) of the elements,
    the root first."""
    page = page or ""
    lower = None
    out: list[tuple[str, int, int, str]] = []
    elements: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]
    stack: list[tuple[str, int]] = [("", 0)]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, at = 0, False, 0
    last = page.rfind(">")  # beyond it no tag can end, so that none is looked for

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1][1], linked, stack[-1][0]))
            parts.clear()
        linked = 0

    while True:
        m = _TAG.search(page, at) if at <= last else _OPEN_COMMENT.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m.re is _OPEN_COMMENT:
            break
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if name in SILENT:
            if not end and not attrs.endswith("/"):
                lower = page.lower() if lower is None else lower
                close = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
                at = len(page) if close < 0 else close
            continue
        if name in INLINE:
            if name == "a":
                in_link = not end
            continue
        flush()
        if name in VOID:
            continue
        in_link = in_link and name not in ("p", "div", "ul", "nav", "article", "section", "footer")
        if end:
            if open_tags.get(name):
                while True:
                    popped = stack.pop()[0]
                    open_tags[popped] -= 1
                    if popped == name:
                        break
            continue
        if stack[-1][0] == "p" or (name in SELF_ENDING and stack[-1][0] == name):
            open_tags[stack.pop()[0]] -= 1
        if not attrs.endswith("/"):
            elements.append((stack[-1][1], *_mask(name, attrs), _BIT.get(TAG_ROLES.get(name, ""), 0)))
            stack.append((name, len(elements) - 1))
            open_tags[name] = open_tags.get(name, 0) + 1
    flush()
    return out, elements


def block_features(found: list[Block]) -> np.ndarray:
    n = len(found)
    rows = []
    for i, b in enumerate(found):
        size = len(b.text)
        words = b.text.count(" ") + 1
        link = b.linked / size
        last = b.text[-1]
        out_of, inside = b.roles & _OUT & ~_BIT["header"], b.roles & _IN
        commas = b.text.count(",") + b.text.count(". ")
        far = b.roles & ~b.near
        rows.append([1.0 if b.near >> k & 1 else 0.0 for k in range(len(ROLES))] + [1.0 if far >> k & 1 else 0.0 for k in range(len(ROLES))] + [
            1.0, bool(b.near & _IN) and bool(b.near & _OUT), bool(inside) and not out_of, bool(inside) and bool(out_of), not inside and not out_of, size < 20, 20 <= size < 80, 80 <= size < 200,
            size >= 200, words <= 2, words > 15, link > 0.2, link > 0.6, last in ".!?…\"”»", last == ":", commas > 1, "©" in b.text,
            b.text[:1].isupper(), sum(map(str.isdigit, b.text)) > 0.3 * size, i == 0, i == n - 1, b.tag in ("h1", "h2"), b.tag == "p",
            b.tag in ("div", "section", "td", "span"), b.tag == "li",
        ])
    return np.array(rows, dtype=float).reshape(n, N_FEATURES)


def main_text(page: str | None, model: crf.Crf) -> str:
    found = blocks(page)
    labels = model.decode(block_features(found)) if found else []
    if not any(labels):  # a page of prose is not empty: what its names say is passed over, then what the model says
        labels = [prose(b) and not b.tags & _OUT for b in found]
    return " ".join(b.text for b, keep in zip(found, labels) if keep)


def prose(block: Block) -> bool:
    """Running text: a sentence of some length that is not made of links."""
    return len(block.text) >= 60 and block.linked <= 0.2 * len(block.text) and bool(re.search(r"[.!?…]['\"”»)]*(\s|$)", block.text)) and "©" not in block.text


#: Kinds of generated pages: names and wrappers differ.
FAMILIES = ("plain", "blog", "portal", "docs", "any")
#: What a family puts on html and body, round the whole page and round the article.
_SHELLS = {
    "plain": (("",), ("",), ("",), ("<article>", "<main>", '<div class="content">', '<div id="post">', '<div class="article-body">', "<div>")),
    "blog": (
        ('class="no-js comments-enabled"', 'class="js"'), ('class="single post has-sidebar"', 'class="home blog with-sidebar comments-open"'),
        ('<div id="page" class="site">', '<div class="site-container">'), ('<article class="post hentry has-comments">', '<div class="entry-content">', '<section class="post-content">'),
    ),
    "portal": (
        ("",), ("", 'id="top"', 'class="advert-enabled"'), ('<form id="aspnetForm" action="x">', '<form method="post">', '<table><tr><td>', '<div class="wrapper sidebar-right">'),
        ('<div class="more content">', '<td class="story">', '<div id="storytext">', '<div class="col-8">'),
    ),
    "docs": (
        ('class="writer-html5"',), ('role="document"', 'class="wy-body-for-nav"'), ('<div class="document">', '<div class="layout-with-toc">', "<div>"),
        ('<div class="body" role="main">', '<main id="main-content" class="has-toc">', '<section id="introduction">', '<div itemprop="articleBody">'),
    ),
}


def labelled_page(rng: random.Random, family: str | None = None) -> str:
    """A page of random layout and words; elements of the article carry the attribute data-truth."""
    family = family or rng.choice(FAMILIES)
    shells = _SHELLS.get(family) or tuple(sum((s[k] for s in _SHELLS.values()), ()) for k in range(4))
    letters = rng.choice(["etaoinshrdlu", "enisratdhulä", "esaitnruléèç", "eaosrnidlcóñ", "абвгдежзиклм"])

    def word() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))

    def words(lo: int, hi: int) -> str:
        ws = [word() for _ in range(rng.randint(lo, hi))]
        for i in range(len(ws)):
            if rng.random() < 0.08:
                ws[i] += ","
        return " ".join([ws[0].capitalize(), *ws[1:]])

    junk = rng.random() < 0.12

    def sentence() -> str:
        text = words(1, 3) if rng.random() < 0.15 else words(4, 25)
        if junk:
            text = " ".join(w + rng.choice(["###", "$$$", "&amp;&amp;", "%%", "!!"]) for w in text.split())
        return text + rng.choice([".", ".", ".", ".", "!", "?", ""])

    def para() -> str:
        text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))
        if rng.random() < 0.2:
            cut = text.split(" ")
            k = rng.randrange(len(cut))
            cut[k] = rng.choice([f'<a href="/x">{cut[k]}</a>', f"<b>{cut[k]}</b>", f"<em>{cut[k]}</em>"])
            text = " ".join(cut)
        if rng.random() < 0.03:
            text += rng.choice([" <math><mi>x</mi><mo>=</mo><mn>2</mn></math>", f" <noscript>{word()}</noscript>", f" <svg><text>{word()}</text></svg>"])
        return text

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{words(1, rng.choice([1, 3, 8]))}</a>' for _ in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return rng.choice([" ", " | ", "<br>"]).join(items)

    def wrapped(tags: tuple, names: tuple, inner: str) -> str:
        tag = rng.choice(tags)
        label = rng.choice(names)
        if family in ("any", "portal", "docs"):  # any word of the role, alone or in a compound
            kinds = [r for r, ws in WORD_ROLES.items() if r in OUT and set(_CAMEL.findall(label)) & set(ws.split())]
            if kinds:
                label = rng.choice(WORD_ROLES[rng.choice(kinds)].split())
            label = rng.choice([label, label, f"{label}-{word()}", f"{word()}-{label}", f"{label} {word()}", f"x{label.capitalize()}"])
        if tag != "div" and rng.random() < 0.6:
            return f"<{tag}>{inner}</{tag}>"
        attr = rng.choice(["class", "class", "id"])
        return f'<{tag} {attr}="{label}">{inner}</{tag}>'

    def ad() -> str:
        return wrapped(("div", "div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo-box", "banner-ad", "ad-slot"), rng.choice([sentence(), para(), f"<p>{para()}</p>"]))

    def notice() -> str:
        return wrapped(("div", "section", "dialog"), ("cookie-notice", "consent", "notice", "alert", "cookie-banner", "popup", "disclaimer", "gdpr"), rng.choice([para(), f"<p>{para()}</p><button>{words(1, 2)}</button>"]))

    def form() -> str:
        inner = "".join(f"<label>{words(1, 3)}</label><input name='x'>" for _ in range(rng.randint(0, 3)))
        return wrapped(("form",), ("newsletter", "subscribe", "login", "search"), f"<p>{sentence()}</p>{inner}<button>{words(1, 2)}</button>")

    def aside() -> str:
        return wrapped(("aside", "div"), ("sidebar", "related", "widget", "side-bar", "recommended", "more-stories"), f"<h3>{words(1, 4)}</h3>" + rng.choice([links(rng.randint(2, 8)), f"<p>{para()}</p>"]))

    def comments() -> str:
        each = "".join(wrapped(("div", "article", "p", "li"), ("comment", "comment-body", "reply", "review"), rng.choice([f"<p>{para()}</p>", para()])) for _ in range(rng.randint(1, 5)))
        label = rng.choice(("comments", "comment-list", "reader-comments", "discussion", "user-comments", "responses comments"))
        return f'<{(t := rng.choice(("div", "section", "ol")))} {rng.choice(("id", "class"))}="{label}"><h3>{words(1, 3)}</h3>{each}</{t}>'

    def share() -> str:
        return wrapped(("div",), ("share", "social-links", "share-buttons"), links(3))

    def nav() -> str:
        return wrapped(("nav", "nav", "div"), ("menu", "navbar", "main-nav", "breadcrumbs", "pagination"), links(rng.randint(3, 9)))

    def header() -> str:
        return wrapped(("header", "div"), ("header", "masthead", "site-header", "topbar"), rng.choice([words(1, 4), f"<p>{sentence()}</p>", f"<h2>{words(1, 4)}</h2>", nav(), f"<div>{words(2, 8)}</div>{nav()}"]))

    def footer() -> str:
        inner = rng.choice([f"&copy; {word()}.example &middot; {para()}", f"<p>{para()}</p>", links(4), f"<p>&copy; {words(2, 6)}</p>{links(3)}"])
        return wrapped(("footer", "footer", "div"), ("footer", "site-footer", "copyright"), inner)

    body = []
    if rng.random() < 0.85:
        body.append(f"<h1>{words(1, 14)}</h1>")
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
        kind = rng.random()
        if kind < 0.72:
            body.append(rng.choice([f"<p>{para()}</p>", f"<p>{para()}</p>", f"<p>{para()}</p>", f"<p><b>{para()}<br><p>{para()}</p>", f"<p>{para()}"]))
        elif kind < 0.80:
            body.append(f"<{(t := rng.choice(('h2', 'h3')))}>{words(1, 8)}</{t}>")
        elif kind < 0.87:
            body.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.90:
            body.append(f"<blockquote><p>{para()}</p></blockquote>")
        elif kind < 0.92:
            body.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.94:
            body.append(f"<div>{para()}</div>")
        else:
            body.append("\0" + rng.choice([ad, aside, share, form, notice])())
    marked = "".join(b[1:] if b[0] == "\0" else re.sub(r"^<(\w+)", r"<\1 data-truth", re.sub(r"<br><p>", "<br><p data-truth>", b)) for b in body)
    marked = re.sub(r"data-truth(?=[ >])", 'data-truth="1"', marked)
    if rng.random() < 0.2:
        marked += comments()
    shell = rng.choice(shells[3])
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", shell)))
    main = f"{shell}{marked}{ends}"
    if rng.random() < 0.3:
        main = f"<main>{main}{rng.choice([ad, aside, comments, share])()}</main>"
    before = [f() for f in (header, nav, notice, ad, form) if rng.random() < 0.45]
    after = [f() for f in (ad, comments, aside, form, notice, share) if rng.random() < 0.3] + [footer()] * (rng.random() < 0.85)
    rng.shuffle(before)
    if rng.random() < 0.5:
        rng.shuffle(after)
    outer = rng.choice(shells[2])
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", outer)))
    page = f"{outer}{''.join(before)}{main}{''.join(after)}{ends}"
    return f"<!DOCTYPE html><html {rng.choice(shells[0])}><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body {rng.choice(shells[1])}>{page}</body></html>"


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    found = blocks(page)
    return found, [int(bool(b.roles & _TRUTH)) for b in found]


@lru_cache(maxsize=8)
def page_model(pages: int = 700, seed: int = 5, without: str | None = None) -> crf.Crf:
    """Trained on pages of all families, or of all but one."""
    rng = random.Random(seed)
    families = [f for f in FAMILIES if f != without and not (without and f == "any")]
    made = [labelled_blocks(labelled_page(rng, families[k % len(families)])) for k in range(pages)]
    return crf.fit([(block_features(b), y) for b, y in made if b], steps=160)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text (the article, blocks joined by single spaces) and n_chars (its code points)."""
    model = page_model()
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def compute(values: list) -> dict:
        texts = [main_text(v, model) for v in values]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return append_columns(pages, html, fields, compute)
