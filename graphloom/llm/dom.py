"""Main-text extraction: a tree-structured graphical model over the DOM.

Every element is a binary variable: does its own text belong to the main text?  Its potential comes from local
features (tag, class words, text and link statistics of its subtree); an edge to the parent has a 2 x 2 potential
for each kind of child tag.  Sum-product messages go up and then down the tree and give exact marginals, which
training (the likelihood of labelled pages) uses too.  The labelled pages are drawn by ``labelled_pages`` from a
grammar of page layouts; others can be given to ``train``.
"""

from __future__ import annotations

import bisect
import html as html_lib
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import slices, table

MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: what stands in a tag after its name: a quote holds a ``>`` only after an equals sign and where it is closed
INSIDE = re.compile(r"(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+", re.S)
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend button summary dd dt li".split()) | frozenset("table dd dt li".split())
CLOSED_BY = {  # an open element that ends where one of these begins, unless a holder stands between
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
KINDS = {
    k: frozenset(v.split()) for k, v in {
        "page": "#root html body", "head": "head title meta link base", "article": "article main", "nav": "nav menu", "header": "header hgroup",
        "footer": "footer address", "aside": "aside dialog", "form": "form input select option optgroup textarea button label fieldset legend",
        "code": "script style noscript template iframe svg math object canvas audio video xmp noembed noframes", "p": "p", "heading": "h1 h2 h3 h4 h5 h6",
        "list": "ul ol dl", "item": "li dt dd", "link": "a", "box": "div section center", "table": "table tbody thead tfoot tr td th caption",
        "figure": "figure figcaption picture img", "quote": "blockquote pre code q cite", "inline": "",
    }.items()
}
KIND_OF = {tag: n for n, tags in enumerate(KINDS.values()) for tag in tags}
INLINE = len(KINDS) - 1
FRAME = frozenset("html body main".split())
LEAST_SHARE = 0.4  # of the page's text that a wrapper has at least
JUNK_TAGS = frozenset("nav footer aside dialog form menu button".split())
JUNK_WORDS = re.compile(
    r"(?<![a-z])(?:nav|navbar|navigation|menu|sidebar|side|rail|footer|foot|header|masthead|banner|ad|ads|adv|advert|advertisement|adsense|sponsor|sponsored|promo|promotion|"
    r"cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|breadcrumb|breadcrumbs|"
    r"related|recommended|trending|comment|comments|reply|replies|respond|disqus|login|search|widget|toolbar|pagination|pager|copyright|skip|"
    r"contentinfo|complementary|alert|dialog|alertdialog|form|tags|meta|byline|outbrain|taboola)(?:s|\d+)?(?![a-z])"
)
COMMENT_WORDS = re.compile(r"(?<![a-z])(?:comments?|replies|reply|respond|discussion|disqus|responses?)(?![a-z])")
#: names that say what a layout has, or has not, beside an element's text
LAYOUT = re.compile(r"(?<![a-z])(?:has|with|no|without)\s+[a-z]+")
#: names that wrappers and blocks of articles bear as often as junk does: prose within an article, or a name for text, outweighs them
WEAK = frozenset("widget social share sharing side rail meta byline tag header masthead banner alert skip".split())
TEXT_WORDS = re.compile(r"(?<![a-z])(?:article|content|post|entry|main|story|body|text|prose|blog|page|single)(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACES = re.compile(r"\s+")


@dataclass
class Page:
    tags: list[str]
    words: list[str]  # class, id, role and aria-label, lower case, '-' and '_' apart
    hidden: list[bool]
    parent: list[int]
    text: list[tuple[int, str]]  # (element, text or a block boundary as "\0") in page order


def parse(source: str | None) -> Page:
    """Elements and text of a page; never fails.  Missing end tags are implied, stray ones skipped."""
    page = Page(["#root"], [""], [False], [-1], [])
    stack, at = [0], 0
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
    seen_root: set[str] = set()
    source = source or ""
    quotes_hold = True

    def put(text: str) -> None:
        if text:
            page.text.append((stack[-1], html_lib.unescape(text) if "&" in text else text))

    def boundary(tag: str) -> None:
        if tag in BLOCK or tag == "br":
            page.text.append((stack[-1], "\0" if tag != "br" else " "))

    def close_to(depth: int) -> None:
        for node in stack[depth:]:
            if page.tags[node] in BLOCK:
                page.text.append((node, "\0"))
            open_at[page.tags[node]].pop()
        del stack[depth:]

    def nearest(tags: Iterable[str]) -> int:
        """Place in the stack of the innermost open element of these tags; 0 if there is none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def past(mark: str, start: int) -> tuple[int, int]:
        """Where ``mark`` stands from ``start`` on, and what follows it; the end of the page for both without one."""
        k = source.find(mark, start)
        return (k, k + len(mark)) if k >= 0 else (len(source), len(source))

    while True:
        m = MARKUP.search(source, at)
        if not m:
            break
        put(source[at : m.start()])
        if m[0] == "<!--":
            end = COMMENT_END.search(source, m.end())
            at = end.end() if end else len(source)
            continue
        if m[0] == "<![CDATA[":
            end, at = past("]]>", m.end())
            put(source[m.end() : end])
            continue
        if m[0] in ("<!", "<?"):
            at = past(">", m.end())[1]
            continue
        name = NAME.match(source, m.end() - 1)
        tag, closing = name[0].lower(), m[0][1] == "/"
        end = INSIDE.match(source, name.end()).end() if quotes_hold else source.find(">", name.end())
        if not 0 <= end < len(source):  # every ``>`` from here on is quoted: from now on quotes hold none
            quotes_hold = False
            end = source.find(">", name.end())
            if end < 0:
                put(source[m.start() :])
                at = len(source)
                break
        inside, at = source[name.end() : end], end + 1
        if closing:
            if open_at.get(tag):
                close_to(open_at[tag][-1])
            elif tag == "br":
                put(" ")
            continue
        if tag in CLOSES_P:
            depth = nearest(("p", "table", "button", "td", "th"))
            if depth and page.tags[stack[depth]] == "p":
                close_to(depth)
        if tag in CLOSED_BY:
            closed, holders = CLOSED_BY[tag]
            floor = nearest(holders)
            ends = [places[k] for t in closed if (places := open_at.get(t)) and (k := bisect.bisect_right(places, floor)) < len(places)]
            if ends:
                close_to(min(ends))
        attributes = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(inside)} if inside.strip() else {}
        if tag in ("html", "body"):
            if tag in seen_root:
                continue
            seen_root.add(tag)
        boundary(tag)
        if tag in VOID:
            continue
        node = len(page.tags)
        page.tags.append(tag)
        page.words.append(" ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().replace("_", "-").replace("-", " "))
        page.hidden.append("hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", ""))))
        page.parent.append(stack[-1])
        if inside.endswith("/") and tag in ("svg", "math", "path"):
            continue
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            put(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            open_at[tag].pop()
            stack.pop()
    put(source[at:])
    close_to(1)
    return page


FEATURES = ["bias", "junk_words", "comment_words", "text_words", "hidden", "own_text", "long_own_text", "link_density", "subtree_text", "sentences", "short", "copyright", "many_links", "in_junk", "in_article"] + [f"is_{k}" for k in KINDS]


def named(words: str) -> tuple[bool, bool, bool]:
    """Whether names call an element junk, whether only weakly, and whether they call it comments."""
    if not words:
        return False, False, False
    bare = LAYOUT.sub(" ", words)
    found = [re.sub(r"\d+$", "", x) for x in JUNK_WORDS.findall(bare)]
    return bool(found), bool(found) and all(x in WEAK or x.removesuffix("s") in WEAK for x in found), bool(COMMENT_WORDS.search(bare))


def called_junk(page: Page, total: np.ndarray, of_links: np.ndarray, stops: np.ndarray) -> list[bool]:
    """Elements whose tag or names call all that stands in them junk; of the text below each element ``total`` is the length,
    ``of_links`` that of links, ``stops`` the number of sentences and clauses.

    The names of the page's frame (``html``, ``body``, ``main``, an ``article`` that is no comment) say nothing about
    its text, nor do weak names of prose in an article or of what is named text as well, nor the names of a wrapper: an
    element with the better part of the page's prose (text that is neither links nor comments) that has a main heading,
    ``main`` or ``article`` in it, or the text where hardly any prose would be left that nothing calls junk.
    """
    n = len(page.tags)
    called, comment, article_up = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        tag, words, up = page.tags[k], page.words[k], page.parent[k]
        by_name, weak, comment[k] = named(words)
        text_named = bool(words and TEXT_WORDS.search(words))
        article_up[k] = article_up[up] or page.tags[up] == "main" or page.tags[up] == "article" and not comment[up]
        if tag in FRAME or tag == "article" and not (comment[k] and not text_named):
            continue
        if by_name and weak and tag not in JUNK_TAGS and not comment[k]:
            prose = total[k] >= 30 and of_links[k] < 0.3 * total[k] and stops[k] >= 2
            by_name = not (text_named or article_up[k] and prose)
        called[k] = tag in JUNK_TAGS or comment[k] or by_name
    if not any(called) or not total[0]:
        return called
    # what leads a page, and what is a list of comments: one without a main heading
    leads_below, text_below = [False] * n, [False] * n
    for k in range(n - 1, 0, -1):
        tag, up = page.tags[k], page.parent[k]
        leads_below[up] = leads_below[up] or leads_below[k] or tag in ("h1", "main")
        text_below[up] = text_below[up] or text_below[k] or bool(page.words[k] and TEXT_WORDS.search(page.words[k])) and not called[k]
    aside = np.zeros(n)  # text of comments below
    for k in range(n - 1, 0, -1):
        aside[page.parent[k]] += total[k] if called[k] and comment[k] and not leads_below[k] else aside[k]
    # links within comments are taken off once, with the comments
    prose = np.maximum(0, total - np.where(aside > 0, np.maximum(aside, of_links), of_links))
    if not prose[0]:
        prose = total
    every = float(prose[0])
    heading, article, inner = [False] * n, [False] * n, np.zeros(n)  # of what stands below; prose below called elements
    for k in range(n - 1, 0, -1):
        tag, up = page.tags[k], page.parent[k]
        inner[up] += prose[k] if called[k] else inner[k]
        if not called[k] or prose[k] >= LEAST_SHARE * every:
            heading[up] = heading[up] or heading[k] or tag in ("h1", "main")
            article[up] = article[up] or article[k] or tag == "article"
    free = every - float(inner[0])

    def pardon(fits) -> None:
        nonlocal free
        inside = [False] * n
        for k in range(1, n):
            inside[k] = inside[page.parent[k]]
            if inside[k] or not called[k]:
                continue
            # a list of comments may hold articles of its own
            leads = heading[k] or (article[k] and not comment[k])
            if fits(k, float(prose[k]) / every, leads):
                called[k] = False
                free += float(prose[k] - inner[k])
            else:
                inside[k] = True

    pardon(lambda k, share, leads: share >= LEAST_SHARE and leads)
    # where all prose is called junk, what holds a heading, an article or something named text is the text; else the most of it
    pardon(lambda k, share, leads: free < 0.05 * every and share >= 0.1 and not comment[k] and (leads or text_below[k]))
    pardon(lambda k, share, leads: free < 0.05 * every and share >= 0.5)
    return called


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    own, linked, stops, marks, links = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    in_link, junk, article = [False] * n, [False] * n, [False] * n  # so far down from the root
    for k in range(1, n):
        in_link[k] = page.tags[k] == "a" or in_link[page.parent[k]]
        links[k] = page.tags[k] == "a"
    for node, text in page.text:
        size = len(text.strip())
        if size and page.tags[node] not in KINDS["code"]:
            own[node] += size
            linked[node] += size if in_link[node] else 0
            stops[node] += text.count(". ") + text.count(",") + text.rstrip().endswith((".", "!", "?"))
            marks[node] += "©" in text
    whole = [x.copy() for x in (own, linked, stops, links)]
    for k in range(n - 1, 0, -1):  # children come after their parents
        for x in whole:
            x[page.parent[k]] += x[k]
    total, of_links, all_stops, all_links = whole
    called = called_junk(page, total, of_links, all_stops)
    for k in range(1, n):
        up, tag = page.parent[k], page.tags[k]
        junk[k] = junk[up] or called[k]
        article[k] = not junk[k] and (article[up] or tag in KINDS["article"])
    x = np.zeros((n, len(FEATURES)))
    for k in range(n):
        words = page.words[k]
        by_name, weak, comment = named(words)
        x[k, :15] = [
            1, by_name and not weak, comment, bool(words and TEXT_WORDS.search(words)), page.hidden[k],
            own[k] > 0, min(1, own[k] / 200), of_links[k] / max(1, total[k]), min(1, np.log1p(total[k]) / 8), min(1, all_stops[k] / 5),
            0 < total[k] < 25, marks[k] > 0, min(1, all_links[k] / 8), junk[k], article[k],
        ]
        x[k, 15 + KIND_OF.get(page.tags[k], INLINE)] = 1
    return x


@dataclass
class Forest:
    """Trees of several pages side by side, their elements by depth."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        first = np.cumsum([0, *(len(p.tags) for p in pages)])
        parent = np.array([a + x if x >= 0 else -1 for a, p in zip(first, pages) for x in p.parent], np.int64)
        kind = np.array([KIND_OF.get(t, INLINE) for p in pages for t in p.tags], np.int64)
        depth = np.zeros(len(parent), np.int64)
        for k, up in enumerate(parent.tolist()):
            if up >= 0:
                depth[k] = depth[up] + 1
        order = np.argsort(depth, kind="stable")
        return cls(parent, kind, np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else [])


FEW = 3


def _log_add(a: float, b: float) -> float:
    top, low = (a, b) if a >= b else (b, a)
    return top + math.log1p(math.exp(low - top))


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each element (n x 2) and of each parent-child pair (n x 2 x 2; roots: zeros).

    ``unary`` are log potentials (n x 2), ``pair`` those of (child kind, parent label, child label).
    """
    n = len(unary)
    up, below = np.zeros((n, 2)), unary.copy()  # message to the parent; what an element knows from below
    for level in forest.levels[:0:-1]:
        if len(level) <= FEW:  # deep and narrow: plain numbers are faster than short arrays
            for k in level.tolist():
                (a, b), (c, d) = pair[forest.kind[k]].tolist()
                x, y = below[k].tolist()
                up[k] = _log_add(a + x, b + y), _log_add(c + x, d + y)
                below[forest.parent[k]] += up[k]
            continue
        score = pair[forest.kind[level]] + below[level][:, None, :]
        up[level] = np.logaddexp(score[:, :, 0], score[:, :, 1])
        np.add.at(below, forest.parent[level], up[level])
    belief, both = below.copy(), np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        if len(level) <= FEW:
            for k in level.tolist():
                p, q = (belief[forest.parent[k]] - up[k]).tolist()
                (a, b), (c, d) = pair[forest.kind[k]].tolist()
                x, y = below[k].tolist()
                joint = (p + a + x, p + b + y, q + c + x, q + d + y)
                belief[k] = _log_add(joint[0], joint[2]), _log_add(joint[1], joint[3])
                top = max(joint)
                share = [math.exp(z - top) for z in joint]
                both[k] = np.array(share).reshape(2, 2) / sum(share)
            continue
        above = belief[forest.parent[level]] - up[level]
        joint = above[:, :, None] + pair[forest.kind[level]] + below[level][:, None, :]
        belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        both[level] = joint / joint.sum((1, 2), keepdims=True)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), both


@dataclass
class DomModel:
    weights: np.ndarray  # one for each feature: log odds of main text
    pair: np.ndarray  # child kind x parent label x child label

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        if not pages:
            return []
        x = np.concatenate([features(p) for p in pages])
        unary = np.stack([np.zeros(len(x)), x @ self.weights], 1)
        p, _ = sum_product(Forest.of(pages), unary, self.pair)
        return np.split(p[:, 1], np.cumsum([len(q.tags) for q in pages])[:-1])

    def extract(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s) for s in sources]
        return [text_of(page, p >= 0.5) for page, p in zip(pages, self.marginals(pages))]


def text_of(page: Page, main: np.ndarray) -> str:
    """Blocks of the chosen elements' text, each with single spaces, joined by one space."""
    out = [t if t == "\0" or main[node] else "" for node, t in page.text if t == "\0" or (main[node] and page.tags[node] not in KINDS["code"] | KINDS["head"])]
    return SPACES.sub(" ", "".join(" " if t == "\0" else t for t in out).replace("\0", " ")).strip()


def train(pages: list[tuple[Page, np.ndarray]], steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> DomModel:
    """Maximum likelihood of labelled pages (labels 0/1 for each element) with Adam steps."""
    forest = Forest.of([p for p, _ in pages])
    x = np.concatenate([features(p) for p, _ in pages])
    y = np.concatenate([label for _, label in pages]).astype(int)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    weights, pair = np.zeros(x.shape[1]), np.zeros((len(KINDS), 2, 2))
    moments = [np.zeros_like(z) for z in (weights, pair, weights, pair)]
    for step in range(1, steps + 1):
        p, both = sum_product(forest, np.stack([np.zeros(len(x)), x @ weights], 1), pair)
        hoped = np.zeros_like(seen)
        np.add.at(hoped, forest.kind[child], both[child])
        slopes = [x.T @ (y - p[:, 1]) / len(y) - ridge * weights, (seen - hoped) / len(y) - ridge * pair]
        for k, slope in enumerate(slopes):
            moments[k] = 0.9 * moments[k] + 0.1 * slope
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * slope**2
        weights, pair = (z + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) for z, m, v in zip((weights, pair), moments[:2], moments[2:]))
    return DomModel(weights, pair)


# --- labelled pages -------------------------------------------------------------------------------------------------


def _words(rng: random.Random, lo: int, hi: int) -> str:
    out = ["".join(rng.choices("aeioubcdlmnprst", k=rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))]
    for k in range(0, len(out), rng.randint(6, 14)):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += rng.choice([".", ".", ",", "?"])
    return " ".join(out) + rng.choice([".", ".", "", "!"])


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{k}">{_words(rng, 1, 3)}</a></li>' for k in range(n))


def _junk(rng: random.Random, inside: bool) -> str:
    """A piece of a page that is not its main text."""
    w = lambda a, b: _words(rng, a, b)
    name = rng.choice
    kinds = [
        lambda: f'<{(t := name(["div", "aside", "section"]))} class="{name(["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box"])}">{name(["", "<p>"])}{w(3, 25)}</{t}>',
        lambda: f'<div class="{name(["share", "social-share", "share-buttons"])}"><a href="#">{w(1, 1)}</a> <a href="#">{w(1, 1)}</a></div>',
        lambda: f'<aside{name(["", " class=related", " id=side"])}><h3>{w(1, 3)}</h3><ul>{_links(rng, rng.randint(2, 6))}</ul></aside>',
        lambda: f'<form action="/s" class="{name(["", "newsletter", "search-form"])}"><label>{w(1, 4)}</label><input name=q><button>{w(1, 1)}</button></form>',
        lambda: f"<script>var a = '{w(3, 9)}</p>';</script>",
        lambda: f"<style>.{w(1, 1)} {{color: red}}</style>",
        lambda: f"<nav><ul>{_links(rng, rng.randint(3, 8))}</ul></nav>",
        lambda: f'<div class="{name(["breadcrumb", "breadcrumbs", "pagination", "tags"])}"><a href="/">{w(1, 1)}</a> / <a href="/x">{w(1, 2)}</a></div>',
        lambda: f'<div class="{name(["cookie-notice", "cookie-banner", "consent", "notice", "popup", "modal"])}"{name(["", " role=dialog", " role=alert"])}><p>{w(6, 30)}</p><button>{w(1, 2)}</button></div>',
        lambda: f'<{(t := name(["section", "div"]))} {name(["class", "id"])}="{name(["comments", "comment-list", "discussion", "replies", "comments-area"])}"><h3>{w(1, 2)}</h3>'
        + "".join(name([f'<div class="comment"><b>{w(1, 2)}</b><p>{w(5, 60)}</p></div>', f'<li class="comment"><p>{w(5, 60)}</p></li>', f"<article><p>{w(5, 40)}</p></article>", f"<p>{w(5, 40)}</p>"]) for _ in range(rng.randint(1, 5)))
        + f"</{t}>",
        lambda: f'<div class="{name(["sidebar", "side-bar", "widget", "rail"])}"><h4>{w(1, 3)}</h4><p>{w(4, 30)}</p><ul>{_links(rng, rng.randint(1, 5))}</ul></div>',
        lambda: f"<aside><p>{w(5, 40)}</p></aside>",
        lambda: f'<div style="display:none"><p>{w(3, 20)}</p></div>',
    ]
    return rng.choice(kinds[:5] if inside and rng.random() < 0.7 else kinds)()


def _main(rng: random.Random) -> str:
    w = lambda a, b: _words(rng, a, b)
    parts = [f"<h1>{w(2, 9)}</h1>"] if rng.random() < 0.85 else []
    if rng.random() < 0.15:
        parts.insert(0, f"<header><h1>{w(2, 9)}</h1></header>")
    short = rng.random() < 0.15  # a page of one-line paragraphs
    for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 20])):
        if short:
            parts.append(rng.choice([f"<p>{w(1, 4)}</p>", f"<p><b>{w(1, 4)}<br>", f"<p>{w(1, 4)}"]))
            continue
        parts.append(rng.choice([
            lambda: f"<p>{w(8, 90)}</p>", lambda: f"<p>{w(8, 90)}</p>", lambda: f"<p>{w(1, 7)}</p>", lambda: f"<p>{w(20, 60)}", lambda: f"<p><b>{w(3, 60)}<br>",
            lambda: f"<p>{w(4, 20)} <a href='/y'>{w(1, 3)}</a> {w(4, 20)} <em>{w(1, 4)}</em></p>", lambda: f"<h2>{w(1, 6)}</h2>", lambda: f"<blockquote><p>{w(5, 40)}</p></blockquote>",
            lambda: "<ul>" + "".join(f"<li>{w(2, 20)}</li>" for _ in range(3)) + "</ul>", lambda: f"<div>{w(10, 60)}</div>", lambda: f"{w(5, 40)}<br><br>",
            lambda: f"<table><tr><td>{w(1, 4)}<td>{w(1, 4)}</tr></table>", lambda: f"<figure><img src=a><figcaption>{w(3, 12)}</figcaption></figure>", lambda: f"<pre><code>{w(3, 12)}</code></pre>",
            lambda: f"<section><h3>{w(1, 5)}</h3><p>{w(8, 70)}</p></section>", lambda: f"<ol><li><p>{w(4, 30)}</p><li>{w(2, 9)}</ol>",
        ])())
    return "".join(parts) or f"<p>{w(5, 30)}</p>"


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[Page, np.ndarray]]:
    """Pages drawn from a grammar of layouts, with 1 for the elements of the main text and 0 for all others."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = lambda a, b: _words(rng, a, b)  # noqa: E731,B023
        body = _main(rng)
        for _ in range(rng.choice([0, 0, 1, 2])):  # junk inside the article: between its blocks
            cut = rng.choice([m.end() for m in re.finditer(r"</(?:p|h1|h2|ul|div|table|figure|blockquote)>", body)] or [len(body)])
            body = f"{body[:cut]}<x-junk>{_junk(rng, True)}</x-junk>{body[cut:]}"
        if rng.random() < 0.2:  # blocks of a page builder, or an article in parts named after what stands beside or below it
            name = rng.choice(["elementor-widget elementor-widget-text-editor", "row with-sidebar", "social-section", "widget widget-text", "side-by-side", "wp-block-group has-share"])
            body = "".join(f'<div class="{name}">{part}</div>' if "<x-junk>" not in part else part for part in re.split(r"(?<=</p>)(?=<p>)", body))
            body = f"<article>{body}</article>" if rng.random() < 0.7 else f"<main>{body}</main>"
        opening, closing = rng.choice([
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<article class="post">', "</article>"), ('<div class="content">', "</div>"),
            ('<div id="main-content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"), ('<div class="article-body">', "</div>"),
            ("<div>", "</div>"), ('<div role="main">', "</div>"),
        ])
        before = [rng.choice([
            f"<header><div class=logo><a href='/'>{w(1, 2)}</a></div><nav><ul>{_links(rng, 5)}</ul></nav></header>", f"<nav><ul>{_links(rng, rng.randint(3, 9))}</ul></nav>",
            f'<div id="header"><h2>{w(1, 4)}</h2><p>{w(3, 9)}</p></div>', f'<div class="menu">{_links(rng, 4)}</div>',
        ])] if rng.random() < 0.9 else []
        before += [_junk(rng, False) for _ in range(rng.choice([0, 1, 1, 2]))]
        after = [_junk(rng, False) for _ in range(rng.choice([0, 1, 2]))]
        if rng.random() < 0.15:  # far more comments than text
            after.insert(0, f"<section class='{rng.choice(['comments', 'comment-list', 'comments-area'])}'>" + "".join(f'<div class="comment"><p>{w(20, 60)}</p></div>' for _ in range(rng.randint(6, 15))) + "</section>")
        if rng.random() < 0.9:
            after.append(rng.choice([f"<footer>&copy; {w(1, 3)} &middot; {w(3, 14)}</footer>", f"<footer><p>{w(5, 25)}</p><ul>{_links(rng, 3)}</ul></footer>", f'<div class="footer"><p>&copy; {w(3, 20)}</p></div>']))
        rng.shuffle(before)
        wrap = rng.choice([("", ""), ("<div class=wrapper>", "</div>"), ('<div id="page"><div class="container">', "</div></div>")])
        if rng.random() < 0.3:  # layouts named after what stands beside the text
            names = " ".join(rng.sample(["has-sidebar", "no-sidebar", "sidebar-right", "comments-open", "no-comments", "page-tags", "has-share", "has-banner", "widget-area", "one-side", "social-article", "layout"], rng.randint(1, 3)))
            wrap = rng.choice([(f'<div class="{names}">{wrap[0]}', f"{wrap[1]}</div>"), (f'<form action="/" class="{names}">{wrap[0]}', f"{wrap[1]}</form>"), (f'{wrap[0]}<section id="{names.split()[0]}">', f"</section>{wrap[1]}")])
        source = (
            f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{w(2, 8)}</title><style>p{{}}</style><script>x('</p>')</script></head><body>{wrap[0]}{''.join(before)}"
            f"<x-main>{opening}{body}{closing}</x-main>{''.join(after)}{wrap[1]}</body></html>"
        )
        if rng.random() < 0.04:
            source = f"<x-main>{rng.choice(['<p>', '', '<div>'])}{w(10, 80)}</x-main>"
        out.append(_labelled(parse(source)))
    return out


def _labelled(page: Page) -> tuple[Page, np.ndarray]:
    """Take the grammar's marks out of a page and label what stands in its main part."""
    n = len(page.tags)
    label, mark = np.zeros(n, bool), np.array([t in ("x-main", "x-junk") for t in page.tags])
    for k in range(1, n):
        label[k] = page.tags[k] == "x-main" or (label[page.parent[k]] and page.tags[k] != "x-junk" and page.tags[k] not in KINDS["code"])
    new = np.cumsum(~mark) - 1
    up = lambda k: up(page.parent[k]) if mark[k] else k
    keep = np.flatnonzero(~mark)
    bare = any(t == "x-main" and page.parent[k] == 0 for k, t in enumerate(page.tags))
    clean = Page([page.tags[k] for k in keep], [page.words[k] for k in keep], [page.hidden[k] for k in keep],
                 [int(new[up(page.parent[k])]) if k else -1 for k in keep], [(int(new[up(k)]), t) for k, t in page.text])
    labels = label[keep].copy()
    labels[0] = bare  # text straight in the page
    return clean, labels


_model: list[DomModel] = []


def default_model() -> DomModel:
    """Trained on the grammar's pages; the same on every machine."""
    if not _model:
        _model.append(train(labelled_pages()))
    return _model[0]


def extract_main_text(pages: DataFrame, model: DomModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: its main text and the code points in it.

    A null or empty page gives an empty text; repeated rows are each reported; nothing is cut short.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def extract(source: pd.Series) -> pd.Series:
        out, sources = [], source.tolist()
        for lo, hi in slices(sources, 64, 1 << 22):
            out += shared.value.extract(sources[lo:hi])
        return pd.Series(out, dtype=object)

    return pages.select("page_id", "url", extract("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
