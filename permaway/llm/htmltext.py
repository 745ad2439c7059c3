"""Main text of web pages: boosted trees over the nodes of the document tree.

A page becomes a tree of block elements, of inline elements with a class, id or
role, and of the loose text between blocks.  Boosted trees give every node the
log-odds that its whole subtree is no part of the article.  Decoding is
hierarchical: a node is either cut with all below it or passed, and the choice
with the largest likelihood over the tree is found bottom-up, so that no kept
node stands below a cut one.

The trees are trained here, on pages that ``training_page`` composes (many
layouts, class vocabularies, sizes and omissions, with the truth known by
construction).

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by two line feeds; scripts, styles and other
elements without readable text never count.  Defined cases: null or empty html
gives the empty text; a page that ends within a tag loses that tag; of an element
without readable text that is never closed only the tag goes, except that the
raw text of ``RAW`` ends with the page; repeated rows give equal results.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm import gbdt
from permaway.llm.storage import arrow_batches

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no readable text of the page.
SILENT = frozenset("script style noscript template title svg math iframe object canvas audio video select textarea button datalist map".split())
#: Of those, elements whose content is no markup.
RAW = frozenset("script style title textarea".split())
#: Of those, elements that "/>" closes.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param frame basefont".split())
#: What an opening tag closes first, if it stands open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NO_PARAGRAPH_INSIDE = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}

BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot bottom topbar top sidebar side aside rail widget notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login form search share sharing social follow comment comments reply replies disqus discussion responses related recommended more trending popular tags pagination pager meta byline toolbar tools hidden skip copyright legal".split()
)
GOOD_WORDS = frozenset("article content main post body entry story text prose copy page single paragraph".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-label|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: Comments and raw text, which hold no tags, and tags of other silent elements.
_SILENT_TAG = re.compile(rf"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<({'|'.join(sorted(RAW))})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)({'|'.join(sorted(SILENT - RAW))})(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)


def _silent_ends(source: str) -> dict[int, int]:
    """Where each silent element with markup ends, by where it starts; those that are never closed are left out."""
    ends: dict[int, int] = {}
    unclosed: dict[str, list[int]] = {}
    for m in _SILENT_TAG.finditer(source):
        if m[3]:
            name = m[3].lower()
            if not m[2]:
                if name not in FOREIGN or not m[4].endswith("/"):
                    unclosed.setdefault(name, []).append(m.start())
            elif starts := unclosed.get(name):
                ends[starts.pop()] = m.end()
    return ends


class Page:
    """The nodes of a page in page order, and its text segments with their block and node."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.marks = ["#root"], [-1], [0], [""]
        self.segments: list[tuple[int, int, str, bool]] = []  # block, node, text, inside a link
        self.truth: list[int] = []
        self._build(source or "")

    def _open(self, tag: str, parent: int, marks: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.marks.append(marks)
        return len(self.tag) - 1

    def _build(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # every open element with its node, or that of its nearest ancestor that is one
        block = at = links = 0
        n = len(source)
        silent: dict[int, int] | None = None
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.segments.append((block, stack[-1][1], source[at:lt], links > 0))
            if lt == n:
                break
            m = _TAG.match(source, lt)
            if m is None:
                nxt = source[lt + 1 : lt + 2]
                if nxt in ("!", "?", "/") and (c := _COMMENT.match(source, lt)):
                    at = c.end()
                elif nxt.isalpha() and nxt.isascii():
                    gt = source.find(">", lt)  # a quote that never ends, or the page ends in the tag
                    at = n if gt < 0 else gt + 1
                else:
                    self.segments.append((block, stack[-1][1], "<", links > 0))
                    at = lt + 1
                continue
            at = m.end()
            closing, name, rest = m[1], m[2].lower(), m[3]
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                if name in BLOCKS:
                    block += 1
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name not in BLOCKS and stack[k][0] in BLOCKS:
                        break
                continue
            if name == "head":  # what may stand in it is silent or void; all else ends it
                continue
            if name in RAW:
                end = _END[name].search(source, at)
                at = end.end() if end else n
                continue
            if name in SILENT:
                if silent is None:
                    silent = _silent_ends(source)
                at = silent.get(lt, at)
                continue
            if name in BLOCKS:
                block += 1
                links = 0
                if name in NO_PARAGRAPH_INSIDE:
                    self._close(stack, {"p"})
                if name[0] == "h" and name[1:].isdigit():
                    self._close(stack, {"h1", "h2", "h3", "h4", "h5", "h6"})
                if name in CLOSES:
                    self._close(stack, CLOSES[name], {"ul", "ol", "dl", "table"})
                if name not in ("html", "hr"):
                    stack.append((name, self._open(name, stack[-1][1], rest)))
                continue
            if name in VOID:
                if name == "br":
                    self.segments.append((block, stack[-1][1], " ", False))
                continue
            if rest.endswith("/"):
                continue
            links += name == "a"
            node = stack[-1][1]
            if rest and name != "a" and _ATTRIBUTE.search(rest):
                node = self._open(name, node, rest)
            stack.append((name, node))

    @staticmethod
    def _close(stack: list[tuple[str, int]], names: set[str], within: set[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in within or stack[k][0] in BLOCKS and not within:
                return

    def loose(self) -> None:
        """Gives the text that stands between blocks a node of its own."""
        has_block = [False] * len(self.tag)
        for t, p in zip(self.tag, self.parent, strict=True):
            if p >= 0 and t in BLOCKS:
                has_block[p] = True
        made: dict[tuple[int, int], int] = {}
        for k, (block, node, text, link) in enumerate(self.segments):
            if has_block[node] and not text.isspace():
                key = (block, node)
                if key not in made:
                    made[key] = self._open("#text", node, "")
                self.segments[k] = (block, made[key], text, link)

    def text(self, kept: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for block, node, text, _ in self.segments:
            if kept[node]:
                blocks.setdefault(block, []).append(text)
        out = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks.values())
        return "\n\n".join(b for b in out if b)


TAG_GROUPS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "heading", "list", "item", "table", "cell", "figure", "quote", "body", "#text", "inline", "#root")
_GROUP = {t: t for t in TAG_GROUPS} | {f"h{k}": "heading" for k in range(1, 7)} | {t: "list" for t in ("ul", "ol", "dl", "menu", "dir")} | {t: "item" for t in ("li", "dt", "dd")}
_GROUP |= {t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr")} | {"td": "cell", "th": "cell", "figcaption": "figure", "blockquote": "quote", "pre": "quote", "fieldset": "form", "legend": "form", "search": "form", "dialog": "aside"}
FEATURES = (*(f"tag_{t}" for t in TAG_GROUPS), "depth", "bad", "good", "hidden", "bad_above", "good_above", "log_text", "link_share", "log_tags", "text_per_tag", "stops", "words_per_stop", "place", "siblings", "same_tag", "share_of_parent", "before", "after", "blocks", "has_heading", "share_of_page")


def _marks(rest: str) -> tuple[int, int, bool]:
    """Bad and good attribute tokens, and whether the element is hidden."""
    bad = good = 0
    hidden = False
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden" or name == "aria-hidden" and value != "false":
            hidden = True
        else:
            tokens = _TOKEN.findall(value)
            bad += sum(t in BAD_WORDS for t in tokens)
            good += sum(t in GOOD_WORDS for t in tokens)
            if name == "role":
                bad += sum(t in ("complementary", "contentinfo", "navigation", "banner") for t in tokens)
    return bad, good, hidden


def features(page: Page) -> np.ndarray:
    """One row per node, in the order of ``FEATURES``."""
    n = len(page.tag)
    length, linked, stops, tags, blocks, heading = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    for _, node, text, link in page.segments:
        size = len(text.strip())
        length[node] += size
        linked[node] += size * link
        stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
    children: list[list[int]] = [[] for _ in range(n)]
    bad, good, hidden, bad_above, good_above = [0] * n, [0] * n, [False] * n, [0] * n, [0] * n
    for v in range(n):
        if page.marks[v]:
            bad[v], good[v], hidden[v] = _marks(page.marks[v])
        p = page.parent[v]
        if p >= 0:
            children[p].append(v)
            bad_above[v] = bad_above[p] or bad[p] > 0 or page.tag[p] in ("nav", "footer", "aside", "header", "form")
            good_above[v] = good_above[p] or good[p] > 0 or page.tag[p] in ("article", "main")
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        heading[v] |= page.tag[v] in ("h1", "h2", "h3")
        for x in (length, linked, stops, tags):
            x[p] += x[v]
        blocks[p] += blocks[v] + (page.tag[v] in BLOCKS)
        heading[p] |= heading[v]
    out = np.zeros((n, len(FEATURES)))
    k0 = len(TAG_GROUPS)
    order = [0] * n
    same = [0] * n
    for kids in children:
        counts: dict[str, int] = {}
        for i, v in enumerate(kids):
            order[v] = i
            counts[page.tag[v]] = counts.get(page.tag[v], 0) + 1
        for v in kids:
            same[v] = counts[page.tag[v]]
    total = max(1, length[0])
    for v in range(n):
        p = page.parent[v]
        kids = children[p] if p >= 0 else [v]
        i = order[v]
        out[v, TAG_GROUPS.index(_GROUP.get(page.tag[v], "inline" if page.tag[v] not in BLOCKS else "div"))] = 1
        out[v, k0:] = (
            page.depth[v], min(bad[v], 3), min(good[v], 3), hidden[v], bad_above[v], good_above[v], math.log1p(length[v]), linked[v] / max(1, length[v]),
            math.log1p(tags[v]), length[v] / tags[v], 100 * stops[v] / max(20, length[v]), length[v] / (1 + stops[v]), i / max(1, len(kids) - 1), math.log1p(len(kids)),
            math.log1p(same[v]), length[v] / max(1, length[p]) if p >= 0 else 1.0, math.log1p(length[kids[i - 1]]) if i else -1.0, math.log1p(length[kids[i + 1]]) if i + 1 < len(kids) else -1.0,
            math.log1p(blocks[v]), heading[v], length[v] / total,
        )
    return out


def decode(parent: list[int], cut: np.ndarray) -> np.ndarray:
    """From log-odds of being cut: which nodes stay, so that whatever stands below a cut node is cut, too."""
    n = len(parent)
    whole = cut.copy()  # gain of cutting the node with all below it, against passing all of them
    best = np.zeros(n)
    below = np.zeros(n)
    pick = np.zeros(n, bool)
    for v in range(n - 1, -1, -1):
        pick[v] = v > 0 and whole[v] > below[v]
        best[v] = max(whole[v], below[v]) if v else below[v]
        if v:
            whole[parent[v]] += whole[v]
            below[parent[v]] += best[v]
    kept = np.ones(n, bool)
    for v in range(1, n):
        kept[v] = kept[parent[v]] and not pick[v]
    return kept


class Extractor:
    def __init__(self, trees: gbdt.Trees):
        self.trees = trees

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s) for s in sources]
        for p in pages:
            p.loose()
        rows = [features(p) for p in pages]
        odds = self.trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for page, r in zip(pages, rows, strict=True):
            out.append(page.text(decode(page.parent, odds[at : at + len(r)])))
            at += len(r)
        return out


# ---- training pages

_SYLLABLES = "an be con da el for ga hi in jo ka lo mer nu or per qui ra sta ti un ver wo xi ya zo ñe é ü ть ий 的".split()


def _words(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() if k == 0 or out[-1].endswith(".") else w)
        if rng.random() < 0.12:
            out[-1] += rng.choice(".,.,;")
    return " ".join(out) + rng.choice((".", ".", ".", "?", "!", ""))


def _attr(rng: random.Random, *names: str) -> str:
    if not names or rng.random() < 0.25:
        return ""
    name = rng.choice(names)
    return f' {rng.choice(("class", "class", "id"))}="{rng.choice(("", "site-", "page-", "c-", "js-"))}{name}{rng.choice(("", "", "-wrap", "-inner", "-1"))}"'


def _links(rng: random.Random, n: int) -> str:
    wrap = rng.choice((("<ul>", "<li>", "</li>", "</ul>"), ("", "", " | ", ""), ("<div>", "<span>", "</span>", "</div>")))
    return wrap[0] + "".join(f'{wrap[1]}<a href="/{k}">{_words(rng, rng.randint(1, 3)).strip(".?!")}</a>{wrap[2]}' for k in range(n)) + wrap[3]


def _boilerplate(rng: random.Random, kind: str) -> str:
    w = lambda a, b: _words(rng, rng.randint(a, b))
    match kind:
        case "menu":
            t = rng.choice(("nav", "nav", "div", "ul"))
            return f"<{t}{_attr(rng, 'nav', 'menu', 'navbar', 'navigation') if t != 'nav' else ''}>{_links(rng, rng.randint(2, 12))}</{t}>"
        case "header":
            t = rng.choice(("header", "header", "div"))
            inner = rng.choice((f"<h1>{w(1, 4)}</h1>", f"<p>{w(1, 6)}</p>", f"<a href='/'>{w(1, 3)}</a>", w(1, 5)))
            return f"<{t}{_attr(rng, 'header', 'masthead', 'topbar') or (' class=header' if t == 'div' else '')}>{inner}{_boilerplate(rng, 'menu') if rng.random() < 0.4 else ''}</{t}>"
        case "footer":
            t = rng.choice(("footer", "footer", "div"))
            body = rng.choice((f"&copy; example.net &middot; {w(3, 30)}", f"<p>&copy; 2020 {w(2, 9)}</p>{_links(rng, 3)}", f"<p>{w(5, 40)}</p>", _links(rng, 6)))
            return f"<{t}{_attr(rng, 'footer', 'bottom', 'copyright') or (' id=footer' if t == 'div' else '')}>{body}</{t}>"
        case "aside":
            t = rng.choice(("aside", "aside", "div", "section"))
            body = rng.choice((f"<h3>{w(1, 4)}</h3>{_links(rng, rng.randint(2, 8))}", f"<p>{w(5, 60)}</p>", f"<div>{w(4, 30)}</div>", "".join(f"<p>{w(5, 30)}</p>" for _ in range(3))))
            return f"<{t}{_attr(rng, 'sidebar', 'widget', 'related', 'rail', 'popular') or (' class=sidebar' if t != 'aside' else '')}>{body}</{t}>"
        case "ad":
            t = rng.choice(("div", "div", "p", "section", "aside"))
            return f'<{t} class="{rng.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-banner", "advertisement", "promotion box"))}">{rng.choice((w(3, 50), f"<a href=x>{w(2, 9)}</a>", f"<b>{w(2, 8)}</b> {w(3, 20)}"))}</{t}>'
        case "notice":
            t = rng.choice(("div", "div", "section", "p", "dialog"))
            return f'<{t} {rng.choice(("class", "id"))}="{rng.choice(("cookie", "cookie-notice", "consent", "notice", "gdpr-banner", "alert", "popup", "newsletter", "subscribe-box"))}">{rng.choice((w(4, 40), f"<p>{w(4, 40)}</p>"))}{rng.choice(("", "<button>OK</button>"))}</{t}>'
        case "form":
            return f"<form{_attr(rng, 'search', 'login', 'newsletter', 'form')}><label>{w(1, 6)}</label><input name=q><button>{w(1, 2)}</button>{f'<p>{w(3, 20)}</p>' if rng.random() < 0.5 else ''}</form>"
        case "share":
            return f'<{(t := rng.choice(("div", "ul", "p")))} class="{rng.choice(("share", "social", "share-buttons", "tags", "meta", "breadcrumb", "pagination"))}">{_links(rng, rng.randint(2, 5))}</{t}>'
        case _:  # comments
            t = rng.choice(("section", "div", "div", "ol", "aside"))
            one = lambda: rng.choice((f'<div class="comment"><b>{w(1, 2)}</b><p>{w(3, 60)}</p></div>', f"<p>{w(3, 60)}</p>", f'<li class="comment">{w(3, 50)}</li>', f"<article class=comment><p>{w(4, 60)}</p></article>"))
            return f'<{t} {rng.choice(("class", "id"))}="{rng.choice(("comments", "comment-list", "responses", "discussion", "reader-comments", "disqus", "replies"))}"><h3>{w(1, 3)}</h3>{"".join(one() for _ in range(rng.randint(1, 5)))}</{t}>'


_KINDS = ("menu", "header", "footer", "aside", "ad", "notice", "form", "share", "comments")
_MARK = ""  # stands in every piece of article text of a training page


def training_page(rng: random.Random) -> str:
    """A random page; article text carries ``_MARK``."""
    w = lambda a, b: _MARK + _words(rng, rng.randint(a, b))
    def part() -> str:
        x = rng.random()
        if x < 0.7:
            mid = rng.choice(("", "", "", f"<a href=y>{w(1, 4)}</a> {w(1, 9)}", f"<b>{w(1, 4)}</b>", f'<span class="{rng.choice(("hl", "name", "text", "note"))}">{w(1, 5)}</span>', f"<br>{w(1, 20)}"))
            return f"<p{_attr(rng, 'text', 'lead', 'paragraph') if rng.random() < 0.2 else ''}>{w(1, rng.choice((3, 20, 120)))} {mid}{rng.choice(('</p>', '</p>', ''))}"
        if x < 0.78:
            return f"<h2>{w(1, 8)}</h2>"
        if x < 0.86:
            return f"<{(t := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{w(1, 25)}</li>" for _ in range(rng.randint(1, 6))) + f"</{t}>"
        if x < 0.9:
            return f"<blockquote>{rng.choice((w(4, 40), f'<p>{w(4, 40)}</p>'))}</blockquote>"
        if x < 0.93:
            return "<table>" + "".join(f"<tr><td>{w(1, 3)}<td>{w(1, 3)}</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if x < 0.96:
            return f"<figure><img src=a.png><figcaption>{w(2, 14)}</figcaption></figure>"
        return f"<div>{w(2, 60)}</div>"
    body = [f"<h1>{w(1, 14)}</h1>"] if rng.random() < 0.8 else []
    body += [part() for _ in range(rng.choice((1, 2, 3, 5, 8, 15)))]
    for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
        body.insert(rng.randint(min(1, len(body)), len(body)), _boilerplate(rng, rng.choice(("ad", "ad", "share", "notice", "aside", "form", "comments"))))
    tag = rng.choice(("article", "article", "main", "div", "div", "section"))
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div{_attr(rng, 'content', 'entry', 'post', 'body', 'story', 'row')}>{inner}</div>"
    if rng.random() < 0.15:
        inner = f"<header><h1>{w(1, 9)}</h1></header>" + inner
    inner = f"<{tag}{_attr(rng, 'article', 'content', 'main', 'post', 'entry', 'story') if tag == 'div' or rng.random() < 0.3 else ''}>{inner}</{tag}>"
    around = [_boilerplate(rng, k) for k in _KINDS for _ in range(1 + (rng.random() < 0.1)) if rng.random() < 0.45]
    rng.shuffle(around)
    k = rng.randint(0, len(around))
    if rng.random() < 0.5:
        k = min(k, 2)
    page = "".join(around[:k]) + inner + "".join(around[k:])
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = f"<div{_attr(rng, 'wrap', 'container', 'page', 'layout', 'root')}>{page}</div>"
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}" + rng.choice(("</body></html>", ""))
    return page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.08 else page


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 20) -> Extractor:
    """The extractor, trained on ``pages`` composed pages."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(training_page(rng))
        page.loose()
        n = len(page.tag)
        own = [0] * n
        for _, node, text, _ in page.segments:
            own[node] |= _MARK in text
        for v in range(n - 1, 0, -1):
            own[page.parent[v]] |= own[v]
        page.segments = [(b, v, t.replace(_MARK, ""), a) for b, v, t, a in page.segments]
        xs.append(features(page)[1:])
        ys.append(1.0 - np.array(own[1:], float))
    return Extractor(gbdt.fit(np.concatenate(xs), np.concatenate(ys)))


def extract(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """Per page: page_id, url, text."""
    arrow_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(extractor or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2).to_pylist()
            texts = [t for k in range(0, len(sources), 100) for t in shared.value.texts(sources[k : k + 100])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: DuckDB SQL for ``digest`` over the table pages, whose layout is known: the article stands in an element of that name, as headings and paragraphs.
ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS parts FROM a
), c AS (
  SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS parts FROM b
), d AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c
)
SELECT page_id, url, text, cast(length(text) AS bigint) AS n_chars FROM d
"""
