"""Main text of web pages (operator 4): flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at block-level tags.  Each block is described by its words and link
density, those of its neighbours, and the kind of region it stands in; a small tree, grown here on a small
labelled table, says which blocks are the article.  The table comes from page layouts that ``labelled_table``
builds from parameters: with telling tags, with telling class names, and with neither, where only words and
densities tell menus and footers from the article.  No page of the corpus is used.

Pages are read in one pass, in time proportional to their length: where a tag, comment or silent element isn't
closed, that is noted once and not looked for again.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import arrow_rows

#: Elements whose content is no text of the page; block-level elements; elements that are kept
#: on the stack of open regions; boilerplate elements; words in class, id and role that tell a region's kind; words
#: beside those that tell nothing; first
#: and last parts of names that tell a state or a layout instead.
RAW = ("script", "style")
SILENT = (*RAW, "noscript", "template", "title", "textarea", "select", "button", "svg", "iframe", "object", "audio", "video", "canvas", "math")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
REGION = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table ul".split())
BOILER = frozenset("aside dialog fieldset footer form menu nav".split())
BAD = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies copyright disclaimer disqus feedback footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
NEUTRAL = frozenset(
    "a about all and area articles bar below block bottom box by center column container content desktop element footer from group header holder inner item items latest leave left links list main middle mobile more on our outer page pages panel post posts primary read reader readers right row section secondary site small stories story the this title to top us view wrap wrapper you your".split()
)
GOOD = frozenset("article articlebody body content entry main post story text".split())
STATE_FIRST = frozenset("has hide is js no not show u with without".split())
STATE_LAST = frozenset("closed disabled enabled off on open".split())

_SPECIAL = re.compile(r"<(?:!--|!\[CDATA\[|[!?/a-zA-Z])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>=]|=(?:\s*\"[^\"]*+\"|\s*'[^']*+')?+)*+>")
_PLAIN = re.compile(r"[^<>]*+>?")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in SILENT}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: int
    bad: int
    good: int
    heading: int
    item: int
    under: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in order: texts (name empty), start tags with their attributes, end tags; comments,
    declarations and silent elements are left out."""
    at, quotes, unclosed = 0, True, set()
    while m := _SPECIAL.search(page, at):
        i = m.start()
        if i > at:
            yield "text", "", page[at:i]
        if m[0] == "<!--":
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if m[0] == "<![CDATA[":
            at = m.end()
            continue
        name = _NAME.match(page, i + 1)
        if not name:
            end = page.find(">", i + 1)
            at = end + 1 if end >= 0 else len(page)
            continue
        ending, tag = page[i + 1] == "/", name[1].lower()
        rest = _QUOTED.match(page, name.end()) if quotes else None
        if rest is None:  # no end of a tag beyond this place outside quotes: they don't pair up, or the page is cut off
            quotes = False
            rest = _PLAIN.match(page, name.end())
        at = rest.end()
        if not ending and tag in _CLOSING and tag not in unclosed:
            close = _CLOSING[tag].search(page, at)
            if close:
                at = close.start()
                continue
            unclosed.add(tag)
            if tag in RAW and rest[0].endswith(">"):
                return
        if tag in _CLOSING:
            continue
        yield ("end" if ending else "start"), tag, "" if ending else rest[0]
    if at < len(page):
        yield "text", "", page[at:]


def _bad_names(names: str, most: int) -> int:
    """How far a class or id list tells boilerplate: 2 by a whole name, or one whose last part does or whose other
    parts say nothing; 1 by any part; 0 where a name has more parts than ``most`` or tells a state or layout."""
    told = 0
    for name in names.split():
        if name.lower() in BAD:
            return 2
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", name)]
        if len(parts) <= most and parts and parts[0] not in STATE_FIRST and parts[-1] not in STATE_LAST and not BAD.isdisjoint(parts):
            whole = parts[-1] in BAD or all(p in BAD or p in NEUTRAL or p.isdigit() for p in parts)
            told = max(told, 2 if whole else 1)
    return told


def _names_boilerplate(heading: str) -> bool:
    """Whether a heading says that comments, related pages or the like follow, and nothing else."""
    words = [w for w in re.findall(r"[a-z]+", heading.lower())]
    return 0 < len(words) <= 5 and not BAD.isdisjoint(words) and all(w in BAD or w in NEUTRAL for w in words)


def _marks(name: str, text: str) -> tuple[int, int, int, bool]:
    """(boilerplate element, bad hint, good hint, hidden) of a region's start tag."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}
    hidden = ("hidden" in found and found["hidden"].lower() != "until-found") or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(found.get("style", "")))
    classes, own, role = found.get("class", ""), found.get("id", ""), found.get("role", "")
    if name in ("article", "main"):  # a name that holds a word of the list by chance says little there
        bad = 2 * (not BAD.isdisjoint(f"{classes} {role}".lower().split()))
    else:
        bad = max(_bad_names(classes, 6), _bad_names(own, 2), _bad_names(role, 1))
    good = name in ("article", "main") or not GOOD.isdisjoint(re.split(r"[^a-z]+", f"{classes} {own} {role}".lower()))
    return int(name in BOILER), int(bad), int(good and not bad), hidden


def _around_main(found: list[tuple[str, str, str]], marks: dict[int, tuple[int, int, int, bool]]) -> set[int]:
    """Numbers of the regions that hold the main part: the article or main element with the first heading of
    the first level, or else the first main, such heading or article (one that doesn't stand among comments or the
    like).  Their names and forms condemn nothing."""
    # of each open region: name, number, place of the outermost article or main, whether boilerplate is open, and
    # whether a region whose name surely is boilerplate's
    stack: list[tuple[str, int, int, bool, bool]] = []
    first: dict[str, set[int]] = {}

    def note(key: str, depth: int) -> None:
        if key not in first:  # the set is as large as the nesting is deep, so it is made once a key
            first[key] = {entry[1] for entry in stack[:depth]}

    for i, (kind, name, _) in enumerate(found):
        if kind == "start":
            if name == "h1":
                main, boiler, _ = stack[-1][2:] if stack else (-1, False, False)
                if main >= 0:
                    note("with heading", main + 1)
                elif not boiler:
                    note("h1", len(stack))
            if name in REGION:
                main, boiler, sure = stack[-1][2:] if stack else (-1, False, False)
                is_main = name in ("article", "main")
                stack.append((name, i, len(stack) if main < 0 and is_main else main, boiler or name in BOILER or name == "header", sure or name != "body" and marks[i][1] > 1))
                if name == "main" or name == "article" and not sure:
                    note(name, len(stack))
        elif kind == "end" and name in REGION:
            for k in range(len(stack) - 1, max(-1, len(stack) - 64), -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
    for kind in ("with heading", "main", "h1", "article"):
        if kind in first:
            return first[kind]
    return set()


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order; blocks without text are none."""
    out: list[Block] = []
    # of each open region: name, boilerplate elements, bad and good hints from the outermost region to it
    stack: list[tuple[str, int, int, int]] = []
    pieces: list[tuple[str, bool]] = []
    link = heading = item = 0
    level = under = 0  # of the heading that is open, and of one that says what follows is no article

    def close() -> None:
        nonlocal under
        if not pieces:
            return
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            linked = sum(len(p.split()) for p, in_link in pieces if in_link)
            words = len(text.split())
            _, boiler, bad, good = stack[-1] if stack else ("", 0, 0, 0)
            if heading:
                names = level > 1 and len(text) < 80 and _names_boilerplate(text)
                under = level if names else 0 if level <= under else under
            out.append(Block(text, words, min(linked, words), boiler, bad, good, heading, item, int(under > 0)))
        pieces.clear()

    found = list(tokens(page))
    marks = {i: _marks(name, rest) for i, (kind, name, rest) in enumerate(found) if kind == "start" and name in REGION}
    spared = _around_main(found, marks)
    for i, (kind, name, rest) in enumerate(found):
        if kind == "text":
            pieces.append((html.unescape(rest), link > 0))
            continue
        ending = kind == "end"
        if name == "a":
            link = 0 if ending else 1
            continue
        if name == "br":
            pieces.append((" ", False))
            continue
        if name in BLOCK:
            close()
            if name[0] == "h" and name[1:].isdigit():
                heading, level = (0 if ending else 1), int(name[1:])
            elif name == "li":
                item = 0 if ending else 1
            elif name == "p":
                heading = 0
        if name not in REGION:
            continue
        if ending:
            # an end tag closes the nearest region of its name; deeper than 64 levels none is meant
            for k in range(len(stack) - 1, max(-1, len(stack) - 64), -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        _, boilers, bads, goods = stack[-1] if stack else ("", 0, 0, 0)
        boiler, bad, good, hidden = marks[i]
        if name == "header":  # of the site, not of the article
            boiler = int(not goods)
        if name == "body":
            bad = good = 0
        elif i in spared and (name not in BOILER or name in ("form", "fieldset")):
            bad, boiler = 0, boiler * (name == "header")
        stack.append((name, boilers + boiler, max(bads, 2 * hidden, bad), int(goods or good)))
    close()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "boilerplate", "bad name", "good name", "heading", "item", "under", "main part told")


def features(found: list[Block]) -> np.ndarray:
    """A row a block: words, link density, the same of the block before and after, region marks, whether a heading
    before it says that no article follows, and whether the page has a region that says it is the main part."""
    rows = []
    told = int(any(b.good and not b.bad and not b.boiler for b in found))
    for i, b in enumerate(found):
        before, after = (found[i - 1] if i else None), (found[i + 1] if i + 1 < len(found) else None)
        around = [v for n in (before, after) for v in ((n.words, n.density) if n else (0, 0.0))]
        rows.append([b.words, b.density, *around, min(b.boiler, 1), b.bad, b.good, b.heading, b.item, b.under, told])
    return np.array(rows, np.float64).reshape(len(found), len(FEATURES))


# ---- the tree ------------------------------------------------------------------------------------------


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> Node:
    """A binary tree by Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = (2 * node.share * (1 - node.share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.arange(1, len(y))
        p, q = t[:-1] / k, (t[-1] - t[:-1]) / (len(y) - k)
        impurity = 2 * p * (1 - p) * k + 2 * q * (1 - q) * (len(y) - k)
        impurity[(v[1:] == v[:-1]) | (k < least) | (len(y) - k < least)] = np.inf
        i = int(np.argmin(impurity)) if len(k) else 0
        if len(k) and impurity[i] < best[0]:
            best = (float(impurity[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.cut = best[1], best[2]
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def decide(node: Node, row: np.ndarray) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.share >= 0.5


def labelled_table(pages: int = 600, seed: int = 4) -> list[tuple[str, list[bool]]]:
    """Small pages and, block by block, whether each is article text.

    Layouts vary by parameters.  A third has semantic elements, a third plain divisions with class names, and a
    third neither: there runs of links are menus and lists of related pages, short lines between runs of links are
    footers, and the rest is article, short lines with links between its paragraphs included.  Pages have menus, a
    notice, an advert before or inside the article, lists, headings, links and short lines in it, a sidebar, a form,
    reader comments with a class or with nothing but a heading before them, and a footer, or lack them; some leave
    paragraphs open, in some of the first two kinds the article's own region says nothing, and names that hold a
    telling word by chance stand for articles as well as for boilerplate.
    """
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def link(low: int, high: int) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{words(low, high)}</a>'

    def listed(n: int) -> str:
        return "".join(f"<li>{link(1, 3)}</li>" for _ in range(n))

    def paragraph(low: int, high: int) -> str:
        inside = words(low, high)
        return f"{inside} {link(1, 4)} {words(1, 20)}" if rng.random() < 0.25 else inside

    def short() -> str:
        """A line of an article, a good part of it linked."""
        return f"{words(2, 8)} {link(1, 6)}{rng.choice(('', ' ' + words(1, 3)))}"

    def by_chance(kinds: tuple[str, ...] = ("search", "share", "social", "menu", "tags", "ad", "cookie")) -> str:
        return f"{rng.choice(kinds)}-{words(1, 1)}"

    def headed_comments() -> tuple[str, list[bool]]:
        n, level = rng.randint(1, 5), rng.choice("2345")
        name = rng.choice(("Comments", f"{rng.randint(2, 99)} Comments", "Leave a reply", "Reader comments", "Related", "Related stories", "Newsletter", "More recommended", "Share this"))
        return f"<h{level}>{name}</h{level}>" + "".join(f"<div><p>{words(1, 80)}</p></div>" for _ in range(n)), [False] * (n + 1)

    made = []
    for number in range(pages):
        style = ("semantic", "classes", "bare")[number % 3]
        parts: list[tuple[str, list[bool]]] = []

        def region(element: str, name: str, inside: str, n: int, style: str = style, parts: list = parts) -> None:
            if style == "semantic" and element != "div":
                mark = "" if rng.random() < 0.6 else f' class="{name}"'
                parts.append((f"<{element}{mark}>{inside}</{element}>", [False] * n))
            else:
                parts.append((f'<div class="{name}">{inside}</div>', [False] * n))

        def menu(parts: list = parts) -> None:
            n = rng.randint(3, 12) if rng.random() < 0.7 else rng.randint(20, 90)
            kind = rng.random()
            if kind < 0.4:
                parts.append((f"<ul>{listed(n)}</ul>", [False] * n))
            elif kind < 0.7:
                parts.append((f"<div>{' | '.join(link(1, 3) for _ in range(n))}</div>", [False]))
            else:
                parts.append(("<table><tr>" + "".join(f"<td>{link(1, 3)}</td>" for _ in range(n)) + "</tr></table>", [False] * n))

        bare = style == "bare"
        told = not bare and rng.random() < 0.75  # whether the article's own region says so
        if bare:
            for k in range(rng.randint(1, 3)):
                if k and rng.random() < 0.6:
                    parts.append((f"<div>{words(1, 8)}</div>", [False]))
                menu()
        else:
            if rng.random() < 0.5:
                region("header", "site-header", f"<h2>{words(1, 4)}</h2><p>{words(2, 12)}</p>", 2)
                if style == "classes":
                    parts[-1] = (parts[-1][0].replace("site-header", rng.choice(["masthead", "topbar"])), parts[-1][1])
            if rng.random() < 0.8:
                n = rng.randint(2, 9)
                region("nav", rng.choice(["menu", "navbar", "nav"]), f"<ul>{listed(n)}</ul>", n)
            if rng.random() < 0.5:
                region("div", rng.choice(["cookie-notice", "notice", "banner", "alert"]), f"<p>{words(5, 40)}</p>", 1)
            if rng.random() < 0.5:
                region("div", rng.choice(["ad", "ads", "sponsored", "promo"]), words(1, 40), 1)
            if rng.random() < 0.2:
                parts.append((f'<div class="{by_chance()}">{words(1, 8)} {link(1, 3)}</div>', [False]))
            if rng.random() < 0.3:
                menu()
            for _ in range(rng.randint(0, 2) if told else 0):
                parts.append((f"<div>{paragraph(1, 150)}</div>", [False]))
        top = "h1" if told or rng.random() < 0.6 else "h2"
        body: list[tuple[str, list[bool]]] = [(f"<{top}>{words(1, 12)}</{top}>", [True])]
        for _ in range(rng.randint(0, 9) if told else rng.randint(2, 9)):
            kind = rng.random()
            if kind < 0.6:
                low = 1 if told or rng.random() < 0.2 else 12
                body.append((f"<p>{paragraph(low, rng.choice((20, 90, 400)))}" + ("</p>" if rng.random() < 0.8 else ""), [True]))
            elif kind < 0.7:
                body.append((f"<h2>{words(1, 8)}</h2><p>{paragraph(12, 60)}</p>", [True, True]))
            elif kind < 0.78:
                body.append((f"<ul><li>{words(1, 20)}</li><li>{words(1, 20)}</li></ul>", [True, True]))
            elif kind < 0.82 and told:
                body.append((f"<p>{link(1, 6)}</p>", [True]))
            elif kind < 0.86:
                body.append((f"<p>{short()}</p>", [True]))
                if not told:
                    body.append((f"<p>{words(12, 60)}</p>", [True]))
            elif kind < 0.9:
                body.append((f"<blockquote><p>{words(3, 40)}</p></blockquote>", [True]))
            elif bare:
                continue
            elif kind < 0.95:
                body.append((f'<div class="{rng.choice(["ad", "promo", "newsletter", "related", "share"])}"><p>{words(2, 40)}</p></div>', [False]))
            else:
                n = rng.randint(1, 4)
                body.append((f"<aside>{''.join(f'<p>{words(1, 30)}</p>' for _ in range(n))}</aside>", [False] * n))
        if rng.random() < 0.3:
            body.append(headed_comments())
        tag = ("div" if rng.random() < 0.6 else f'div class="{by_chance()}"') if not told else "article" if style == "semantic" else f'div class="{rng.choice(["content", "post", "entry-content", "story"])}"'
        parts.append((f"<{tag}>" + "".join(p for p, _ in body) + f"</{tag.split()[0]}>", [k for _, ks in body for k in ks]))
        if rng.random() < 0.2:
            parts.append(headed_comments())
        if bare and rng.random() < 0.3:
            pass  # the article ends the page
        elif bare:
            if rng.random() < 0.6:
                n = rng.randint(3, 8)
                parts.append((f"<div><ul>{listed(n)}</ul></div>", [False] * n))
                if rng.random() < 0.5:
                    parts.append((f"<div>{words(1, 8)}</div>", [False]))
                    parts.append((f"<div>{' | '.join(link(1, 3) for _ in range(4))}</div>", [False]))
            if rng.random() < 0.8:
                parts.append((f"<div>{words(1, 5)} {link(1, 2)} | {link(1, 2)} | {link(1, 2)}</div>", [False]))
        else:
            for _ in range(rng.randint(0, 3) if told else 0):
                parts.append((f"<div>{paragraph(1, 150)}</div>", [False]))
            if rng.random() < 0.4:
                n = rng.randint(1, 5)
                region("aside", "sidebar", "".join(f"<p>{words(1, 40)}</p>" for _ in range(n)), n)
            if rng.random() < 0.4:
                n = rng.randint(1, 5)
                each = rng.choice(["p", "article", "div"])
                parts.append((f'<section class="comments">{"".join(f"<{each}>{words(1, 50)}</{each}>" for _ in range(n))}</section>', [False] * n))
            if rng.random() < 0.3:
                region("form", "subscribe", f"<label>{words(1, 5)}</label><p>{words(1, 20)}</p>", 2)
            if rng.random() < 0.8:
                region("footer", "footer", f"<p>&copy; {words(1, 30)}</p>", 1)
        page = "".join(p for p, _ in parts)
        made.append((page, [k for _, ks in parts for k in ks]))
    return made


@lru_cache(maxsize=1)
def tree() -> Node:
    xs, ys = [], []
    for page, keep in labelled_table():
        found = blocks(page)
        if len(found) != len(keep):
            raise ValueError("a labelled page has other blocks than labels")
        xs.append(features(found))
        ys.append(np.array(keep, np.float64))
    return grow(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, model: Node | None = None) -> str:
    if not page:
        return ""
    found = blocks(page)
    model = model or tree()
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(model, row))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, ``text`` (empty where nothing is kept), ``n_chars`` (code points).

    Null and empty pages give empty text; whole pages are read, whatever their length; repeated rows each
    give a row; null ids and urls stay null; an empty table gives none; other columns are ignored.
    """
    model = tree()

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, url, page in rows:
            text = main_text(page, model)
            yield key, url, text, len(text)

    kind = pages.schema[id_col].dataType.simpleString()
    return arrow_rows(pages.select(id_col, url_col, html_col), each, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long", chunk=512)
