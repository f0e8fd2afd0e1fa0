"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks, each with its ancestors' tags, class words and roles
and with features of its own text. A linear chain with two states (text, boilerplate)
is trained on labelled pages (``training_pages``) by gradient ascent on the conditional
likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import map_rows

TRAINING_PAGES = 400
SEED = 3

# Elements that stay inside a block, elements without an end tag,
# elements whose content is no markup, and ends that HTML lets authors leave out.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noframes", "iframe", "xmp")}
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_PARAGRAPH = INLINE | {"button", "input", "label", "select", "option", "svg", "object", "video", "audio", "canvas", "script", "style", "textarea", "noscript", "template", "iframe"}

# Elements that mark the blocks below them; the model knows no others.
MARKS_BLOCKS = frozenset(
    "article aside blockquote body button dialog div figcaption figure footer form h1 h2 h3 h4 head header html label li main nav ol option p pre section select style table td textarea title tr ul".split()
)

# Parts of class, id and role words, by the kind of place they name.
PLACES = {
    "menu": ("nav", "menu", "breadcrumb", "crumb", "pagination", "pager", "tabs", "toolbar", "navigation"),
    "header": ("header", "masthead", "topbar", "banner", "logo"),
    "footer": ("footer", "foot", "copyright", "contentinfo", "colophon", "legal"),
    "side": ("sidebar", "aside", "side", "related", "recommend", "widget", "complementary", "rail", "trending", "popular", "more", "seealso"),
    "advert": ("ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted", "commercial", "outbrain", "taboola"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "disclaimer", "dialog", "toast"),
    "comments": ("comment", "comments", "disqus", "respond", "response", "responses", "reply", "replies", "discussion", "reader", "readers"),
    "share": ("share", "sharing", "social", "follow", "tags", "byline", "meta"),
    "main": ("article", "main", "content", "post", "entry", "story", "body", "text", "prose"),
    "hidden": ("hidden", "sr", "visuallyhidden", "offscreen"),
}
_PLACE_OF = {word: place for place, words in PLACES.items() for word in words}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
# A tag's beginning only, a comment, or another declaration.
_HEAD = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>", re.DOTALL)
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def place_marks(attributes: str) -> frozenset[str]:
    """Marks of an element's class, id, role, style and hidden attributes."""
    marks = set()
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            marks.add("place:hidden")
        elif name in ("class", "id", "role", "aria-label"):
            for word in _CAMEL.findall(value):
                if place := _PLACE_OF.get(word.lower()):
                    marks.add("place:" + place)
    return frozenset(marks)


@dataclass
class Block:
    text: str
    marks: frozenset[str]  # of all ancestors
    tag: str  # the nearest block element
    link_chars: int


class _Tags:
    """The tags of a page, one after the other from the place ``at``, which may be moved on.

    The time grows with the page only: behind the last ``>`` nothing is searched, and after a tag with
    quotes that do not close, the ends of all tags are looked up in a table made once.
    """

    def __init__(self, page: str):
        self.page, self.at, self.last = page, 0, page.rfind(">")
        self.ends: Callable[[int], int] | None = None

    def next(self) -> tuple[int, str, str, str] | None:
        """(start, slash, name, attributes), None at the end; comments and declarations have no name."""
        page = self.page
        while self.at <= self.last:
            m = (_TAG if self.ends is None else _HEAD).search(page, self.at)
            if m is None:
                return None
            self.at = m.end()
            if self.ends is None:
                if m[5]:
                    self.ends = _tag_ends(page, m.end(5))
                    return m.start(), m[4], m[5].lower(), m[6]
                return m.start(), m[1] or "", (m[2] or "").lower(), m[3] or ""
            if not m[2]:
                return m.start(), "", "", ""
            end = self.ends(m.end())
            end = page.find(">", m.end()) if end < 0 else end
            if end >= 0:
                self.at = end + 1
                return m.start(), m[1], m[2].lower(), page[m.end() : end]
        # Only an open comment can follow; it takes the rest.
        start = page.find("<!--", self.at)
        self.at = len(page)
        return (start, "", "", "") if start >= 0 else None


def _tag_ends(page: str, start: int) -> Callable[[int], int]:
    """The place of the first ``>`` outside quotes from a place on, or -1; for places from ``start`` on."""
    places = [m.start() for m in _STOP.finditer(page, start)]
    found = [-1] * (len(places) + 1)
    ahead: dict[str, int] = {}  # the next mark of each kind
    for i in range(len(places) - 1, -1, -1):
        sign = page[places[i]]
        if sign == ">":
            found[i] = places[i]
        else:
            close = ahead.get(sign)
            found[i] = -1 if close is None else found[close + 1]
            ahead[sign] = i
    return lambda at: found[bisect_left(places, at)]


class _Open:
    """The open elements, with the places of each tag and of the block elements, so no step walks the stack."""

    def __init__(self):
        self.rows: list[tuple[str, frozenset[str]]] = []  # (tag, marks with the ancestors')
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, marks: frozenset[str]) -> None:
        self.places[tag].append(len(self.rows))
        if tag not in INLINE:
            self.blocks.append(len(self.rows))
        self.rows.append((tag, marks))

    def close(self, at: int) -> None:
        while len(self.rows) > at:
            tag, _ = self.rows.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def top(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    @property
    def block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    @property
    def marks(self) -> frozenset[str]:
        return self.rows[-1][1] if self.rows else frozenset()


_LISTS = frozenset(["ul", "ol", "dl", "table", "select"])


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; white space is one space, blank blocks are left out.

    The time grows with the length of the page, whatever its markup: tags that never end, deep nesting and
    unclosed quotes included.
    """
    stack = _Open()
    blocks: list[Block] = []
    parts: list[str] = []
    links = 0
    known: dict[tuple[str, str], frozenset[str]] = {}

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            tag = stack.rows[stack.block][0] if stack.block >= 0 else ""
            blocks.append(Block(text, stack.marks, tag, min(links, len(text))))
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if stack.places.get("a"):
                links += len(piece)

    def open_marks(tag: str, attributes: str) -> frozenset[str]:
        own = known.get((tag, attributes))
        if own is None:
            own = known[tag, attributes] = place_marks(attributes) | ({"tag:" + tag} if tag in MARKS_BLOCKS else set())
        outer = stack.marks
        return outer if own <= outer else outer | own

    tags, at = _Tags(page), 0  # text from ``at`` on is not added yet
    while (found := tags.next()) is not None:
        start, slash, tag, attributes = found
        add(page[at:start])
        at = tags.at
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if slash:
            place = stack.top([tag])
            # An inline end tag does not reach over the block it stands in.
            if place >= 0 and (tag not in INLINE or place > stack.block):
                stack.close(place)
            continue
        if tag not in KEEPS_PARAGRAPH:
            place = stack.top(["p"])
            if place >= 0:
                stack.close(place)
        if tag in CLOSES_ITSELF:
            place = stack.top(CLOSES_ITSELF[tag])
            if place >= 0 and place >= stack.top(_LISTS):
                stack.close(place)
        if tag in RAW:
            close = RAW[tag].search(page, at)
            tags.at = close.start() if close else len(page)
            if tag in ("title", "textarea"):
                stack.push(tag, open_marks(tag, attributes))
                add(page[at : tags.at])
                flush()
                stack.close(len(stack.rows) - 1)
            at = tags.at
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "li"):
            continue
        stack.push(tag, open_marks(tag, attributes))
    add(page[at:])
    flush()
    return blocks


_BOILERPLATE = frozenset(["tag:nav", "tag:footer", "tag:aside", "tag:form", "tag:header", *(f"place:{p}" for p in PLACES if p != "main")])
_END = (".", "!", "?", ":", "…", '"', "”", "»")


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    whole = any("tag:article" in b.marks or "tag:main" in b.marks for b in blocks)
    out = []
    for b in blocks:
        n = b.text.count(" ") + 1
        share = b.link_chars / len(b.text)
        names = ["bias", "at:" + b.tag, *b.marks]
        # Places that name boilerplate count once more together, inside or outside the text.
        if not _BOILERPLATE.isdisjoint(b.marks):
            names.append("boilerplate")
        names.append("words:" + ("1-2" if n < 3 else "3-5" if n < 6 else "6-12" if n < 13 else "13-30" if n < 31 else "more"))
        names.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
        names.append("ends" if b.text.endswith(_END) else "open")
        if "©" in b.text or "(c)" in b.text.lower():
            names.append("copyright")
        if whole:
            names.append("in" if "tag:article" in b.marks or "tag:main" in b.marks else "out")
        elif "place:main" in b.marks:
            names.append("in-place")
        out.append(names)
    return out


class Chain:
    """Weights of a linear chain with the states 0 (boilerplate) and 1 (text)."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weight = np.zeros((len(names), 2))
        self.step = np.zeros((2, 2))
        self.first = np.zeros(2)

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest states of one page, by Viterbi."""
        if not features:
            return []
        names, weight = self.names, self.weight
        scores = [weight[[names[f] for f in row if f in names]].sum(axis=0).tolist() for row in features]
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.first[0] + scores[0][0], self.first[1] + scores[0][1]
        back = []
        for e0, e1 in scores[1:]:
            to0, to1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
            back.append((to0, to1))
        state = 0 if a >= b else 1
        states = [state]
        for steps in reversed(back):
            state = steps[state]
            states.append(state)
        return states[::-1]


def fit_chain(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 100, rate: float = 0.5, ridge: float = 0.002) -> Chain:
    """Train on (features, states) of labelled pages: gradient ascent, all pages at once."""
    pages = [p for p in pages if p[0]]
    chain = Chain({f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))})
    length = max(len(rows) for rows, _ in pages)
    at_page, at_block, at_name = [], [], []
    truth = np.zeros((len(pages), length), int)
    there = np.zeros((len(pages), length), bool)
    for p, (rows, states) in enumerate(pages):
        truth[p, : len(rows)], there[p, : len(rows)] = states, True
        for t, row in enumerate(rows):
            ids = [chain.names[f] for f in row]
            at_page += [p] * len(ids)
            at_block += [t] * len(ids)
            at_name += ids
    at_page, at_block, at_name = map(np.array, (at_page, at_block, at_name))
    flat = at_page * length + at_block
    gold = np.eye(2)[truth] * there[..., None]
    gold_step = np.einsum("pti,ptj->ij", gold[:, :-1], gold[:, 1:])
    squares = [np.full_like(x, 1e-8) for x in (chain.weight, chain.step, chain.first)]
    for _ in range(rounds):
        score = np.stack([np.bincount(flat, chain.weight[at_name, k], len(pages) * length).reshape(len(pages), length) for k in (0, 1)], axis=2)
        forward = np.zeros_like(score)
        forward[:, 0] = chain.first + score[:, 0]
        for t in range(1, length):
            forward[:, t] = score[:, t] + np.logaddexp(forward[:, t - 1, :1] + chain.step[0], forward[:, t - 1, 1:] + chain.step[1])
            forward[~there[:, t], t] = forward[~there[:, t], t - 1]  # the last block's values stay
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros_like(score)
        expected_step = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            on = there[:, t + 1]
            pair = np.exp(forward[:, t, :, None] + chain.step + ahead[:, None, :] - total[:, None, None])
            expected_step += pair[on].sum(axis=0)
            backward[on, t] = np.logaddexp(chain.step[:, 0] + ahead[on][:, :1], chain.step[:, 1] + ahead[on][:, 1:])
        state = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        difference = (gold - state).reshape(-1, 2)
        slope = np.stack([np.bincount(at_name, difference[flat, k], len(chain.names)) for k in (0, 1)], axis=1)
        slopes = (slope - ridge * chain.weight, gold_step - expected_step - ridge * chain.step, (gold[:, 0] - state[:, 0]).sum(axis=0) - ridge * chain.first)
        for value, gradient, square in zip((chain.weight, chain.step, chain.first), slopes, squares, strict=True):
            square += gradient**2
            value += rate * gradient / np.sqrt(square)
    return chain


MARK = "⁣"  # marks the blocks of a training page that belong to its text


def training_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Labelled pages in many layouts; blocks of the main text begin with MARK.

    Layouts with and without semantic elements, with class words of many kinds,
    unclosed elements, lists, tables, quotes and code in the text, and boilerplate
    before, after and inside it. The words are random, so only form is learned.
    """
    rng = random.Random(seed)

    def word() -> str:
        return "".join(rng.choice(("an", "be", "co", "del", "er", "fi", "go", "hu", "in", "ka", "lo", "mer", "no", "os", "pra", "qui", "ro", "su", "ta", "ven")) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(1, 14).capitalize() + rng.choice(("...", ".", ".", ".", ".", "?", "!"))

    def prose(most: int = 6) -> str:
        text = " ".join(sentence() for _ in range(rng.randint(1, most)))
        if rng.random() < 0.2:
            text = rng.choice(("<b>{}</b> ", '<a href="/x">{}</a> ', "<em>{}</em> ", "<code>{}</code> ", "<b>{}<br>")).format(words(1, 3)) + text
        return text if rng.random() < 0.9 else words(1, 8)

    def place(kind: str) -> str:
        """A class or id value that names a kind of place."""
        name = rng.choice(PLACES[kind])
        return rng.choice(("{}", "{}-box", "site-{}", "{}_area", "wrap {}", "x-{}-y")).format(name)

    def box(kind: str, inside: str, tag: str = "div") -> str:
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{place(kind)}">{inside}</{tag}>'

    def links(low: int, high: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(rng.randint(low, high)))
        return f"<ul>{items}</ul>"

    def some_text(inside_boilerplate: bool) -> str:
        m, parts = MARK, []
        if rng.random() < 0.85:
            parts.append(f"<h1>{m}{words(2, 9).capitalize()}</h1>")
        for _ in range(rng.randint(1, 8)):
            r = rng.random()
            if r < 0.62:
                parts.append(f"<p>{m}{prose()}" + rng.choice(("</p>", "</p>", "")))
            elif r < 0.72:
                level = rng.randint(2, 4)
                parts.append(f"<h{level}>{m}{words(1, 6)}</h{level}>")
            elif r < 0.80:
                parts.append("<ul>" + "".join(f"<li>{m}{prose(2)}" + rng.choice(("</li>", "")) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.85:
                parts.append(f"<blockquote>{m}{prose(2)}</blockquote>")
            elif r < 0.89:
                parts.append(f"<figure><img src=x><figcaption>{m}{prose(1)}</figcaption></figure>")
            elif r < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{m}{words(1, 3)}</td><td>{m}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
            elif r < 0.96:
                parts.append(f"<pre>{m}{words(2, 9)}</pre>")
            else:
                parts.append(f"<div>{m}{prose()}</div>")
            if inside_boilerplate and rng.random() < 0.12:
                parts.append(rng.choice((advert, related, signup, share))())
        return "".join(parts)

    def advert() -> str:
        return box("advert", rng.choice((prose(2), f"<p>{prose(2)}</p>", f'<a href="/buy">{words(2, 8)}</a>')), rng.choice(("div", "div", "section", "aside")))

    def related() -> str:
        body = f"<h3>{words(1, 3)}</h3>" + rng.choice((links(2, 5), f"<p>{prose(3)}</p>"))
        return rng.choice((f"<aside>{body}</aside>", box("side", body), box("side", body, "aside")))

    def signup() -> str:
        form = f"<form><label>{words(1, 4)}</label><input name=q><textarea>{words(0, 3)}</textarea><select><option>{word()}<option>{word()}</select><button>{words(1, 2)}</button></form>"
        return rng.choice((form, form, box("notice", f"<p>{prose(2)}</p>" + form)))

    def share() -> str:
        return box("share", links(2, 4))

    def notice() -> str:
        return box("notice", rng.choice((prose(3), f"<p>{prose(3)}</p><button>{words(1, 2)}</button>")), rng.choice(("div", "div", "section", "dialog")))

    def menu() -> str:
        return rng.choice((f"<nav>{links(2, 8)}</nav>", f"<nav>{words(1, 6)}</nav>", box("menu", links(2, 8)), box("menu", " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(4)))))

    def head() -> str:
        body = rng.choice((f"<h1>{words(1, 4)}</h1>", f"<p>{prose(2)}</p>", words(1, 4), f"<h2>{words(1, 3)}</h2><p>{words(2, 8)}</p>")) + (menu() if rng.random() < 0.4 else "")
        return rng.choice((f"<header>{body}</header>", box("header", body)))

    def foot() -> str:
        body = rng.choice((f"&copy; {word()}.com &middot; {prose(2)}", f"<p>&copy; {rng.randint(1990, 2030)} {words(1, 5)}.</p>" + links(1, 4), f"<p>{prose(2)}</p>", links(2, 5)))
        return rng.choice((f"<footer>{body}</footer>", f"<footer>{body}</footer>", box("footer", body)))

    def comments() -> str:
        one = lambda: rng.choice((f"<p>{prose(4)}</p>", f"<div><b>{word()}</b><p>{prose(4)}</p></div>", f"<li>{prose(3)}</li>", f"<article><h4>{word()}</h4><p>{prose(4)}</p></article>"))
        return box("comments", f"<h3>{words(1, 3)}</h3>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 5))), rng.choice(("div", "section", "section", "ul", "ol")))

    pages = []
    for _ in range(count):
        before = "".join(f() for f in (head, menu, notice, advert, signup, related) if rng.random() < 0.45)
        after = "".join(f() for f in (comments, related, advert, share, signup, notice, foot) if rng.random() < 0.45)
        text = some_text(True)
        if rng.random() < 0.2:
            text = f"<header>{rng.choice((words(1, 4), f'<p>{prose(1)}</p>'))}</header>" + text
        if rng.random() < 0.2:
            text += rng.choice((f"<footer>{prose(2)}</footer>", comments(), share()))
        r = rng.random()
        if r < 0.55:
            text = f"<article>{text}</article>"
        elif r < 0.68:
            text = f"<main>{text}</main>"
        elif r < 0.78:
            text = f"<main>{box('main', text)}{related() if rng.random() < 0.5 else ''}</main>"
        elif r < 0.93:
            text = box("main", text)
        else:
            text = f"<div>{text}</div>"
        body = before + text + after
        if rng.random() < 0.2:
            body = f"<div class=page>{body}</div>"
        top = f"<title>{words(1, 9)}</title>" if rng.random() < 0.9 else ""
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8>{top}<style>p{{margin:0}}</style></head><body>{body}" + rng.choice(("</body></html>", "")))
    return pages


def train_extractor(count: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    """The chain fitted on the labelled pages."""
    labelled = []
    for page in training_pages(count, seed):
        blocks = leaf_blocks(page)
        states = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "") or "-"
        labelled.append((block_features(blocks), states))
    return fit_chain(labelled)


def main_text(page: str, chain: Chain) -> str:
    """Text blocks of a page in order, one per line."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, state in zip(blocks, chain.decode(block_features(blocks)), strict=True) if state)


def extract_text(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points of the text).

    The whole html is read; null and empty give an empty text, as do pages without a
    block. Character references are decoded, white space inside a block (line breaks
    included) becomes one space. Markup that never closes ends with the page. Repeated
    rows give equal results; other columns are not read.
    """
    held = pages.sparkSession.sparkContext.broadcast(chain or train_extractor())
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p, held.value) for p in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_rows(rows, work, f"page_id {kind}, url string, text string, n_chars bigint")
