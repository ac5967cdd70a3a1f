"""A small tolerant HTML reader: block elements as a tree, and the text of each block in page order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-label|hidden|aria-hidden)\b(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
#: Their content is no text, or no markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
#: Whatever stands in them is never main text.
_SKIPPED = {"head", "template", "noscript", "svg", "math", "select", "button", "object", "audio", "video", "canvas", "datalist", "map", "dialog"} | _RAW
#: What may stand in an open head; anything else closes it.
_HEAD = {"head", "base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "noframes", "template", "html"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "html body article aside section nav header footer main form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address details summary center menu hgroup search legend".split()
)
#: An opening tag of the key closes open elements of the first set, up to one of the second.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_P_ENDERS = _BLOCKS - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend", "summary", "figcaption"} | {"hr"}
_SCOPE = {"table", "td", "th", "caption", "html", "body", "button", "object"}
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
_PARAGRAPH, _CELLS, _TABLE_PARTS, _NONE = {"p"}, {"table", "td", "th"}, {"table", "tr", "tbody", "thead", "tfoot"}, set()


@dataclass
class Page:
    """Block elements by number; a parent comes before its children, the root (0) has the parent -1."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    named: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    label: list[int | None] = field(default_factory=lambda: [None])
    #: (block element, text, characters of it in links), in page order.
    texts: list[tuple[int, str, int]] = field(default_factory=list)


def _attributes(raw: str) -> tuple[str, str | None]:
    names, label = [], None
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-label":
            label = value
        elif m[1].lower() in ("hidden", "aria-hidden"):
            names += ["hidden"] * (value.lower() != "false")
        else:
            names.append(value)
    return " ".join(names), label


#: Elements nested deeper than this become children of the last one that is not, as in browsers.
MAX_DEPTH = 512


class _Open:
    """The open elements. The last open one of any name is known without a search, so a page takes time in proportion to its length."""

    def __init__(self, ended):
        self._ended = ended
        self.names, self.blocks = ["html"], [0]  # an inline element that was closed within others leaves an empty name
        self._places: dict[str, list[int]] = {"html": [0]}
        self._block_places = [0]
        self.skipping = self.links = 0

    @property
    def top(self) -> str:
        return self.names[-1]

    @property
    def block(self) -> int:
        return self.blocks[-1]

    def push(self, name: str, block: int) -> None:
        self._places.setdefault(name, []).append(len(self.names))
        if name in _BLOCKS:
            self._block_places.append(len(self.names))
        self.names.append(name)
        self.blocks.append(block)
        self.skipping += name in _SKIPPED
        self.links += name == "a"

    def _forget(self, name: str) -> None:
        self._places[name].pop()
        self.skipping -= name in _SKIPPED
        self.links -= name == "a"

    def pop(self) -> None:
        """End the innermost element."""
        name = self.names[-1]
        if name in _BLOCKS:
            self._ended()
            self._block_places.pop()
        self._forget(name)
        self._cut()
        while not self.names[-1]:
            self._cut()

    def _cut(self) -> None:
        self.names.pop()
        self.blocks.pop()

    def last(self, names) -> int:
        """The place of the innermost open element of one of ``names`` (never that of the root); -1 if there is none."""
        return max((k[-1] for n in names if (k := self._places.get(n)) and k[-1]), default=-1)

    def pop_to(self, place: int) -> None:
        while len(self.names) > max(place, 1):
            self.pop()

    def close(self, names, scope) -> None:
        """End the innermost element of one of ``names`` and all in it, unless one of ``scope`` stands between."""
        place = self.last(names)
        if place > 0 and place > self.last(scope - names if names & scope else scope):
            self.pop_to(place)

    def close_inline(self, name: str) -> None:
        """End an inline element within its block; those in it stay open."""
        place = self.last((name,))
        if place <= self._block_places[-1]:
            return
        if place == len(self.names) - 1:
            self.pop()
        else:
            self._forget(name)
            self.names[place] = ""


def read(html: str, labels: bool = False) -> Page:
    """The blocks and texts of a page. With ``labels``, ``data-label`` attributes of 0 and 1 are read; otherwise they are like any other."""
    page = Page()
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                page.texts.append((open_.block, text, sum(len(p.strip()) for p, link in parts if link)))
            parts.clear()

    open_ = _Open(flush)
    level = [0]
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else size]
        if open_.top == "head" and text.strip(" \t\n\f\r"):
            open_.pop()
        if text and not open_.skipping:
            parts.append((unescape(text) if "&" in text else text, open_.links > 0))
        if not m:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in ("html", "body"):
                flush()
            elif name in _BLOCKS or name in _SKIPPED:
                open_.close({name}, _CELLS - {name} if name not in _TABLE_PARTS else _NONE)
            else:
                open_.close_inline(name)
            continue
        name = m[2] or m[4]
        if not name:
            continue
        name, raw = name.lower(), (m[3] if m[2] else m[5]) or ""
        if open_.top == "head" and name not in _HEAD:
            open_.pop()
        if name in _VOID:
            if not open_.skipping:
                if name == "br":
                    parts.append((" ", False))
                elif name == "hr":
                    open_.close(_PARAGRAPH, _SCOPE)
                    flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name == "html":
            continue
        if name == "body":
            place = open_.last(("body",))
            open_.pop_to(place + 1 if place > 0 else 1)
        elif name in _P_ENDERS and not open_.skipping:
            if name in _HEADINGS:
                open_.close(_HEADINGS, _SCOPE | _BLOCKS)
            open_.close(_PARAGRAPH, _SCOPE)
        if name in _IMPLIED:
            open_.close(*_IMPLIED[name])
        if name in _BLOCKS and not open_.skipping:
            flush()
            named, label = _attributes(raw) if raw else ("", None)
            parent = open_.block
            if level[parent] >= MAX_DEPTH:
                parent = page.parent[parent]
            level.append(level[parent] + 1)
            page.tag.append(name)
            page.named.append(named)
            page.parent.append(parent)
            page.label.append(int(label) if labels and label in ("0", "1") else None)
            open_.push(name, len(page.tag) - 1)
        elif not raw.endswith("/"):
            open_.push(name, open_.block)
    open_.pop_to(1)
    flush()
    return page
