"""The edit expression language: text to syntax tree, binding of arguments, and compilation to a mask.

Two forms mix freely: ``(or audio:3% (not motion))`` and ``name:arg,key=value``; several
expressions at the top are one call. ``;`` begins a comment; the three kinds of brackets are alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespan.functions.values import suggestion, threshold
from framespan.operators import masks

_TOKEN = re.compile(r"\s+|;[^\n]*|(?P<open>[(\[{])|(?P<close>[)\]}])|\"(?P<string>(?:[^\"\\]|\\.)*)\"|(?P<colon>:)|(?P<comma>,)|(?P<equals>=)|(?P<atom>[^\s()\[\]{};\",:=]+)")
_PAIR = {"(": ")", "[": "]", "{": "}"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class EditError(ValueError):
    """An edit expression that can't be understood."""


@dataclass
class Node:
    """A call (``name`` with positional and keyword arguments) or an atom (``value``)."""

    name: str | None = None
    args: list[Node] = field(default_factory=list)
    named: dict[str, Node] = field(default_factory=dict)
    value: str | None = None
    quoted: bool = False

    @property
    def text(self) -> str:
        if self.value is None:
            raise EditError(f"{self.name} is a call, not a value")
        return self.value


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EditError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            value = m[m.lastgroup]
            if m.lastgroup == "string":
                value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value)
            out.append((m.lastgroup, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str] | tuple[None, None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self) -> tuple[str, str]:
        kind, value = self.peek()
        if kind is None:
            raise EditError("the expression ends too early")
        self.at += 1
        return kind, value

    def expression(self) -> Node:
        kind, value = self.take()
        if kind == "open":
            return self.call(_PAIR[value])
        if kind == "string":
            return Node(value=value, quoted=True)
        if kind != "atom":
            raise EditError(f"unexpected {value!r}")
        if self.peek()[0] != "colon":
            return Node(value=value)
        self.take()
        node = Node(name=value)
        while True:
            self.argument(node)
            if self.peek()[0] != "comma":
                return node
            self.take()

    def argument(self, node: Node) -> None:
        kind, value = self.peek()
        if kind == "atom" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "equals":
            self.at += 2
            if value in node.named:
                raise EditError(f"{value} is given twice")
            node.named[value] = self.value()
        elif node.named:
            raise EditError("a positional argument follows a named one")
        else:
            node.args.append(self.value())

    def value(self) -> Node:
        kind, value = self.take()
        if kind not in ("atom", "string"):
            raise EditError(f"unexpected {value!r}")
        return Node(value=value, quoted=kind == "string")

    def call(self, end: str) -> Node:
        items = []
        while self.peek()[0] != "close":
            items.append(self.expression())
        if self.take()[1] != end:
            raise EditError("brackets don't match")
        if not items:
            raise EditError("an empty call")
        head = items[0]
        if head.name is not None and not head.args and not head.named or head.value is None:
            raise EditError("a call must begin with a name")
        return Node(name=head.value, args=items[1:])


def parse(text: str) -> Node:
    """The syntax tree of an edit expression."""
    parser, found = _Parser(text), []
    while parser.peek()[0] is not None:
        found.append(parser.expression())
    if not found:
        raise EditError("an empty expression")
    if len(found) == 1:
        return found[0]
    head = found[0]
    if head.value is None or head.quoted:
        raise EditError("several expressions must begin with an operator")
    return Node(name=head.value, args=found[1:])


@dataclass(frozen=True)
class Method:
    """A method's arguments in order, each with its default (None: required), and the medium it reads."""

    arguments: tuple[tuple[str, str | None], ...]
    medium: str


METHODS = {
    "audio": Method((("threshold", "0.04"), ("stream", "all"), ("channel", "all")), "audio"),
    "motion": Method((("threshold", "0.02"), ("stream", "0"), ("width", "400"), ("blur", "9"), ("x", "0"), ("y", "0"), ("w", "1"), ("h", "1")), "video"),
    "blackdetect": Method((("threshold", "0.98"), ("stream", "0"), ("pixel-black", "0.10")), "video"),
    "subtitle": Method((("pattern", None), ("stream", "0"), ("ignore-case", "#f")), "subtitle"),
    "regex": Method((("pattern", None), ("stream", "0"), ("ignore-case", "#f")), "subtitle"),
    "word": Method((("value", None), ("stream", "0"), ("ignore-case", "#t")), "subtitle"),
}
OPERATORS = {"or": masks.any_of, "and": masks.all_of, "xor": masks.odd_of}
CONSTANTS = {"none": True, "1": True, "all": False, "0": False}


def bind(node: Node) -> dict[str, str]:
    """Arguments of a method call by name, defaults filled in."""
    name = node.name if node.name is not None else node.value
    if name not in METHODS:
        near = suggestion(name or "", [*METHODS, *OPERATORS, "not"])
        raise EditError(f"unknown method {name!r}" + (f", did you mean {near!r}?" if near else ""))
    known = METHODS[name].arguments
    if len(node.args) > len(known):
        raise EditError(f"{name} takes at most {len(known)} arguments")
    bound = {key: arg.text for (key, _), arg in zip(known, node.args)}
    for key, arg in node.named.items():
        if key not in dict(known):
            raise EditError(f"{name} has no argument {key!r}")
        if key in bound:
            raise EditError(f"{key} is given twice")
        bound[key] = arg.text
    for key, default in known:
        if key not in bound:
            if default is None:
                raise EditError(f"{name} needs {key}")
            bound[key] = default
    return bound


def boolean(text: str) -> bool:
    if text in ("#t", "true", "1"):
        return True
    if text in ("#f", "false", "0"):
        return False
    raise EditError(f"not a boolean: {text!r}")


def media_needed(node: Node) -> set[str]:
    """Which media an expression reads, so that only those are scanned."""
    name = node.name if node.name is not None else node.value
    own = {METHODS[name].medium} if name in METHODS else set()
    return own.union(*(media_needed(a) for a in node.args)) if name in OPERATORS or name == "not" else own


@dataclass
class Context:
    """What expressions read: level series by (method, bound arguments), cues, and source lengths (src, length)."""

    levels: Callable[[str, dict[str, str]], DataFrame]
    lengths: DataFrame
    cues: Callable[[int], DataFrame] | None = None


def compile_mask(node: Node, context: Context) -> DataFrame:
    """The plan of a mask (src, frame, on); nothing runs until rows are asked for."""
    name = node.name if node.name is not None else node.value
    if node.name is None and not node.quoted and name in CONSTANTS:
        return masks.everything(context.lengths) if CONSTANTS[name] else masks.nothing(context.lengths)
    if name in OPERATORS:
        if not node.args:
            raise EditError(f"{name} needs an operand")
        return OPERATORS[name]([compile_mask(a, context) for a in node.args])
    if name == "not":
        if len(node.args) != 1:
            raise EditError("not takes one operand")
        return masks.none_of(compile_mask(node.args[0], context))
    bound = bind(node)
    if METHODS[name].medium != "subtitle":
        return masks.above(context.levels(name, bound), threshold(bound["threshold"]))
    if context.cues is None:
        raise EditError(f"{name} needs subtitles")
    pattern = masks.word_pattern(bound["value"]) if name == "word" else bound["pattern"]
    return masks.cue_mask(context.cues(int(bound["stream"])), pattern, boolean(bound["ignore-case"]))


_COLUMN_OPERATORS = {"or": masks.col_or, "and": masks.col_and, "xor": masks.col_xor}


def compile_column(node: Node, level: Callable[[str, dict[str, str]], Column], length: Column, frame: Column) -> Column:
    """The nullable mask of an expression over a table of frames that already has all level series as columns.

    The whole expression is one projection. ``level`` gives the column of a method (null beyond
    its length), ``length`` the frames of the source.
    """
    name = node.name if node.name is not None else node.value
    if node.name is None and not node.quoted and name in CONSTANTS:
        return F.when(frame < length, F.lit(True)) if CONSTANTS[name] else F.lit(None).cast("boolean")
    if name in _COLUMN_OPERATORS:
        if not node.args:
            raise EditError(f"{name} needs an operand")
        return _COLUMN_OPERATORS[name](*(compile_column(a, level, length, frame) for a in node.args))
    if name == "not":
        if len(node.args) != 1:
            raise EditError("not takes one operand")
        return ~compile_column(node.args[0], level, length, frame)
    bound = bind(node)
    own = level(name, bound)
    return masks.col_above(own, threshold(bound["threshold"])) if METHODS[name].medium != "subtitle" else own


def compile_labels(edits: dict[int, str], context: Context) -> DataFrame:
    """Labels (src, frame, label) of several labelled expressions; the highest label wins."""
    for k in edits:
        if not 1 <= k <= 255:
            raise EditError("labels go from 1 to 255")
    return masks.merge_labels([(k, compile_mask(parse(text), context)) for k, text in edits.items()])


def parse_single_method(text: str) -> tuple[str, dict[str, str]]:
    """A method by itself, as level dumps take it: no operator, no threshold, and audio reads stream 0 unless told otherwise."""
    node = parse(text)
    name = node.name if node.name is not None else node.value
    if name in OPERATORS or name == "not" or node.name is None and name in CONSTANTS:
        raise EditError(f"{name} is not a method")
    if "threshold" in node.named or node.args and METHODS.get(name or "", Method((("", ""),), "")).arguments[0][0] == "threshold":
        raise EditError("a threshold means nothing here")
    bound = bind(node)
    bound.pop("threshold", None)
    if name == "audio" and "stream" not in node.named:
        bound["stream"] = "0"
    return name or "", bound
