"""Ranges, labels, transitions, normalizers and exports as users write them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from framespan.functions.values import Time, ValueError_, time
from framespan.plans import actions


@dataclass(frozen=True)
class Override:
    """An action over [start, stop); of several, the later one wins."""

    seq: int
    action: str
    start: Time
    stop: Time

    def row(self, timebase: Fraction, index: int) -> tuple[int, int, int, int]:
        return self.seq, index, self.start.frames(timebase), self.stop.frames(timebase)


def time_range(text: str) -> tuple[Time, Time]:
    """``START,STOP``; negative times count from the end."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError_(f"not a range: {text!r}")
    return time(parts[0].strip()), time(parts[1].strip())


def overrides(flags: list[tuple[str, str]]) -> list[Override]:
    """The ordered list of cut, keep, set-speed (SPEED,RANGE) and set-action (ACTION,RANGE) flags."""
    out = []
    for seq, (flag, value) in enumerate(flags):
        if flag in ("cut", "keep"):
            action, span = {"cut": "cut", "keep": "nil"}[flag], value
        elif flag in ("set-speed", "set-action"):
            *head, start, stop = value.split(",")
            if not head:
                raise ValueError_(f"{flag} needs an action and a range")
            action = ",".join(head)
            if flag == "set-speed":
                x = float(action)
                action = "cut" if x <= 0 or x >= 99999 else f"speed:{x:g}" if x != 1 else "nil"
            span = f"{start},{stop}"
        else:
            raise ValueError_(f"unknown flag {flag!r}")
        out.append(Override(seq, actions.canonical(actions.parse_list(action)), *time_range(span)))
    return out


def action_table(when: dict[int, str], ranges: list[Override]) -> tuple[list[tuple[int, str, float | None]], dict[int, int]]:
    """Rows (index, actions, speed) of all labels and, from the next index on, of each override; and the index of each override."""
    rows = []
    for label in range(max([1, *when]) + 1):
        parsed = actions.parse_list(when.get(label, "cut" if label == 0 else "nil"))
        rows.append((label, actions.canonical(parsed), actions.speed(parsed)))
    index = {}
    for r in ranges:
        same = {"cut": 0, "nil": 1}.get(r.action)
        if same is not None and rows[same][1] == r.action:
            index[r.seq] = same
            continue
        index[r.seq] = len(rows)
        rows.append((len(rows), r.action, actions.speed(actions.parse_list(r.action))))
    return rows, index


def labelled(text: str, low: int = 1) -> int:
    """The label of a flag such as ``--edit:3``."""
    if not re.fullmatch(r"\d+", text) or not low <= int(text) <= 255:
        raise ValueError_(f"labels go from {low} to 255, not {text!r}")
    return int(text)


def transition(text: str) -> tuple[str, Time, Time]:
    """``dissolve:DURATION[:MINIMUM_CUT]``."""
    kind, *rest = text.split(":")
    if kind != "dissolve" or not 1 <= len(rest) <= 2:
        raise ValueError_(f"not a transition: {text!r}")
    return kind, time(rest[0]), time(rest[1]) if len(rest) > 1 else Time(False, 0)


def normalizer(text: str) -> dict:
    """``peak:t`` or ``ebu:i,lra,tp,gain`` (by order or by name), with its ranges."""
    kind, _, rest = text.partition(":")
    known = {"peak": (("t", -8.0, -99.0, 0.0),), "ebu": (("i", -24.0, -70.0, 5.0), ("lra", 7.0, 1.0, 50.0), ("tp", -2.0, -9.0, 0.0), ("gain", 0.0, -99.0, 99.0))}
    if kind not in known:
        raise ValueError_(f"not a normalizer: {text!r}")
    out = {name: default for name, default, _, _ in known[kind]}
    for k, part in enumerate(p for p in rest.split(",") if p):
        name, eq, value = part.partition("=")
        if not eq:
            if k >= len(known[kind]):
                raise ValueError_(f"too many values in {text!r}")
            name, value = known[kind][k][0], part
        bounds = {n: (low, high) for n, _, low, high in known[kind]}.get(name)
        if bounds is None or not bounds[0] <= float(value) <= bounds[1]:
            raise ValueError_(f"bad value {part!r}")
        out[name] = float(value)
    return {"kind": kind} | out


_BY_EXTENSION = {"v1": "v1", "v2": "v2", "v3": "v3", "json": "v1", "xml": "premiere", "fcpxml": "final-cut-pro", "mlt": "shotcut", "kdenlive": "kdenlive", "otio": "otio"}
EXPORTS = ("default", "premiere", "resolve", "resolve-fcp7", "final-cut-pro", "shotcut", "kdenlive", "otio", "v1", "v2", "v3", "clip-sequence")


def export(text: str | None, output: str | None = None) -> tuple[str, dict[str, str]]:
    """``kind:name="x",version=10``, or what the output's extension stands for."""
    if text is None:
        return _BY_EXTENSION.get((output or "").rpartition(".")[2].lower(), "default"), {}
    kind, _, rest = text.partition(":")
    if kind not in EXPORTS:
        raise ValueError_(f"unknown export {kind!r}")
    pairs = re.findall(r'([\w-]+)=("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)', rest)
    if rest and ",".join(f"{k}={v}" for k, v in pairs) != rest:
        raise ValueError_(f"bad attributes in {text!r}")
    return kind, {k: re.sub(r"\\(.)", r"\1", v[1:-1]) if v.startswith('"') else v for k, v in pairs}
