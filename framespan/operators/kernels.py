"""Actions on lines of pixels and blocks of samples, as functions of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framespan.functions.columns import note_hertz


def _byte(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")


def invert(px: Column) -> Column:
    return F.transform(px, lambda p: 255 - p)


def hflip(px: Column) -> Column:
    return F.reverse(px)


def brightness(px: Column, amount: float) -> Column:
    """Add a part of white (negative: of black)."""
    return F.transform(px, lambda p: _byte(F.round(p + 255 * amount)))


def contrast(px: Column, amount: float) -> Column:
    """Scale around the middle."""
    return F.transform(px, lambda p: _byte(F.round((p - 128) * amount + 128)))


def opacity(px: Column, amount: float, background: int = 0) -> Column:
    return F.transform(px, lambda p: _byte(F.round(p * amount + background * (1 - amount))))


def erosion(px: Column) -> Column:
    """The least of each pixel and its neighbours."""
    return F.transform(F.array(px), lambda a: F.transform(a, lambda p, i: F.least(p, F.coalesce(F.get(a, i - 1), p), F.coalesce(F.get(a, i + 1), p))))[0]


def pixelate(px: Column, width: int) -> Column:
    """Each pixel is the rounded mean of its block."""

    def block(a, i):
        own = F.slice(a, i - i % width + 1, width)
        return _byte(F.round(F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)))

    return F.transform(F.array(px), lambda a: F.transform(a, lambda p, i: block(a, i)))[0]


def aberration(px: Column, shift: int, wrap: bool = False) -> Column:
    """Pixels moved by ``shift``; the edge is smeared, or wraps around."""

    def at(a, i):
        n = F.size(a)
        return F.get(a, F.pmod(i - shift, n) if wrap else F.least(F.greatest(i - shift, F.lit(0)), n - 1))

    return F.transform(F.array(px), lambda a: F.transform(a, lambda p, i: at(a, i)))[0]


def key_out(px: Column, colour: int, similar: float, background: int = 0) -> Column:
    """Pixels close to a grey value give way to the background."""
    return F.transform(px, lambda p: F.when(F.abs(p - colour) <= similar * 255, background).otherwise(p))


def choke(alpha: Column, times: int) -> Column:
    """Erode an alpha line several times."""
    for _ in range(times):
        alpha = erosion(alpha)
    return alpha


def volume(samples: Column, gain: float) -> Column:
    """16-bit samples with a gain, rounded half away from zero and clamped."""
    return F.transform(samples, lambda s: F.least(F.greatest(F.round(s * gain), F.lit(-32768)), F.lit(32767)).cast("int"))


def tone(note: Column, n: Column, rate: int, peak: int = 8191) -> Column:
    """``n`` samples of a sine at a MIDI note, 12 dB below full scale."""
    step = note_hertz(note) * 2 * F.pi() / rate
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(F.sin(k * step) * peak).cast("int"))).otherwise(F.array().cast("array<int>"))


def loop_index(frame: Column, length: Column) -> Column:
    """The source frame of a looped clip."""
    return F.pmod(frame, length)


def matte(width: int, height: int, x: int, y: int, w: int, h: int, radius: int = 0, feather: int = 0, inverted: bool = False) -> Column:
    """A mask as rows of 0 to 255: a rectangle, with rounded corners, or an ellipse (radius -1), softened over ``feather`` pixels."""

    def cover(px: Column, py: Column) -> Column:
        dx, dy = F.abs(px + 0.5 - (x + w / 2)), F.abs(py + 0.5 - (y + h / 2))
        if radius < 0:
            nx, ny = dx / (w / 2), dy / (h / 2)
            distance = (F.sqrt(nx * nx + ny * ny) - 1) * (min(w, h) / 2)
        else:
            r = min(radius, w / 2, h / 2)
            qx, qy = F.greatest(dx - (w / 2 - r), F.lit(0.0)), F.greatest(dy - (h / 2 - r), F.lit(0.0))
            inner = F.least(F.greatest(dx - (w / 2 - r), dy - (h / 2 - r)), F.lit(0.0))
            distance = F.sqrt(qx * qx + qy * qy) + inner - r
        share = F.when(distance <= 0, 1.0).otherwise(0.0) if feather == 0 else F.least(F.greatest(0.5 - distance / feather, F.lit(0.0)), F.lit(1.0))
        return F.round((1 - share if inverted else share) * 255).cast("int")

    rows = F.sequence(F.lit(0), F.lit(height - 1))
    return F.transform(rows, lambda py: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda px: cover(px, py)))


def overlay(base: Column, top: Column, alpha: Column, offset: int) -> Column:
    """A line of pixels with another over it, from ``offset`` on, by its alpha."""

    def at(b, i, t, a):
        k = i - offset
        share = F.when((k >= 0) & (k < F.size(t)), F.get(a, k) / 255).otherwise(0.0)
        return F.round(b * (1 - share) + F.coalesce(F.get(t, k), F.lit(0)) * share).cast("int")

    return F.transform(F.array(F.struct(base.alias("b"), top.alias("t"), alpha.alias("a"))), lambda s: F.transform(s["b"], lambda b, i: at(b, i, s["t"], s["a"])))[0]
