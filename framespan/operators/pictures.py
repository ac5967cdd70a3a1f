"""Actions on whole pictures: columns with rows of pixels (array of arrays of 0 to 255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framespan.operators.kernels import _byte, aberration, pixelate


def picture(px: Column, width: int) -> Column:
    """A line of pixels as rows of ``width``."""
    rows = F.sequence(F.lit(0), (F.size(px) / width).cast("int") - 1)
    return F.transform(rows, lambda y: F.slice(px, y * width + 1, width))


def _each(img: Column, pixel) -> Column:
    """``pixel(img, p, y, x)`` for each pixel."""
    own = F.transform(F.array(img), lambda a: F.transform(a, lambda row, y: F.transform(row, lambda p, x: pixel(a, p, y, x))))
    return F.get(own, 0)


def vflip(img: Column) -> Column:
    return F.reverse(img)


def hflip(img: Column) -> Column:
    return F.transform(img, lambda row: F.reverse(row))


def erosion(img: Column) -> Column:
    """The least of each pixel and its eight neighbours, as far as they are in the picture."""

    def least(a, p, y, x):
        around = [F.get(F.get(a, y + dy), x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        return F.least(p, *around)  # nulls beyond the edges do not count

    return _each(img, least)


def choke(alpha: Column, times: int) -> Column:
    """A matte drawn in by a pixel, several times."""
    for _ in range(times):
        alpha = erosion(alpha)
    return alpha


def mosaic(img: Column, width: int, height: int) -> Column:
    """Each pixel is the rounded mean of its block; blocks at the right and the lower edge may be smaller."""

    def mean(a, p, y, x):
        rows = F.slice(a, y - y % height + 1, height)
        block = F.flatten(F.transform(rows, lambda r: F.slice(r, x - x % width + 1, width)))
        return _byte(F.round(F.aggregate(block, F.lit(0.0), lambda s, v: s + v) / F.size(block)))

    return _each(img, mean) if height > 1 else F.transform(img, lambda row: pixelate(row, width))


def shifted(img: Column, right: int, down: int, wrap: bool = False) -> Column:
    """A colour plane moved by whole pixels either way; its edge is smeared, or wraps around."""
    moved = F.transform(img, lambda row: aberration(row, right, wrap))
    n = F.size(moved)
    at = lambda y: F.pmod(y - down, n) if wrap else F.least(F.greatest(y - down, F.lit(0)), n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda y: F.get(moved, at(y).cast("int")))


def drawbox(img: Column, x: int, y: int, w: int, h: int, colour: int) -> Column:
    """A filled rectangle over the picture."""
    return _each(img, lambda a, p, py, px: F.when((px >= x) & (px < x + w) & (py >= y) & (py < y + h), F.lit(colour)).otherwise(p))


def opacity(img: Column, share: Column, background: int = 0) -> Column:
    """The picture over a background; ``share`` may be a value of a ramp at each frame."""
    own = F.transform(F.array(F.struct(img.alias("i"), share.cast("double").alias("s"))), lambda v: F.transform(v["i"], lambda row: F.transform(row, lambda p: _byte(F.round(p * v["s"] + background * (1 - v["s"]))))))
    return F.get(own, 0)


def faded_alpha(alpha: Column, share: Column) -> Column:
    """The matte of an overlay, as much weaker as its opacity says."""
    return opacity(alpha, share)


def luma(img: Column, brightness: float = 0.0, contrast: float = 1.0) -> Column:
    """Brightness and contrast on the luma plane: scaled around the middle, then moved."""
    return F.transform(img, lambda row: F.transform(row, lambda p: _byte(F.round((p - 128) * contrast + 128 + brightness * 255))))


def chroma(img: Column, saturation: float) -> Column:
    """Saturation on a chroma plane: scaled around the middle."""
    return luma(img, 0.0, saturation)


def key_out(img: Column, colour: int, similar: float, background: int = 0) -> Column:
    """Pixels close to a value give way to the background."""
    return F.transform(img, lambda row: F.transform(row, lambda p: F.when(F.abs(p - colour) <= similar * 255, F.lit(background)).otherwise(p)))


def checksum(img: Column) -> Column:
    """A sum over a picture in which each pixel counts by its place, to compare pictures."""
    flat = F.flatten(img)
    return F.aggregate(F.transform(flat, lambda p, i: p.cast("long") * (i % 97 + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
