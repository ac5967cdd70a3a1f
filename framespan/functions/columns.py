"""Scalar functions as Column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def _float(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def u16(level: Column) -> Column:
    """A level from 0 to 1 as a whole number up to 65535, in 32-bit float arithmetic; NaN is 0."""
    clean = F.when(F.isnan(level.cast("double")), F.lit(0.0)).otherwise(F.least(F.greatest(level.cast("double"), F.lit(0.0)), F.lit(1.0)))
    return (_float(clean) * _float(65535) + _float(0.5)).cast("int")


def s16(sample: Column) -> Column:
    """A sample from -1 to 1 as a whole number up to 32767 either way, half away from zero."""
    clean = F.when(F.isnan(sample.cast("double")), F.lit(0.0)).otherwise(F.least(F.greatest(sample.cast("double"), F.lit(-1.0)), F.lit(1.0)))
    return F.round(clean * 32767).cast("int")


def u16_value(level: Column) -> Column:
    return level.cast("double") / 65535


def u24(level: Column) -> Column:
    """A fraction from 0 to 1 as a whole number up to 2**24 - 1."""
    return F.floor(F.least(F.greatest(level.cast("double"), F.lit(0.0)), F.lit(1.0)) * 16777215 + 0.5).cast("int")


def shortest_decimal(level: Column) -> Column:
    """The value of a u16 level with the fewest digits (1 to 5) that quantize to it again."""
    value = u16_value(level)
    digits = F.filter(F.array(*(F.lit(k) for k in range(1, 6))), lambda d: u16(F.round(value * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d)) == level)
    d = F.coalesce(F.get(digits, F.lit(0)), F.lit(5))
    whole = F.round(value * F.pow(F.lit(10.0), d)).cast("long")
    scale = F.round(F.pow(F.lit(10.0), d)).cast("long")
    head, tail = F.floor(whole / scale).cast("long"), F.lpad((whole % scale).cast("string"), d, F.lit("0"))
    return F.concat(head.cast("string"), F.lit("."), tail)


def bucket_start(k: Column, rate: int, timebase: Fraction) -> Column:
    """First sample of bucket ``k``: round(k * rate / timebase), half away from zero, in whole numbers."""
    num, den = rate * timebase.denominator, timebase.numerator
    return _div(2 * k.cast("long") * num + den, 2 * den)


def _div(a: Column, b) -> Column:
    """Whole division of longs that are not negative."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    return ((a - a % b) / b).cast("long")


def whole_div(a: Column, b) -> Column:
    """Division of longs, towards zero."""
    return _div(a.cast("long"), b)


def sample_bucket(sample: Column, rate: int, timebase: Fraction) -> Column:
    """The bucket that a sample stands in, the inverse of ``bucket_start``."""
    num, den = rate * timebase.denominator, timebase.numerator
    guess = _div(sample.cast("long") * den, num)
    return F.when(bucket_start(guess + 1, rate, timebase) <= sample, guess + 1).when(bucket_start(guess, rate, timebase) > sample, guess - 1).otherwise(guess)


def sample_span(start: Column, dur: Column, rate: int, timebase: Fraction) -> tuple[Column, Column]:
    """Samples [from, to) of the frames [start, start + dur); both ends come from absolute frames."""
    num, den = rate * timebase.denominator, timebase.numerator
    return _div(start.cast("long") * num, den), _div((start + dur).cast("long") * num, den)


def clip_bounds(start: Column, end: Column, speed: Column) -> tuple[Column, Column]:
    """Offset and duration, in frames of the timeline, of the source frames [start, end) at a speed; 0 if it rounds to nothing."""
    speed = speed.cast("double")
    nothing = F.round((end - start) / speed) == 0
    offset, stop = F.ceil(start / speed).cast("long"), F.ceil(end / speed).cast("long")
    return offset, F.when(nothing, F.lit(0).cast("long")).otherwise(stop - offset)


def float32(x: Column) -> Column:
    """As stored in an action: a 32-bit number, used as a 64-bit one."""
    return x.cast("float").cast("double")


def ease(curve: str | Column, t: Column) -> Column:
    """Eased position: linear, in, out, inout."""
    c = F.lit(curve) if isinstance(curve, str) else curve
    inout = F.when(t < 0.5, 2 * t * t).otherwise(1 - (2 - 2 * t) * (2 - 2 * t) / 2)
    return F.when(c == "in", t * t).when(c == "out", 1 - (1 - t) * (1 - t)).when(c == "inout", inout).otherwise(t)


def clip_position(frame: Column, dur: Column) -> Column:
    """0 at the first frame, 1 at the last and beyond; 0 in clips of a frame."""
    return F.when(dur <= 1, F.lit(0.0)).otherwise(F.least(F.greatest(frame / (dur - 1), F.lit(0.0)), F.lit(1.0)))


def sample_keyframes(values: Column, p: Column) -> Column:
    """Linear interpolation in an array of evenly spaced values at a position from 0 to 1."""
    n = F.size(values)
    x = p * (n - 1)
    low = F.least(F.floor(x).cast("int"), n - 1)
    high = F.least(low + 1, n - 1)
    a, b = F.get(values, low), F.get(values, high)
    return a + (b - a) * (x - low)


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def decibels(linear: Column) -> Column:
    return F.when(linear <= 0, F.lit(-90.0)).otherwise(20 * F.log10(linear))


def note_hertz(note: Column) -> Column:
    """Frequency of a MIDI note."""
    return 440 * F.pow(F.lit(2.0), (note - 69) / 12)


def angle_code(degrees: Column) -> Column:
    """An angle as a whole number from 0 to 65535 around the circle."""
    turn = F.pmod(degrees.cast("double"), F.lit(360.0))
    return F.pmod(F.floor(turn / 360 * 65536 + 0.5), F.lit(65536)).cast("int")


def timecode(ms: Column, style: str = "standard") -> Column:
    """Whole milliseconds as HH:MM:SS.mmm (standard), HH:MM:SS,mmm (srt), H:MM:SS.cc (ass) or H:MM:SS (display)."""
    sign = F.when(ms < 0, F.lit("-")).otherwise("")
    x = F.abs(ms.cast("long"))
    if style == "ass":
        x = _div(x + 5, 10)
        unit = 100
    elif style == "display":
        x = _div(x + 500, 1000)
        unit = 1
    else:
        unit = 1000
    h, m, s, rest = _div(x, 3600 * unit), _div(x, 60 * unit) % 60, _div(x, unit) % 60, x % unit
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = h.cast("string") if style in ("ass", "display") else F.when(h < 100, two(h)).otherwise(h.cast("string"))
    out = F.concat(sign, hours, F.lit(":"), two(m), F.lit(":"), two(s))
    if style == "display":
        return out
    mark, width = ("," if style == "srt" else "."), 2 if style == "ass" else 3
    return F.concat(out, F.lit(mark), F.lpad(rest.cast("string"), width, "0"))


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that they fill."""
    x = n.cast("double")
    whole = lambda p: F.format_string("%.2f", F.bround(x / 1024**p, 2))  # noqa: E731 (a tie goes to the even digit)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(whole(1), F.lit(" KiB"))).when(n < 1024**3, F.concat(whole(2), F.lit(" MiB"))).otherwise(F.concat(whole(3), F.lit(" GiB")))


def dialogue_text(line: Column) -> Column:
    """The words of a styled subtitle event: after eight commas, without ``{...}``, with its line breaks and spaces decoded."""
    body = F.regexp_extract(line, r"(?s)^(?:[^,]*,){8}(.*)$", 1)
    bare = F.regexp_replace(body, r"\{[^}]*\}", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\\N", "\n"), r"\\[nh]", " ")


def uri_of_path(path: Column) -> Column:
    """A file URI with percent-encoding of all but unreserved characters and slashes."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")))


def path_of_uri(uri: Column) -> Column:
    """The path of a file URI; a plus sign is itself."""
    bare = F.regexp_replace(uri, r"^file://(localhost)?", "")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def cache_key(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of a SHA-1 over the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 16)


#: Aspect ratios that a frame size is taken for.
ASPECTS = ((1, 1), (4, 3), (3, 2), (16, 10), (16, 9), (21, 9), (9, 16), (3, 4), (2, 3), (5, 4), (4, 5), (239, 100), (185, 100))


def aspect_ratio(width: Column, height: Column, sar_num: Column | int = 1, sar_den: Column | int = 1) -> Column:
    """The ratio closest to a frame's shape, if its height is then at most 2 pixels off; else null."""
    shown = width * sar_num / (sar_den if isinstance(sar_den, Column) else F.lit(sar_den))
    found = F.array(*(F.struct(F.abs(shown * b / a - height).alias("off"), F.lit(k).alias("k"), F.lit(f"{a}:{b}").alias("ratio")) for k, (a, b) in enumerate(ASPECTS)))
    best = F.array_min(found)
    return F.when(best["off"] <= 2, best["ratio"])


def even_size(width: Column, height: Column, scale: Column | float) -> tuple[Column, Column]:
    """A size scaled and rounded to even numbers, at least 2."""
    even = lambda x: F.greatest(F.lit(2), (F.round(x * scale / 2) * 2).cast("int"))
    return even(width), even(height)


def base64url(text: Column) -> Column:
    """Bytes of URL-safe base64 without padding."""
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), ((4 - F.length(plain) % 4) % 4).cast("int"))))


def ease_length(value: Column, unit: Column, dur: Column, rate: Column | float) -> Column:
    """Frames that an easing lasts: seconds or frames, the whole clip where none is given."""
    return F.when(value.isNull(), dur).when(unit == "sec", F.greatest(F.lit(1), F.round(value * rate).cast("long"))).otherwise(F.greatest(F.lit(1), F.round(value).cast("long")))


def pack_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Four fractions in 24 bits each, as 24 hexadecimal digits."""
    return F.concat(*(F.lpad(F.hex(u24(c).cast("long")), 6, "0") for c in (x, y, w, h)))


def unpack_rect(packed: Column) -> Column:
    """The four fractions of ``pack_rect``."""
    return F.transform(F.array(*(F.substring(packed, 1 + 6 * k, 6) for k in range(4))), lambda p: F.conv(p, 16, 10).cast("double") / 16777215)
