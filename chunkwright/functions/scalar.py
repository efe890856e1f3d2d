"""Column helpers: ratios, clamps, vectors and names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column | str, low: float, high: float) -> Column:
    """x held between two bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(x)))


def rounded(x: Column | str, digits: int) -> Column:
    """x rounded half up by size; what rounds to zero from below stays a negative zero, as in SQL engines that round in floating point."""
    return F.round(F.abs(_col(x)), digits) * F.signum(_col(x))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b where b is positive, else 0."""
    return F.when(_col(b) > 0, _col(a) / _col(b)).otherwise(F.lit(0.0))


def as_double(x: Column | str) -> Column:
    """A number, or null where the text holds none."""
    return _col(x).try_cast("double")


def basename(path: Column | str) -> Column:
    """What follows the last slash."""
    return F.substring_index(_col(path), "/", -1)


def stem(name: Column | str) -> Column:
    """What precedes the first dot."""
    return F.substring_index(_col(name), ".", 1)


def strip_suffix(name: Column | str, suffix: str) -> Column:
    """The name without a suffix at its very end."""
    return F.regexp_replace(_col(name), rf"\Q{suffix}\E$", "")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(a: Column | str, eps: float = 1e-10) -> Column:
    """The array over its norm plus eps."""
    norm = F.sqrt(dot(a, a)) + F.lit(eps)
    # an array of norms, as what a lambda refers to is worked out for each element
    return F.zip_with(_col(a), F.array_repeat(norm, F.size(_col(a))), lambda x, n: x.cast("double") / n)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x scaled to 0.1 .. 1 between its extremes; 0.5 where they are equal."""
    return F.when(high != low, F.lit(0.1) + F.lit(0.9) * (x - low) / (high - low)).otherwise(F.lit(0.5))


def seconds_since(ts: Column | str, origin: str = "2024-01-01 00:00:00") -> Column:
    """Seconds from an origin to a zone-less timestamp."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{origin}', {name}) / 1e6D")


def frame_name(base: Column | str, t: Column | str) -> Column:
    """Image name of a keyframe: base, whole seconds, extension."""
    return F.concat(_col(base), F.lit("_"), _col(t).cast("int").cast("string"), F.lit(".jpg"))


def band_label(x: Column | str, edge: float, above: str, below: str) -> Column:
    """A label by whether x is above an edge."""
    return F.when(_col(x) > edge, F.lit(above)).otherwise(F.lit(below))


def has_text(x: Column | str) -> Column:
    """1 where the text holds anything but blanks, else 0."""
    return F.coalesce((F.trim(_col(x)) != "").cast("int"), F.lit(0))


def first_or(a: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.get(_col(a), F.lit(0)), F.lit(default))


def last_or(a: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(_col(a), F.lit(-1)), F.lit(default))


def chunked(a: Column | str, size: int) -> Column:
    """An array cut into arrays of one size; the last is padded with zeros."""
    a = _col(a)
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), size)), i + 1, size))


def padded(a: Column | str, size: int, fill: int) -> Column:
    """An array cut or filled up to a size."""
    return F.slice(F.concat(_col(a), F.array_repeat(F.lit(fill), size)), 1, size)


def framed(a: Column | str, most: int, first: int, last: int) -> Column:
    """A token array cut to leave room for a first and a last mark, and framed by them."""
    return F.concat(F.array(F.lit(first)), F.slice(_col(a), 1, most - 2), F.array(F.lit(last)))


def laplacian(pixels: Column | str, width: int) -> Column:
    """The 3 x 3 Laplacian of a gray image, whose rows follow each other in an array; beyond an edge the row next to it counts again (the edge itself in an image of one row or column)."""
    p, n = _col(pixels), F.size(_col(pixels))
    height = F.floor(n / width).cast("int")
    flat = (height < 2) | F.lit(width < 2)

    def mirrored(x: Column, size: Column) -> Column:
        return F.when(flat, F.greatest(F.lit(0), F.least(x, size - 1))).when(x < 0, -x).when(x >= size, 2 * size - 2 - x).otherwise(x)

    def at(row: Column, col: Column) -> Column:
        place = mirrored(row, height) * width + mirrored(col, F.lit(width))
        return F.get(p, place.cast("int")).cast("double")

    def one(x: Column, i: Column) -> Column:
        row, col = F.floor(i / width).cast("int"), i % width
        return at(row - 1, col) + at(row + 1, col) + at(row, col - 1) + at(row, col + 1) - 4 * x.cast("double")

    return F.transform(p, one)


def variance(a: Column | str) -> Column:
    """Population variance of an array; 0 of an empty one."""
    a = _col(a)
    size = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / size
    apart = F.zip_with(a, F.array_repeat(mean, size), lambda x, m: (x - m) * (x - m))  # the mean is worked out once
    return F.when(size > 0, F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / size).otherwise(F.when(size == 0, F.lit(0.0)))
