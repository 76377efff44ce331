"""Math, random numbers and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_M32 = (1 << 32) - 1


def _imul(a: Column, b: Column | int) -> Column:
    """32-bit product of two columns below 2**32, in halves so that nothing overflows a bigint."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (low.bitwiseAND(F.lit(_M32)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(_M32))


def mulberry(seed: int, draw: Column) -> Column:
    """The draw-th number (from 0) of the seed's mulberry32 sequence, in [0, 1): no state is carried."""
    step = 0x6D2B79F5
    t = (F.lit(seed).cast("bigint") + _imul((draw + 1).cast("bigint").bitwiseAND(F.lit(_M32)), step)).bitwiseAND(F.lit(_M32))
    t = _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1)))
    u = (t + _imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_M32))
    t = t.bitwiseXOR(u)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def between(u: Column, lo: float, hi: float) -> Column:
    return lo + (hi - lo) * u


def between_int(u: Column, lo: int, hi: int) -> Column:
    """A whole number from ``lo`` to ``hi``, both included."""
    return F.floor(between(u, lo, hi + 1)).cast("int")


def gaussian(u: Column, v: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """Box and Muller's cosine branch."""
    return mean + deviation * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def clamp(v: Column, lo, hi) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def lerp(a, b, t: Column) -> Column:
    return F.lit(a) + (F.lit(b) - F.lit(a)) * t


def inverse_lerp(a, b, v: Column) -> Column:
    return F.try_divide(v - F.lit(a), F.lit(b) - F.lit(a))


def remap(v: Column, a, b, c, d) -> Column:
    return lerp(c, d, inverse_lerp(a, b, v))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def first_two(vector: Column) -> Column:
    """The first two dimensions, a missing second one as 0."""
    return F.slice(F.concat(vector.cast("array<double>"), F.array(F.lit(0.0))), 1, 2)


def ease_out(t: Column) -> Column:
    return 1 - F.pow(1 - t, 3)


def progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.floor(F.try_divide(done, total) * 100 + 0.5)).cast("int")


def blend(p: Column, low: int, high: int) -> Column:
    """One colour channel between two ends, rounded half up."""
    return F.floor(low * (1 - p) + high * p + 0.5).cast("int")


def predicted(p: Column, strict: bool = False) -> Column:
    """The class of a probability: 1 from a half on, or, ``strict``, above it."""
    return (p > 0.5 if strict else p >= 0.5).cast("int")


def fixed(v: Column, digits: int) -> Column:
    """A number with so many digits after the point."""
    return F.format_string(f"%.{digits}f", v.cast("double"))


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def short(v: Column, digits: int = 2) -> Column:
    """At most so many digits after the point, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(fixed(v, digits), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(fixed(share * 100, digits), F.lit("%"))
