"""Vector expressions: quantisation and squared Euclidean distance, all exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(vec: Column, scale: int = 127) -> Column:
    """Floats in [-1, 1] as integers: floor(x * scale)."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def quantize_sift(vec: Column) -> Column:
    """512 * x - 128, truncated toward zero and wrapped into a signed byte."""
    return F.transform(vec, lambda x: (F.pmod((F.lit(512) * x.cast("double") - 128).cast("int") + 128, F.lit(256)) - 128).cast("int"))


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("bigint") * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def l2_guarded(a: Column, b: Column) -> Column:
    """Null (no match) for vectors of unequal length."""
    return F.when(F.size(a) == F.size(b), l2_squared(a, b))


def l2_shorter(a: Column, b: Column) -> Column:
    """Over the length of the shorter vector."""
    n = F.least(F.size(a), F.size(b))
    return l2_squared(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def selection_score(dist: Column, best: Column) -> Column:
    """0.5 - best / (2 dist); null where the distance is 0."""
    return F.when(dist != 0, F.lit(0.5) - best / (F.lit(2) * dist))


def score_text(score: Column) -> Column:
    """A score of 0 to 0.5 with six digits, rounded as C's printf does: by the exact binary value, ties to the even digit.

    ``format_string`` rounds the shortest decimal form half up, which differs (0.0078125 and such). A score is 0.5 less a
    double, so a multiple of 2^-54; its product with 10^6 is taken in two halves of 27 bits.
    """
    half = (1 << 27) - 1
    units = (score * F.lit(float(1 << 54))).cast("bigint")
    low = units.bitwiseAND(F.lit(half)) * 1_000_000
    high = F.shiftright(units, 27) * 1_000_000 + F.shiftright(low, 27)
    whole, rest = F.shiftright(high, 27), F.shiftleft(high.bitwiseAND(F.lit(half)), 27) + low.bitwiseAND(F.lit(half))
    up = (rest > 1 << 53) | ((rest == 1 << 53) & (whole % 2 == 1))
    return F.concat(F.lit("0."), F.lpad((whole + up.cast("bigint")).cast("string"), 6, "0"))
