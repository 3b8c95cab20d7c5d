"""Vector expressions. Elements are cast to double before any product, so results do not depend on
the order of partial sums beyond the last bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body is a lambda over elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sq_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def score(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric == "l2":
        return sq_l2(a, b)
    if metric == "ip":
        return inner_product(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def best_first(metric: str, column: str = "score") -> Column:
    return F.col(column).asc() if metric == "l2" else F.col(column).desc()


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_normalize(v: Column | str, floor: float = 1e-8) -> Column:
    """Divides by the norm, or by ``floor`` where that is larger."""
    return let(F.greatest(l2_norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def l2_normalize_guarded(v: Column | str) -> Column:
    """Divides by the norm; a zero vector stays as it is."""
    return let(l2_norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v)))


def rounded(x: Column, places: int) -> Column:
    """As SQL engines round doubles: scaled, to the nearest integer, halves away from zero, scaled back. The sign
    stays, so small negative numbers give -0.0; ``F.round`` takes decimal digits instead and gives 0.0."""
    scaled = x * F.lit(10.0**places)
    down = F.rint(F.abs(scaled))  # halves to even
    whole = down + F.when(F.abs(scaled) - down == 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(scaled) < float("inf"), F.signum(x) * whole / F.lit(10.0**places)).otherwise(x)


def median(v: Column | str) -> Column:
    """Mean of the two middle elements, or the middle one."""
    n = F.size(v)
    return let(F.array_sort(doubles(v)), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def binarize(v: Column | str) -> Column:
    """A bit per element: whether it lies above the median."""
    return let(median(v), lambda m: F.transform(v, lambda x: x.cast("double") > m))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def pack_bits(bits: Column | str, width: int = 32) -> Column:
    """Bits as longs of ``width`` bits each, so that distances are bit counts of exclusive ors."""
    words = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / width).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, (w * width + 1).cast("int"), F.lit(width)), F.lit(0).cast("long"), lambda s, x: s * 2 + x.cast("long")))


def packed_hamming(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
