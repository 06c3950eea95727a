"""Distances, norms, quantizer codes and bit counts of array columns, as built-in expressions.

Vectors are stored as floats and computed with as doubles. Every distance is "lower is better" through distance().
"""

from __future__ import annotations

from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-12


class Metric(Enum):
    L2 = "l2"
    IP = "ip"
    COSINE = "cosine"


def parse_metric(name: str | Metric) -> Metric:
    """The metric of a name; unknown names are squared L2."""
    if isinstance(name, Metric):
        return name
    return {"cosine": Metric.COSINE, "ip": Metric.IP, "inner_product": Metric.IP, "dot": Metric.IP}.get(name, Metric.L2)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(v: Column, zero: Column | None = None) -> Column:
    return F.aggregate(v, F.lit(0.0) if zero is None else zero, lambda a, x: a + x)


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences; null if the lengths differ."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm_squared(v: Column) -> Column:
    return _sum(F.transform(doubles(v), lambda x: x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine kept within [-1, 1]; 0 where the product of the norms is at most 1e-12."""
    size = F.sqrt(norm_squared(a) * norm_squared(b))
    return F.when(size <= TINY, 0.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / size)))


def distance(metric: str | Metric, a: Column, b: Column) -> Column:
    """Lower is better: squared L2, the negated inner product, or cosine distance."""
    m = parse_metric(metric)
    return {Metric.L2: l2_squared, Metric.IP: lambda x, y: -inner_product(x, y), Metric.COSINE: cosine_distance}[m](a, b)


def normalize(v: Column) -> Column:
    """The vector divided by its norm; unchanged where the squared norm is at most 1e-12."""
    size = norm_squared(v)
    factor = F.when(size > TINY, 1 / F.sqrt(size)).otherwise(1.0)
    return bound(factor, lambda f: F.transform(doubles(v), lambda x: x * f))


def integer_l2(a: Column, b: Column) -> Column:
    """Exact squared L2 of byte codes; 0 for null or empty ones."""
    long = lambda v: v.cast("array<bigint>")
    return F.coalesce(_sum(F.zip_with(long(a), long(b), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long")), F.lit(0).cast("long"))


def integer_ip(a: Column, b: Column) -> Column:
    """Exact inner product of byte codes; 0 for null or empty ones."""
    long = lambda v: v.cast("array<bigint>")
    return F.coalesce(_sum(F.zip_with(long(a), long(b), lambda x, y: x * y), F.lit(0).cast("long")), F.lit(0).cast("long"))


def approximate_rsqrt(x: np.ndarray) -> np.ndarray:
    """1 / sqrt(x) in single precision from the exponent's halving and one Newton step; 0 for x <= 0."""
    x = np.asarray(x, np.float32)
    good = x > 0
    safe = np.where(good, x, np.float32(1))
    # Fixed value: the well-known start of the halved exponent.
    y = (np.int32(0x5F3759DF) - (safe.view(np.int32) >> 1)).view(np.float32)
    y = y * (np.float32(1.5) - np.float32(0.5) * safe * y * y)
    return np.where(good, y, np.float32(0))


def fast_rsqrt(x: Column) -> Column:
    """approximate_rsqrt() of a column. SQL can't read a float's bits, so this is an Arrow function."""

    @F.pandas_udf(DoubleType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(approximate_rsqrt(v.to_numpy(np.float32)).astype(np.float64))

    return run(x)


def cosine_distance_fast(a: Column, b: Column) -> Column:
    """Cosine distance by fast_rsqrt; 0 where the product of the squared norms is at most 1e-12."""
    size = norm_squared(a) * norm_squared(b)
    near = inner_product(a, b) * fast_rsqrt(size)
    return F.when(size <= TINY, 0.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near)))


def sign_words(v: Column, dim: int) -> Column:
    """One bit for each component that is at least 0: bit d % 64 of word d / 64."""

    def word(x: Column, w: int) -> Column:
        places = F.sequence(F.lit(64 * w), F.lit(min(dim, 64 * w + 64) - 1))
        bit = lambda a, d: a.bitwiseOR(F.when(F.get(x, d) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), d - 64 * w)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(places, F.lit(0).cast("long"), bit)

    return bound(v, lambda x: F.array(*(word(x, w) for w in range((dim + 63) // 64))))


def sign_values(words: Column, dim: int) -> Column:
    """+1 and -1 for the bits of sign_words()."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    bit = lambda w, d: F.call_function("shiftright", F.get(w, F.floor(d / 64).cast("int")), d % 64).bitwiseAND(F.lit(1).cast("long"))
    return bound(words, lambda w: F.transform(places, lambda d: F.when(bit(w, d) == 1, 1.0).otherwise(-1.0)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_inner_product(q: Column, words: Column, dim: int) -> Column:
    """Inner product of a vector with the signs: twice the sum over set bits less the sum of all. Higher is better."""
    q = doubles(q)
    picked = F.zip_with(q, sign_values(words, dim), lambda x, s: F.when(s > 0, x).otherwise(0.0))
    return 2 * _sum(picked) - _sum(q)


def scalar_code(v: Column, lo: Column, hi: Column, levels: int) -> Column:
    """Codes 0 .. levels: components held to [lo, hi] and rounded, halves upwards."""
    step = (hi - lo) / levels  # of literals or bound values
    return F.transform(doubles(v), lambda x: F.floor((F.greatest(lo, F.least(hi, x)) - lo) / step + 0.5).cast("int"))


def scalar_value(code: Column, lo: Column, hi: Column, levels: int) -> Column:
    return F.transform(code, lambda c: lo + c * ((hi - lo) / levels))


def pack_nibbles(code: Column, dim: int) -> Column:
    """Two codes in a byte: the even place in the low half, the odd one in the high half, which is 0 at an odd end."""
    places = F.sequence(F.lit(0), F.lit((dim - 1) // 2))
    byte = lambda c, i: F.get(c, 2 * i).bitwiseOR(F.shiftleft(F.coalesce(F.get(c, 2 * i + 1), F.lit(0)), 4))
    return bound(code, lambda c: F.transform(places, lambda i: byte(c, i)))


def unpack_nibbles(packed: Column, dim: int) -> Column:
    both = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)), F.shiftright(b, 4).bitwiseAND(F.lit(15)))))
    return F.slice(both, 1, dim)


def lookup_nibbles(lut: Column, packed: Column) -> Column:
    """Entries of a table of 16 for the low halves of the bytes, then for the high halves."""
    low = F.transform(packed, lambda b: F.get(lut, b.bitwiseAND(F.lit(15))))
    return F.concat(low, F.transform(packed, lambda b: F.get(lut, F.shiftright(b, 4).bitwiseAND(F.lit(15)))))
