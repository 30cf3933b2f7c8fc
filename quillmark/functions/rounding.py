"""Rounding of the exact binary value to decimal digits, halves to even, as built-in expressions.

A report's 2.675 is a binary number just under it, so it rounds to 2.67. The product with a power of ten is taken
without an error, as a double and the double that it is off by; what is left over the whole number below is compared
with a half exactly. The quotient of two whole numbers is then rounded once, by the division itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^27 + 1 splits a double into two halves whose products are exact; doubles from 2^52 on are whole.
_SPLIT, _WHOLE = 134217729.0, 4503599627370496.0


def _halves(x: float) -> tuple[float, float]:
    c = _SPLIT * x
    high = c - (c - x)
    return high, x - high


def _nearest(p: Column, high: Column, low: Column, digits: int) -> Column:
    """The whole number nearest to (high + low) * 10^digits, of two the even one; p is that product as a double, under
    2^52, and high and low have no more than half a double's digits each."""
    s, t = _halves(10.0**digits)
    off = ((high * s - p) + high * t + low * s) + low * t
    over = (p - F.floor(p)) - 0.5 + off
    return F.floor(p) + F.when((over > 0) | ((over == 0) & (F.floor(p) % 2 == 1)), 1).otherwise(0)


def with_rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """df with the named columns, doubles, rounded to so many decimal digits (0 to 15): what a number stands for in binary
    is rounded, halves to the even digit. Null, NaN and the infinities stay as they are.

    In steps, so that no figure is worked out more than once: a step that several others refer to isn't merged."""
    if not all(0 <= d <= 15 for d in digits.values()):
        raise ValueError("0 to 15 digits")
    columns, a = df.columns, {c: F.col(f"`__a_{c}`") for c in digits}
    out = df.select("*", *[F.abs(F.col(f"`{c}`").cast("double")).alias(f"__a_{c}") for c in digits])
    # where a product would have no room for halves, the digits behind the point are rounded alone
    out = out.select("*", *[F.when(a[c] < _WHOLE / 10.0**d, a[c]).when(a[c] < _WHOLE, a[c] - F.floor(a[c])).alias(f"__v_{c}") for c, d in digits.items()])
    v = {c: F.col(f"`__v_{c}`") for c in digits}
    out = out.select("*", *[x for c, d in digits.items() for x in ((v[c] * 10.0**d).alias(f"__p_{c}"), (v[c] * _SPLIT - (v[c] * _SPLIT - v[c])).alias(f"__h_{c}"))])
    p, h = ({c: F.col(f"`__{k}_{c}`") for c in digits} for k in "ph")
    out = out.select("*", *[_nearest(p[c], h[c], v[c] - h[c], d).alias(f"__n_{c}") for c, d in digits.items()])

    def final(c: str, d: int) -> Column:
        n, scale = F.col(f"`__n_{c}`"), int(10**d)
        far = F.concat((F.floor(a[c]) + F.when(n == scale, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), d, "0")).cast("double") if d else n.cast("double")
        size = F.when(a[c] < _WHOLE / scale, n / float(scale)).when(a[c] < _WHOLE, far).otherwise(a[c])
        return F.when(F.isnan(c), F.col(f"`{c}`")).when(F.col(f"`{c}`") < 0, -size).otherwise(size)

    return out.select(*[final(c, digits[c]).alias(c) if c in digits else F.col(f"`{c}`") for c in columns])
