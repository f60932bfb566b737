"""Scalar expressions. A missing value is NULL; NaN and infinities never leave an operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and plus or minus infinity become NULL."""
    x = col(x)
    return F.when(F.abs(x) < F.lit(INFINITY), x)


def number(x: Column | str) -> Column:
    """Read as a double; text that is no number becomes NULL."""
    return finite(col(x).try_cast("double"))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Quotient, NULL for a zero or missing denominator."""
    return finite(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def safe_log(x: Column | str) -> Column:
    x = col(x)
    return finite(F.when(x > 0, F.ln(x)))


def safe_sqrt(x: Column | str) -> Column:
    x = col(x)
    return finite(F.when(x >= 0, F.sqrt(x)))


def safe_log1p(x: Column | str) -> Column:
    x = col(x)
    return finite(F.when(x > -1, F.log1p(x)))


def sign(x: Column | str) -> Column:
    return F.signum(col(x))


def interaction(*xs: Column | str) -> Column:
    """Product of two or more columns."""
    if len(xs) < 2:
        raise ValueError("interaction needs at least two columns")
    out = col(xs[0])
    for x in xs[1:]:
        out = out * col(x)
    return finite(out)


def clip(x: Column | str, lower=None, upper=None) -> Column:
    """Limit to [lower, upper]; NULL stays NULL (greatest/least would skip it)."""
    x = col(x)
    out = x
    if upper is not None:
        upper = upper if isinstance(upper, Column) else F.lit(float(upper))
        out = F.when(x > upper, upper).otherwise(out)
    if lower is not None:
        lower = lower if isinstance(lower, Column) else F.lit(float(lower))
        out = F.when(x < lower, lower).otherwise(out)
    return out


def sigmoid(x: Column | str, bound: float = 20.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -bound, bound)))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1.0 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def larger(a: Column, b: Column) -> Column:
    """Larger of two, NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    """Smaller of two, NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def row_mean(xs: Sequence[Column | str]) -> Column:
    """Mean over columns, skipping NULLs; NULL if all are missing."""
    xs = [col(x) for x in xs]
    total, count = F.lit(0.0), F.lit(0)
    for x in xs:
        total = total + F.coalesce(x, F.lit(0.0))
        count = count + x.isNotNull().cast("int")
    return F.try_divide(total, count)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also where it is unknown)."""
    return F.when(condition, 1.0).otherwise(0.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over pairs with both sides present.

    NULL for a constant side, where the built-in ``corr`` divides by zero.
    """
    a = F.when(y.isNotNull(), x)
    b = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(a) * F.stddev_samp(b))
