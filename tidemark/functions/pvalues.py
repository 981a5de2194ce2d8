"""p-values as column expressions, evaluated on the JVM by the mathematics library that Spark ships."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETA = "org.apache.commons.math3.special.Beta"
_ERF = "org.apache.commons.math3.special.Erf"


def _double(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def regularized_beta(x: Column | float, a: Column | float, b: Column | float) -> Column:
    """I_x(a, b); null where an argument is null, NaN or outside its range."""
    x, a, b = _double(x), _double(a), _double(b)
    good = (x >= 0) & (x <= 1) & ~F.isnan(x) & (a > 0) & (b > 0)
    safe = [F.when(good, c).otherwise(F.lit(0.5)) for c in (x, a, b)]  # the call itself must not meet nulls
    return F.when(good, F.reflect(F.lit(_BETA), F.lit("regularizedBeta"), *safe).cast("double"))


def erfc(z: Column | float) -> Column:
    """The complementary error function; null for null."""
    z = _double(z)
    return F.when(z.isNotNull(), F.reflect(F.lit(_ERF), F.lit("erfc"), F.coalesce(z, F.lit(0.0))).cast("double"))


def t_two_sided(t: Column, df: Column | float) -> Column:
    """p of a t statistic with df degrees of freedom, both sides."""
    df = _double(df)
    return regularized_beta(df / (df + t * t), df / 2, 0.5)


def normal_two_sided(z: Column) -> Column:
    """p of a standard normal statistic, both sides."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0))))


def binomial_half(k: Column, n: Column) -> Column:
    """Exact two-sided p of k successes in n trials at probability 1/2; null for n = 0."""
    m = F.least(k, n - k).cast("double")
    tail = regularized_beta(0.5, n.cast("double") - m, m + 1)
    return F.when(n > 0, F.when(2 * k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def correlation(r: Column, n: Column) -> Column:
    """p of a correlation of n pairs; 0 for r = 1 or -1, null for fewer than 3 pairs."""
    n = n.cast("double")
    t2 = F.try_divide(r * r * (n - 2), 1 - r * r)
    p = regularized_beta(F.try_divide(n - 2, n - 2 + t2), (n - 2) / 2, 0.5)
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(p))
