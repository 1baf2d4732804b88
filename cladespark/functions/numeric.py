"""Small number functions as columns."""

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers; a 64-bit pair needs 92 of Euclid's steps at most."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b")), step, lambda s: s["a"])


def choose(n: Column, k: Column) -> Column:
    """Ways to choose k of n; 0 where they pass 64 bits, or k isn't between 0 and n."""
    low = F.least(k, n - k)
    wide = lambda x: x.cast("decimal(38,0)")
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    step = lambda s, i: F.when(s > top, s).otherwise((s * wide(n - low + i) / wide(i)).cast("decimal(38,0)"))
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1)).cast("long")), wide(F.lit(1)), step)
    out = F.when((k < 0) | (k > n), 0).when(low == 0, 1).when(ways > top, 0).otherwise(ways)
    return out.cast("long")


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside of (0, 1)."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return p.map(lambda x: inv(x) if 0 < x < 1 else None).astype(float)

    return quantile(p)


def first_bit(x: Column) -> Column:
    """Place of the lowest set bit, from 1; 0 where none is set."""
    return F.when(x == 0, 0).otherwise(F.bit_count(x.bitwiseXOR(x - 1)))


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function; null where x isn't above 0."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.lgamma(v) if v > 0 else None).astype(float)

    return of(x.cast("double"))


def _each(f, *columns: pd.Series) -> pd.Series:
    """f of each row's values; of equal rows of a batch it is found once."""
    once = lru_cache(1 << 16)(f)
    return pd.Series([once(*row) for row in zip(*columns, strict=True)], dtype=float)


def gamma_ratio(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function of shape a; null where a isn't above 0."""

    @F.pandas_udf("double")
    def of(a: pd.Series, x: pd.Series) -> pd.Series:
        from ..operators import likelihood

        return _each(lambda a, x: likelihood.gamma_ratio(a, x) if a > 0 and x == x else None, a, x)

    return of(a.cast("double"), x.cast("double"))


def chi2_quantile(p: Column, df: Column) -> Column:
    """Quantile of the chi-squared distribution; null outside of (0, 1) or where df isn't above 0."""

    @F.pandas_udf("double")
    def of(p: pd.Series, df: pd.Series) -> pd.Series:
        from ..operators import likelihood

        return _each(lambda p, df: 2 * likelihood.gamma_quantile(p, df / 2) if 0 < p < 1 and df > 0 else None, p, df)

    return of(p.cast("double"), df.cast("double"))
