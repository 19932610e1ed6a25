"""Special functions as folds over fixed sequences, so that p-values stay in the query plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7, n = 9.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x: Column | float) -> Column:
    """ln of the gamma function for x > 0."""
    z = _col(x) - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def gamma_p(a: Column | float, x: Column | float, terms: int = 300) -> Column:
    """Regularised lower incomplete gamma function, by its power series of ``terms`` terms; 0 for x <= 0."""
    a, x = _col(a), _col(x)
    one = F.lit(1.0) / a
    step = lambda s, n: F.struct((s["t"] * x / (a + n)).alias("t"), (s["s"] + s["t"] * x / (a + n)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(one.alias("t"), one.alias("s")), step, lambda s: s["s"])
    return F.when(x <= 0, F.lit(0.0)).otherwise(total * F.exp(-x + a * F.ln(x) - lgamma(a)))


def normal_cdf(z: Column | float) -> Column:
    """Standard normal distribution function."""
    z = _col(z)
    half = gamma_p(0.5, F.least(z * z / 2, F.lit(60.0))) / 2
    return F.when(z >= 0, 0.5 + half).otherwise(0.5 - half)


def _beta_fraction(x: Column, a: Column, b: Column, rounds: int = 120) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence; settled values stay."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def half(s: Column, c: Column) -> Column:
        d = F.lit(1.0) / safe(1 + c * s["d"])
        k = safe(1 + c / s["c"])
        return F.struct(k.alias("c"), d.alias("d"), (s["h"] * d * k).alias("h"))

    def both(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # nested folds keep each state an ordinary variable, so expressions do not grow with every use
        after = F.aggregate(F.array(even, odd), s, half)
        return after

    first = F.lit(1.0) / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, both, lambda s: s["h"])


def beta_i(x: Column | float, a: Column | float, b: Column | float) -> Column:
    """Regularised incomplete beta function."""
    x, a, b = _col(x), _col(a), _col(b)
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    inner = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(x, a, b) / a).otherwise(1 - front * _beta_fraction(1 - x, b, a) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_two_tailed(t: Column, df: Column) -> Column:
    """Two-tailed p of Student's t; 1 where df is not positive, 0 where t is infinite."""
    x = F.when(df > 0, df / (df + t * t)).otherwise(1.0)
    return F.when(df <= 0, 1.0).when(F.abs(t) == float("inf"), 0.0).otherwise(beta_i(x, df / 2, 0.5))


def chi2_tail(chi2: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution: 1 minus the series of the lower one (cancels for tiny tails)."""
    return F.when((chi2 <= 0) | (df <= 0), 1.0).otherwise(1 - gamma_p(df / 2, chi2 / 2))
