"""Normal distribution and numeric guards as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal tail, highest degree first.
TAIL_NUMERATOR = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_DENOMINATOR = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# Coefficients of the rational approximation of the normal quantile, highest degree first.
QUANTILE_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
QUANTILE_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
POWER_COEF = 2.80158
MIN_GROUPS = 30


def _poly(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def finite(x: Column) -> Column:
    """True where x is a number, neither NaN nor infinite; false for null."""
    x = x.cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(x)
    near = F.exp(-a * a / 2) * _poly(TAIL_NUMERATOR, a) / _poly(TAIL_DENOMINATOR, a)
    b = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = F.exp(-a * a / 2) / b / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.0710678118654755, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x: Column) -> Column:
    """Standard normal density."""
    return F.exp(-x * x / 2) / 2.5066282746310002


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile; infinite outside of (0, 1)."""
    low = 0.02425
    q = p - 0.5
    r = q * q
    centre = _poly(QUANTILE_A, r) * q / _poly([*QUANTILE_B[:-1], 1.0], r)
    # Guarded logarithms: branches that don't apply see a harmless value.
    ql = F.sqrt(-2 * F.log(F.when((p > 0) & (p < low), p).otherwise(0.01)))
    qh = F.sqrt(-2 * F.log(F.when((p < 1) & (p > 1 - low), 1 - p).otherwise(0.01)))
    tail = lambda z: _poly(QUANTILE_C, z) / _poly(QUANTILE_D, z)
    inf = F.lit(float("inf"))
    return F.when(p <= 0, -inf).when(p >= 1, inf).when(p < low, tail(ql)).when(p > 1 - low, -tail(qh)).otherwise(centre)


def unit_normal_loss(d: Column) -> Column:
    """Expected loss of a standard normal beyond d."""
    return norm_pdf(d) - d * (1 - norm_cdf(d))


def guarded_skewness(x: Column) -> Column:
    """Population skewness; 0 for fewer than three values or no spread."""
    return F.when((F.count(x) < 3) | (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0), 0.0).otherwise(F.skewness(x))


def pearson_kurtosis(x: Column) -> Column:
    """Kurtosis with 3 for the normal; 3 for fewer than four values or no spread."""
    return F.when((F.count(x) < 4) | (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0), 3.0).otherwise(F.kurtosis(x) + 3)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - norm_cdf(F.abs(z)))
