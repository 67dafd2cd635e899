"""Normal and t distributions without a statistics library."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), from the constant term up
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
#: Probabilities are clipped to this distance from 0 and 1.
CLIP = 1e-6


def _poly(coefficients: tuple[float, ...], r: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * r + c
    return out


def probit(p: Column, clip: float = CLIP) -> Column:
    """The standard normal quantile as an expression, to double accuracy."""
    p = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    q = p - 0.5
    near = 0.180625 - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = (r - 1.6)
    far = (r - 5.0)
    tail = F.when(r <= 5.0, _poly(_C, middle) / _poly(_D, middle)).otherwise(_poly(_E, far) / _poly(_F, far))
    return F.when(F.abs(q) <= 0.425, q * _poly(_A, near) / _poly(_B, near)).otherwise(F.signum(q) * tail)


def fisher_interval(r: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Fisher's interval of a correlation; r is clipped to +-0.999999, null for n <= 3."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    at = F.atanh(F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999)))
    half = F.when(n > 3, z / F.sqrt(F.when(n > 3, n - 3)))
    return F.tanh(at - half), F.tanh(at + half)


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile by bisection of the distribution function."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_cdf(t: float, df: int) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def wilcoxon(ranks: list[tuple[float, bool]], n_zero: int = 0) -> float:
    """Two-sided p of the signed-rank test from (rank of |d|, d > 0) of the non-zero differences:
    the exact null up to 50 pairs without ties or zeros, else the normal law with the tie correction."""
    n = len(ranks)
    if not n:
        return 1.0
    w = min(sum(r for r, up in ranks if up), sum(r for r, up in ranks if not up))
    sizes: dict[float, int] = {}
    for r, _ in ranks:
        sizes[r] = sizes.get(r, 0) + 1
    ties = [t for t in sizes.values() if t > 1]
    if n <= 50 and not ties and not n_zero:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - sum(t**3 - t for t in ties) / 2) / 24)
    return min(1.0, 2 * NormalDist().cdf((w - n * (n + 1) / 4) / spread)) if spread else 1.0
