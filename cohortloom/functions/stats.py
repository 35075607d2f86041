"""Closed forms: intervals and tests as columns, tails as small host functions.

Nothing here sees person-level rows: inputs are aggregated counts and moments.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(level: float = 0.95) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def wilson(events: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    z = z_value(level)
    p = events / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def newcombe(e1: Column, n1: Column, e2: Column, n2: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Interval of a risk difference from two Wilson intervals."""
    (l1, u1), (l2, u2), p1, p2 = wilson(e1, n1, level), wilson(e2, n2, level), e1 / n1, e2 / n2
    low = p1 - p2 - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = p1 - p2 + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return F.greatest(F.lit(-1.0), low), F.least(F.lit(1.0), high)


def smd_continuous(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    """Standardised mean difference; 0 for equal means without spread, else null."""
    pooled = F.sqrt((v1 + v2) / 2)
    return F.when(pooled > 0, (m1 - m2) / pooled).when(m1 == m2, 0.0)


def smd_proportion(p1: Column, p2: Column) -> Column:
    mean = (p1 + p2) / 2
    spread = F.sqrt(mean * (1 - mean))
    return F.when(spread > 0, (p1 - p2) / spread).when(p1 == p2, 0.0)


def e_value(ratio: Column) -> Column:
    """E-value of a risk ratio; ratios below 1 are inverted."""
    r = F.when(ratio < 1, 1 / ratio).otherwise(ratio)
    return r + F.sqrt(r * (r - 1))


def e_value_limit(ratio: Column, lower: Column, upper: Column) -> Column:
    """E-value of the interval's limit nearer to 1; 1 when the interval holds 1."""
    limit = F.when(ratio >= 1, lower).otherwise(upper)
    return F.when((lower <= 1) & (upper >= 1), 1.0).otherwise(e_value(limit))


def detectable_binary(n1: Column, n2: Column, baseline: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Least detectable risk difference of two arms at a baseline risk."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return z * F.sqrt(baseline * (1 - baseline) * (1 / n1 + 1 / n2))


def detectable_mean(n1: Column, n2: Column, sd: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return z * sd * F.sqrt(1 / n1 + 1 / n2)


def detectable_hazard_ratio(events: Column, share: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.exp(z / F.sqrt(events * share * (1 - share)))


def e_value_continuous(difference: Column, sd: Column) -> Column:
    """E-value of a mean difference, by the risk ratio exp(0.91 d) of its standardised size."""
    return e_value(F.exp(0.91 * difference / sd))


def detectable_rate_ratio(e1: Column, e2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Least detectable rate or hazard ratio above 1 at the events of both arms; null without events."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when((e1 > 0) & (e2 > 0), F.exp(z * F.sqrt(1 / e1 + 1 / e2)))


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p_1df(x: float) -> float:
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def beta_i(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def solve(f, low: float, high: float, steps: int = 200) -> float:
    """Root of a monotone function by bisection."""
    rising = f(high) > f(low)
    for _ in range(steps):
        mid = (low + high) / 2
        if (f(mid) > 0) == rising:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def poisson_interval(events: int, level: float = 0.95) -> tuple[float, float]:
    """Exact (Garwood) limits of a Poisson mean."""
    tail = (1 - level) / 2
    top = events + 10 * math.sqrt(events + 1) + 20
    low = 0.0 if events == 0 else solve(lambda m: gamma_p(events, m) - tail, 0.0, top)
    return low, solve(lambda m: 1 - gamma_p(events + 1, m) - tail, 0.0, top)


def rate_ratio(e1: int, t1: float, e2: int, t2: float, level: float = 0.95) -> dict[str, float | None]:
    """Rate ratio with the conditional binomial (Clopper-Pearson) interval and two-sided p-value."""
    n, share, tail = e1 + e2, t1 / (t1 + t2), (1 - level) / 2
    odds = lambda p: p / (1 - p) * t2 / t1 if p < 1 else math.inf
    low = 0.0 if e1 == 0 else solve(lambda p: 1 - beta_i(1 - p, n - e1 + 1, e1) - tail, 0.0, 1.0)
    high = 1.0 if e1 == n else solve(lambda p: beta_i(1 - p, n - e1, e1 + 1) - tail, 0.0, 1.0)
    k = np.arange(n)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1)) + math.log(share) - math.log1p(-share))]) + n * math.log1p(-share)
    chances = np.exp(logs - logs.max())
    p = float(chances[logs <= logs[e1] + 1e-9].sum() / chances.sum())
    return {"estimate": (e1 / t1) / (e2 / t2) if e2 else None, "lower": odds(low), "upper": odds(high), "p_value": min(1.0, p)}


def _hypergeometric(a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Support of the first cell given the margins, and log weights up to a constant, by the ratios of neighbours."""
    rows, cols, n = a + b, a + c, a + b + c + d
    span = np.arange(max(0, rows + cols - n), min(rows, cols) + 1, dtype=float)
    k = span[:-1]
    return span, np.concatenate([[0.0], np.cumsum(np.log((cols - k) * (rows - k)) - np.log((k + 1) * (n - rows - cols + k + 1)))])


def fisher_exact(a: int, b: int, c: int, d: int, level: float = 0.95) -> dict[str, float | None]:
    """2x2 table (a b / c d): two-sided p, conditional odds ratio and its exact interval."""
    span, logs = _hypergeometric(a, b, c, d)
    weights = np.exp(logs - logs.max())
    p = weights[logs <= logs[int(a - span[0])] + 1e-7].sum() / weights.sum()

    def tilted(log_odds):
        shifted = logs + span * log_odds
        w = np.exp(shifted - shifted.max())
        return w / w.sum()

    mean = lambda t: float(span @ tilted(t))
    upper_tail = lambda t: float(tilted(t)[span >= a].sum())
    lower_tail = lambda t: float(tilted(t)[span <= a].sum())
    tail = (1 - level) / 2
    at_low, at_high = a == span[0], a == span[-1]
    estimate = 0.0 if at_low else math.inf if at_high else math.exp(solve(lambda t: mean(t) - a, -40, 40, 80))
    low = 0.0 if at_low else math.exp(solve(lambda t: upper_tail(t) - tail, -40, 40, 80))
    high = math.inf if at_high else math.exp(solve(lambda t: lower_tail(t) - tail, -40, 40, 80))
    return {"odds_ratio": estimate, "lower": low, "upper": high, "p_value": min(1.0, float(p))}


def boschloo(a: int, b: int, c: int, d: int, grid: int = 64) -> float:
    """Two-sided p-value of Boschloo's test: Fisher's one-sided p as the statistic, its chance at the worst common risk; twice the smaller side."""
    n1, n2 = a + b, c + d
    if (n1 + 1) * (n2 + 1) > 4_000_000:
        raise ValueError("too many tables for the unconditional test")
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n1 + n2 + 1)))])
    choose = lambda n, k: lf[n] - lf[k] - lf[n - k]
    x, y = np.arange(n1 + 1), np.arange(n2 + 1)
    fisher = np.ones((2, n1 + 1, n2 + 1))
    for total in range(n1 + n2 + 1):
        k = np.arange(max(0, total - n2), min(n1, total) + 1)
        w = np.exp(choose(n1, k) + choose(n2, total - k) - choose(n1 + n2, total))
        fisher[0, k, total - k], fisher[1, k, total - k] = np.cumsum(w), np.cumsum(w[::-1])[::-1]
    logs = choose(n1, x)[:, None] + choose(n2, y)[None]
    successes = x[:, None] + y[None]

    def side(stat):
        extreme = stat <= stat[a, c] * (1 + 1e-9)
        chance = lambda r: float(np.exp(logs[extreme] + successes[extreme] * math.log(r) + (n1 + n2 - successes[extreme]) * math.log1p(-r)).sum())
        risks = np.linspace(0, 1, grid + 2)[1:-1]
        best = int(np.argmax([chance(r) for r in risks]))
        low, high = (best / (grid + 1), (best + 2) / (grid + 1))
        for _ in range(40):
            third = (high - low) / 3
            low, high = (low + third, high) if chance(low + third) < chance(high - third) else (low, high - third)
        return chance((low + high) / 2)

    return min(1.0, 2 * min(side(fisher[0]), side(fisher[1])))
