"""Tail probabilities for one-row test results.

Only report-sized numbers get here: a z value, an F value, a pair of sample sizes. The passes
over the data that produce them are Spark jobs.
"""

from __future__ import annotations

import math
from functools import lru_cache

_TINY = 1e-300
_EPS = 1e-15


def normal_two_sided(z: float) -> float:
    """P(|Z| >= z), at most 1."""
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        step = a
        while abs(term) > abs(total) * _EPS:
            step += 1.0
            term *= x / step
            total += term
        return 1.0 - total * scale
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, 10_000):
        numerator = -i * (i - a)
        b += 2.0
        d = 1.0 / (numerator * d + b or _TINY)
        c = b + numerator / c or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return value * scale


def chi2_tail(x: float, dof: int) -> float:
    """P(X >= x) for a chi-square variable."""
    return 1.0 if dof == 0 else _gamma_upper(dof / 2.0, x / 2.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for numerator in (even, odd):
            d = 1.0 / (1.0 + numerator * d or _TINY)
            c = 1.0 + numerator / c or _TINY
            value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return value


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return beta_regularised(dof / 2.0, 0.5, dof / (dof + t * t))


def t_quantile(level: float, dof: float) -> float:
    """Half-width multiplier of a two-sided interval with the given confidence level."""
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, dof) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def f_tail(f: float, numerator_dof: float, denominator_dof: float) -> float:
    """P(F >= f)."""
    if f <= 0.0:
        return 1.0
    x = denominator_dof / (denominator_dof + numerator_dof * f)
    return beta_regularised(denominator_dof / 2.0, numerator_dof / 2.0, x)


SMALL_GROUP = 8

# Cells of the exact test of two larger groups: a fixed bound of time and memory.
MOST_CELLS = 100_000


@lru_cache
def _partitions_within(m: int):
    """A function N -> partitions of all integers up to N into parts of at most ``m``.

    The generating function 1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^m)) over a common denominator
    (1 - q^L)^(m + 1) has a numerator of fixed length, so N may be of any size.
    """
    parts = [1, *range(1, m + 1)]
    period = math.lcm(*parts)
    top = [1]
    for part in parts:
        longer = [0] * (len(top) + period - part)
        for shift in range(0, period, part):
            for i, ways in enumerate(top):
                longer[i + shift] += ways
        top = longer
    k = len(parts)

    def count(n: int) -> int:
        if n < 0:
            return 0
        return sum(
            top[r] * math.comb((n - r) // period + k - 1, k - 1)
            for r in range(n % period, min(n + 1, len(top)), period)
        )

    return count


def rank_sum_exact_two_sided(u: float, n1: int, n2: int) -> float:
    """Exact two-sided p-value of the Mann-Whitney U statistic without ties.

    Arrangements with a U of at most t are the partitions that fit into an n1 x n2 box. With a
    group of at most eight rows they are counted in time and memory that do not depend on the
    other group. Two larger groups are counted in a table of n1 * n2 integers; where that has more
    than ``MOST_CELLS``, the count raises instead of taking what memory the groups ask for.
    """
    small, large = sorted((n1, n2))
    tail = n1 * n2 - math.ceil(max(u, n1 * n2 - u))
    if small > SMALL_GROUP:
        if small * large > MOST_CELLS:
            raise ValueError(
                f"the exact test of {n1} against {n2} rows is too large; set method='asymptotic'"
            )
        ways = [1] + [0] * (small * large)
        for i in range(1, small + 1):
            for value in range(len(ways) - 1, large + i - 1, -1):
                ways[value] -= ways[value - large - i]
            for value in range(i, len(ways)):
                ways[value] += ways[value - i]
        below = sum(ways[: tail + 1])
    else:
        count = _partitions_within(small)
        # Parts longer than the box are taken out by inclusion and exclusion.
        shifts = {0: 1}
        for i in range(1, small + 1):
            for shift, sign in list(shifts.items()):
                shifts[shift + large + i] = shifts.get(shift + large + i, 0) - sign
        below = sum(sign * count(tail - shift) for shift, sign in shifts.items())
    return min(1.0, 2 * below / math.comb(n1 + n2, small))


def rank_sum_p_value(
    u1: float, n1: int, n2: int, tie_term: float, method: str = "auto"
) -> tuple[float | None, float | None, str]:
    """z, two-sided p-value and the method used for one Mann-Whitney test.

    ``exact`` counts arrangements and raises if there are ties, ``asymptotic`` is the normal
    approximation with tie and continuity correction, and ``auto`` is exact if a group has at most
    eight rows and there are no ties.
    """
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown method {method!r}")
    if n1 == 0 or n2 == 0:
        return None, None, "empty group"
    if method == "exact" and tie_term:
        raise ValueError("the exact test needs values without ties; set method='asymptotic'")
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1))) if n > 1 else 0.0
    gap = max(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5
    z = gap / math.sqrt(variance) if variance > 0.0 else None
    if method == "exact" or method == "auto" and min(n1, n2) <= SMALL_GROUP and not tie_term:
        return z, rank_sum_exact_two_sided(u1, n1, n2), "exact"
    return z, None if z is None else normal_two_sided(z), "asymptotic"
