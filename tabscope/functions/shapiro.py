"""The Shapiro-Wilk test (Royston 1995, algorithm AS R94) from sums over a column's ordered values."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from tabscope.functions.normal import normal_quantiles

# The polynomials of the published algorithm, lowest power first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_SHIFT = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _polynomial(coefficients: tuple, x: float) -> float:
    return sum(c * x**power for power, c in enumerate(coefficients))


def scores(ranks: np.ndarray, n: int) -> np.ndarray:
    """The normal scores of ranks from 1 to n; halves between them are fine."""
    return normal_quantiles((ranks - 0.375) / (n + 0.25))


#: Ranks at either end of a column whose scores are added one by one. Between them a sum of scores is an integral with
#: two correction terms; what they leave is under 3.3e-5 times the fifth derivative at the cut, so under 1e-10.
EDGE = 32


def score_sums(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """For each pair of ranks the sum of the scores from ``first`` to ``last``; no sum visits its ranks one by one."""
    edge = min(EDGE, n // 2)  # the middle rank of a short column of odd length has the score 0
    lowest = np.concatenate(([0.0], np.cumsum(scores(np.arange(1.0, edge + 1), n))))
    sums = lowest[np.minimum(last, edge)] - lowest[np.minimum(first - 1, edge)]
    # ranks count from the other end with the opposite sign
    sums -= lowest[np.minimum(n + 1 - first, edge)] - lowest[np.minimum(n - last, edge)]
    low, high = np.maximum(first, edge + 1), np.minimum(last, n - edge)
    one = low == high
    sums[one] += scores(low[one].astype(float), n)
    many = low < high
    sums[many] += _integral(low[many] - 0.5, n, -1) + _integral(high[many] + 0.5, n, 1)
    return sums


def _integral(place: np.ndarray, n: int, side: int) -> np.ndarray:
    """One end of the integral of the score with its two corrections."""
    z, size = scores(place, n), n + 0.25
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    slope = 1 / (size * density)
    return side * (-size * density - slope / 24 + 7 / 5760 * slope**3 * (1 + 2 * z * z))


def squared_scores(n: int, edge: int = 500) -> float:
    """The sum of the squared scores of all ranks, by the same rule."""
    normal, size = NormalDist(), n + 0.25

    def z(place: float) -> float:
        return normal.inv_cdf((place - 0.375) / size)

    if n <= 4 * edge:
        return math.fsum(z(rank) ** 2 for rank in range(1, n + 1))
    outer = 2 * math.fsum(z(rank) ** 2 for rank in range(1, edge + 1))
    low = z(edge + 0.5)  # the other end is its mirror image
    slope = 2 * low / (size * normal.pdf(low))
    inner = size * (1 - 2 * normal.cdf(low) + 2 * low * normal.pdf(low))
    return outer + inner + 2 * slope / 24


def statistic(n: int, inner: float, squares: float, outermost: float, next_to_it: float, spread: float) -> float:
    """W of a column of 8 values or more.

    ``inner`` is the sum of score times value for all ranks but the two at either end, ``squares``
    that of all squared scores, ``outermost`` the largest value minus the smallest, ``next_to_it``
    the second largest minus the second smallest, ``spread`` the sum of squared deviations.
    """
    if math.isnan(spread):
        return math.nan
    if outermost == 0 or spread == 0:
        return 1.0
    top, below = (NormalDist().inv_cdf((rank - 0.375) / (n + 0.25)) for rank in (n, n - 1))
    u = 1.0 / math.sqrt(n)
    last = top / math.sqrt(squares) + _polynomial(LAST_WEIGHT, u)
    second = below / math.sqrt(squares) + _polynomial(SECOND_WEIGHT, u)
    scale = (squares - 2 * top**2 - 2 * below**2) / (1 - 2 * last**2 - 2 * second**2)
    weighted = inner / math.sqrt(scale) + last * outermost + second * next_to_it
    return min(1.0, weighted**2 / spread)


def p_value(w: float, n: int) -> float:
    """The chance of a W this small in a normal sample. The published curves were fitted up to n = 5,000."""
    if math.isnan(w) or w >= 1.0:
        return w
    y, log_n = math.log(1 - w), math.log(n)
    if n <= 11:
        bound = _polynomial(SMALL_SHIFT, n)
        if y >= bound:
            return 0.0
        y = -math.log(bound - y)
        mean, sd = _polynomial(SMALL_MEAN, n), math.exp(_polynomial(SMALL_LOG_SD, n))
    else:
        mean, sd = _polynomial(LARGE_MEAN, log_n), math.exp(_polynomial(LARGE_LOG_SD, log_n))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
