"""Normal and chi-square tail functions as column expressions, which stay in the JVM; normal quantiles of arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# W. J. Cody, "Rational Chebyshev approximations for the error function",
# Math. Comp. 23 (1969). Highest power first.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
           3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
           2.84423683343917062e3)
ERFC_MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
                6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
                1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
                1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
                3.43936767414372164e3, 1.23033935480374942e3)
ERFC_TAIL_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
                 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_TAIL_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
                 6.05183413124413191e-2, 2.33520497626869185e-3)

# M. J. Wichura, "Algorithm AS 241: the percentage points of the normal
# distribution", Applied Statistics 37 (1988). Numerator and denominator, highest power first.
CENTRAL = (
    (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
     1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
    (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
     5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0),
)
TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
     3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0),
)
FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _polynomial(coefficients: tuple, x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def _erf_near_zero(x: Column) -> Column:
    square = x * x
    return x * _polynomial(ERF_NUM, square) / _polynomial(ERF_DEN, square)


def _scaled_erfc(x: Column) -> Column:
    """exp(x^2) * erfc(x) for x > 0.46875."""
    middle = _polynomial(ERFC_MID_NUM, x) / _polynomial(ERFC_MID_DEN, x)
    inverse = F.lit(1.0) / (x * x)
    correction = inverse * _polynomial(ERFC_TAIL_NUM, inverse) / _polynomial(ERFC_TAIL_DEN, inverse)
    tail = (F.lit(1.0 / math.sqrt(math.pi)) - correction) / x
    return F.when(x <= 4.0, middle).otherwise(tail)


def erfc(x: Column) -> Column:
    magnitude = F.abs(x)
    upper = F.exp(-x * x) * _scaled_erfc(magnitude)
    return (
        F.when(magnitude <= 0.46875, F.lit(1.0) - _erf_near_zero(x))
        .when(x > 0, upper)
        .otherwise(F.lit(2.0) - upper)
    )


def log_upper_tail(z: Column) -> Column:
    """ln P(Z > z) of a standard normal, accurate far out in either tail."""
    x = z / F.lit(math.sqrt(2.0))
    far = F.log(_scaled_erfc(F.abs(x)) / 2.0) - x * x
    return F.when(x > 0.46875, far).otherwise(F.log(erfc(x) / 2.0))


def log_lower_tail(z: Column) -> Column:
    """ln P(Z < z) of a standard normal."""
    return log_upper_tail(-z)


def chi_square_upper_tail(statistic: Column, dof: Column) -> Column:
    """P(X > statistic) for a whole number of degrees of freedom.

    Closed form: a finite series in statistic/2, started by exp for even and erfc for odd
    degrees. It is meant for result rows (one per pair of columns).
    """
    half = statistic / 2.0
    odd = (dof % 2) == 1
    # term j is half^(j+s) * exp(-half) / gamma(j+s+1), with s = 0 (even) or 1/2 (odd)
    first = F.when(odd, 2.0 * F.sqrt(half / math.pi) * F.exp(-half)).otherwise(F.exp(-half))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    n_terms = F.when(odd, (dof - 1) / 2).otherwise(dof / 2).cast("int")
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def add(state: Column, j: Column) -> Column:
        total = state["total"] + state["term"]
        return F.struct(
            (state["term"] * half / (j.cast("double") + shift)).alias("term"), total.alias("total")
        )

    series = F.when(
        n_terms > 0,
        F.aggregate(F.sequence(F.lit(1), F.greatest(n_terms, F.lit(1))), start, add, lambda s: s["total"]),
    ).otherwise(F.lit(0.0))
    base = F.when(odd, erfc(F.sqrt(half))).otherwise(F.lit(0.0))
    return F.when(statistic <= 0, F.lit(1.0)).otherwise(F.least(base + series, F.lit(1.0)))


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """The z with P(Z < z) = p, for 0 < p < 1, of each element."""
    q = p - 0.5
    z = np.empty_like(q)
    centre = np.abs(q) <= 0.425
    z[centre] = q[centre] * _ratios(CENTRAL, 0.180625 - q[centre] ** 2)
    outer = ~centre
    root = np.sqrt(-np.log(np.minimum(p[outer], 1.0 - p[outer])))
    z[outer] = np.sign(q[outer]) * np.where(root <= 5.0, _ratios(TAIL, root - 1.6), _ratios(FAR_TAIL, root - 5.0))
    return z


def _ratios(pair: tuple, x: np.ndarray) -> np.ndarray:
    return np.polyval(pair[0], x) / np.polyval(pair[1], x)
