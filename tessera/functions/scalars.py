"""Column builders: scalar transforms, text, activations, closed forms of distributions.

Every builder takes columns and gives a column, so all of them stay in generated code. Null in gives
null out unless stated.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The small terms that keep logarithms and denominators from zero.
LOG_EPS = EPS = 1e-10


def num(c: Column | str) -> Column:
    """Numeric reading of a column; text that is no number is null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def fill_null(c: Column, value: float) -> Column:
    return F.coalesce(c, F.lit(value))


def log_transform(c: Column) -> Column:
    return F.log(c + F.lit(LOG_EPS))


def sqrt_transform(c: Column) -> Column:
    return F.when(c.isNotNull(), F.sqrt(F.greatest(c, F.lit(0.0))))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def scaled(c: Column, center: Column, spread: Column) -> Column:
    """(c - center) / spread, a spread of zero counting as one."""
    return (c - center) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def unscaled(c: Column, center: Column, spread: Column) -> Column:
    return c * F.when(spread == 0, F.lit(1.0)).otherwise(spread) + center


def str_len(c: Column) -> Column:
    """Length in bytes."""
    return F.octet_length(c).cast("double")


def str_contains(c: Column, part: str) -> Column:
    return F.contains(c, F.lit(part)).cast("double")


def str_replace(c: Column, old: str, new: str) -> Column:
    """Every occurrence, left to right; an empty `old` changes nothing."""
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


ACTIVATIONS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "linear": (lambda x: x, lambda x: F.when(x.isNotNull(), F.lit(1.0))),
    "relu": (lambda x: F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0)), lambda x: (x > 0).cast("double")),
    "sigmoid": (lambda x: 1 / (1 + F.exp(-x)), lambda x: (1 / (1 + F.exp(-x))) * (1 - 1 / (1 + F.exp(-x)))),
    "tanh": (F.tanh, lambda x: 1 - F.tanh(x) * F.tanh(x)),
}


def activation(name: str) -> Callable[[Column], Column]:
    """Activation by name, in any case of letters; KeyError if unknown."""
    return ACTIVATIONS[name.lower()][0]


def activation_derivative(name: str) -> Callable[[Column], Column]:
    return ACTIVATIONS[name.lower()][1]


#: Coefficients of the published polynomial approximations (Abramowitz and Stegun 26.2.17, 26.2.23).
CDF_P, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
QUANTILE_C, QUANTILE_D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def polynomial(x: Column, factors: tuple[float, ...]) -> Column:
    """Horner form, the constant first."""
    out = F.lit(factors[-1])
    for f in reversed(factors[:-1]):
        out = out * x + F.lit(f)
    return out


def normal_pdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mu) / sigma
    return F.exp(z * z * -0.5) / (sigma * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mu) / sigma
    t = 1 / (1 + F.abs(z) * CDF_P)
    tail = normal_pdf(F.abs(z)) * t * polynomial(t, CDF_B)
    return F.when(z >= 0, 1 - tail).when(z.isNotNull(), tail)


def normal_quantile(p: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """Rational approximation; infinite at 0 and 1."""
    low = F.least(p, 1 - p)
    t = F.sqrt(F.log(low) * -2)
    z = t - polynomial(t, QUANTILE_C) / polynomial(t, (1.0, *QUANTILE_D))
    signed = F.when(p < 0.5, -z).otherwise(z)
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(signed * sigma + mu)


def t_cdf(t: Column, df: Column, steps: int = 1000, reach: float = 10.0) -> Column:
    """Trapezoids under the t kernel from -reach to t, over those to +reach; normal beyond 100 degrees."""
    kernel = lambda x: F.pow(1 + x * x / df, -(df + 1) / 2)

    def area(high: Column) -> Column:
        h = (high + reach) / steps
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda s, k: s + kernel(h * k - reach))
        return h * (inner + (kernel(F.lit(-reach)) + kernel(high)) / 2)

    held = F.greatest(F.lit(-reach), F.least(F.lit(reach), t))
    return F.when(df > 100, normal_cdf(t)).otherwise(area(held) / area(F.lit(reach)))


def chi2_upper(x: Column, df: Column) -> Column:
    """Upper tail by the cube-root normal approximation."""
    z = (F.pow(x / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return 1 - normal_cdf(z)
