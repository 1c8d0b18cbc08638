"""Vector arithmetic on array columns, and the normal quantile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")
        )
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Unit-length copy; a zero vector is returned unchanged."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda v: v.cast("double") / length)).otherwise(
        F.transform(a, lambda v: v.cast("double"))
    )


# Coefficients of the rational approximation of the normal quantile
# published by Wichura (1988), algorithm AS 241, low order first.
CENTRE_NUM = (
    3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427,
    13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
    33430.575583588128105, 2509.0809287301226727,
)
CENTRE_DEN = (
    1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
    21213.794301586595867, 39307.895800092710610, 28729.085735721942674,
    5226.4952788528545610,
)
TAIL_NUM = (
    1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
    3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770,
    0.0227238449892691845833, 0.000774545014278341407640,
)
TAIL_DEN = (
    1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
    0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600,
    1.05075007164441684324e-9,
)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[-1])
    for coefficient in reversed(coefficients[:-1]):
        value = value * x + F.lit(coefficient)
    return value


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for probabilities above 1e-11.

    Native arithmetic, so no lookup table has to be shipped and pool sizes are not bounded.
    """
    q = p - 0.5
    centre_r = F.lit(0.180625) - q * q
    centre = q * _poly(centre_r, CENTRE_NUM) / _poly(centre_r, CENTRE_DEN)
    tail_r = F.sqrt(-F.ln(F.least(p, 1 - p))) - 1.6
    tail = _poly(tail_r, TAIL_NUM) / _poly(tail_r, TAIL_DEN)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)


def expected_order_statistic(k: Column, n: Column) -> Column:
    """Blom's expectation for the k-th largest of n standard normal draws."""
    return normal_quantile((n - k + 0.625) / (n + 0.25))
