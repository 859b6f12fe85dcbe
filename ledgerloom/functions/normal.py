"""Normal-distribution helpers: quantiles are driver constants, tail areas are column arithmetic."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to here the series of the central area is used, beyond it the continued fraction of the tail; terms of either.
JOINT, TERMS, FRACTIONS = 3.0, 60, 120
#: From here on a double holds no tail area.
VANISHED = 38.6


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_z(alpha: float) -> float:
    return quantile(1 - alpha / 2)


def _density(size: Column) -> Column:
    return F.exp(-0.5 * size * size) / math.sqrt(2 * math.pi)


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)), to about 14 digits; NULL and NaN give NULL.

    Up to ``JOINT`` the central area is the density times z + z^3/3 + z^5/15 + .., whose terms are all positive; beyond it the
    tail is the density over z + 1/(z + 2/(z + 3/..)).
    """
    size = F.abs(z)
    first = F.struct(size.alias("term"), size.alias("sum"))
    near = F.aggregate(
        F.array(*[F.lit(2.0 * k + 1) for k in range(1, TERMS)]), first,
        lambda a, odd: F.struct((a["term"] * size * size / odd).alias("term"), (a["sum"] + a["term"] * size * size / odd).alias("sum")), lambda a: a["sum"])
    far = F.aggregate(F.array(*[F.lit(float(k)) for k in range(FRACTIONS, 0, -1)]), size, lambda a, k: size + k / a)
    area = F.when(size <= JOINT, 1 - 2 * _density(size) * near).when(size < VANISHED, 2 * _density(size) / far).otherwise(0.0)
    return F.when(F.isnan(z) | z.isNull(), None).otherwise(area)


def log10_two_sided_p(z: Column) -> Column:
    """log10 of the two-sided p-value; beyond |z| = 8 an asymptotic tail series keeps it finite."""
    size = F.abs(z)
    inverse_square = 1 / (size * size)
    tail_series = 1 - inverse_square + 3 * F.pow(inverse_square, 2) - 15 * F.pow(inverse_square, 3)
    log_density = -0.5 * size * size - 0.5 * math.log(2 * math.pi)
    far = (math.log(2.0) + log_density - F.log(size) + F.log(tail_series)) / math.log(10.0)
    return F.when(size >= 8, far).otherwise(F.log10(two_sided_p(z)))
