"""Upper tails of the Poisson and binomial distributions as column expressions, without Python.

A tail is its largest term times a sum of ratios. The sum is taken on the side where the terms fall: from n on if n is above the
mean, else below n, as one minus the rest. J terms away from a mean m, the terms have fallen by at least exp(-J*J / (2*m + J)),
so terms(m) of them leave less than 1e-16 of the sum, whatever the mean. The work for a cell grows as the square root of
its mean; cells without an event have the tail 1 at no cost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n!, exact to double precision: a table below 20, Stirling's series above."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)]), F.least(n, F.lit(19)).cast("int") + 1)
    x = (n + 1).cast("double")
    large = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 20, small).otherwise(large)


def terms(mean: Column) -> Column:
    return (F.lit(60) + 12 * F.sqrt(F.greatest(mean, F.lit(1.0)))).cast("int")


def _sum(count: Column, ratio) -> Column:
    """1 + r(1) + r(1) r(2) + ..., count factors."""
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, k: Column) -> Column:
        t = a["t"] * ratio(k)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    return F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["s"])


def poisson_tail(n: Column, mean: Column) -> Column:
    """P(X >= n) of a Poisson distribution; null where an argument is null."""
    n, mean = n.cast("bigint"), mean.cast("double")

    def term(k: Column) -> Column:
        return F.exp(k * F.ln(mean) - mean - log_factorial(k))

    above = term(n) * _sum(terms(mean), lambda j: mean / (n + j))
    below = 1 - term(n - 1) * _sum(F.least(n - 1, terms(mean)).cast("int"), lambda j: (n - j) / mean)
    return F.when(n.isNull() | mean.isNull(), None).when(n <= 0, 1.0).when(n >= mean, F.least(above, F.lit(1.0))).otherwise(F.greatest(below, F.lit(0.0)))


def binomial_tail(n: Column, total: Column, p: Column) -> Column:
    """P(X >= n) of a binomial distribution; null where an argument is null."""
    n, total, p = n.cast("bigint"), total.cast("bigint"), p.cast("double")
    mean, odds = total * p, p / (1 - p)

    def term(k: Column) -> Column:
        return F.exp(log_factorial(total) - log_factorial(k) - log_factorial(total - k) + k * F.ln(p) + (total - k) * F.log1p(-p))

    above = term(n) * _sum(F.least(total - n, terms(mean)).cast("int"), lambda j: (total - n - j + 1) / (n + j) * odds)
    below = 1 - term(n - 1) * _sum(F.least(n - 1, terms(mean)).cast("int"), lambda j: (n - j) / (total - n + j + 1) / odds)
    return F.when(n.isNull() | total.isNull() | p.isNull(), None).when(n <= 0, 1.0).when((n > total) | (p <= 0), 0.0).when(p >= 1, 1.0).when(n >= mean, F.least(above, F.lit(1.0))).otherwise(F.greatest(below, F.lit(0.0)))
