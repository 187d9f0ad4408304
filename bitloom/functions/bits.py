"""Scalar functions on code lengths and parameters, in bits, as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(x: Column) -> Column:
    """Base-2 logarithm that gives -Infinity for 0 instead of null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log2(x))


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def logadd(a: Column, b: Column) -> Column:
    """Code length of either of two events with code lengths a and b; Infinity is an impossible event."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high == float("inf"), low).otherwise(low - F.log2(1 + exp2(low - high)))


def logstar_discrete(n: Column) -> Column:
    """Bits of a self-delimiting integer code: 1 plus the floors of repeated logarithms, for n up to 2**31."""
    total, x = F.lit(1).cast("long"), n.cast("double")
    out = total
    for _ in range(5):
        x = F.when(x >= 2, F.floor(F.log2(x)).cast("double")).otherwise(F.lit(0.0))
        out = out + x.cast("long")
    return out


def logstar(x: Column) -> Column:
    """Universal prior for positive numbers: log2 of the normalising constant plus repeated positive logarithms."""
    out, y = F.lit(math.log2(2.865)), x.cast("double")
    for _ in range(6):
        y = F.when(y > 1, F.log2(y)).otherwise(F.lit(0.0))
        out = out + y
    return out


def mml_cost(probs: list[Column], n: Column) -> Column:
    """Message-length cost of multinomial parameters.

    The information term runs from the first probability over the inner ones only, so with two
    probabilities the sample size has no effect.
    """
    inner = reduce(lambda x, p: x * n / p, probs[1:-1], F.lit(1.0))
    free = len(probs) - 1
    volume = math.factorial(free) ** 2 * 12.0**free
    return 0.5 * F.log2(1 + inner / probs[0] / volume) + 0.5 * free * math.log2(math.e)


def factorial(n: Column) -> Column:
    """n! as a double, for any n of 0 or more."""
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, x: a * x)


def start_position(n: Column) -> Column:
    """Bits of a starting place among n + 1."""
    return F.log2(n + 1)


def align_position(len_a: Column, len_b: Column) -> Column:
    """Bits of where a local alignment lies in two sequences."""
    return 2 * F.log2(F.least(len_a, len_b)) - 1 + F.log2(F.greatest(len_a, len_b))


def round_half_even(x: Column, digits: int = 2) -> Column:
    return F.bround(x, digits)


def round_away(x: Column, per_unit: int) -> Column:
    """x rounded to 1 / per_unit, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * per_unit + 0.5) / per_unit


def gap_costs(costs: list[Column]) -> list[Column]:
    """Costs shifted so that their probabilities sum to one."""
    total = sum((exp2(-c) for c in costs[1:]), exp2(-costs[0]))
    return [c + F.log2(total) for c in costs]
