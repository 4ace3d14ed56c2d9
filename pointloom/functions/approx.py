"""Approximate arithmetic as column expressions: only sums and products of the inputs.

Iterations are folds over a state inside one expression, so their size does not grow
with the steps (unrolled, each step would repeat the one before it several times); long
polynomial chains go through ``polynomial_chain``, an Arrow-batched function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _repeat(state: Column, steps: int, step: Callable[[Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    return F.aggregate(F.array_repeat(F.lit(0), steps), state, lambda s, _: step(s), finish)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))


def inverse(x: Column, depth: int = 6) -> Column:
    """1/x for 0 < x < 2: the product of 1 + (1 - x)^(2^k)."""
    return _repeat(_pair(2 - x, 1 - x), depth, lambda s: _pair(s.a * (1 + s.b * s.b), s.b * s.b), lambda s: s.a)


def scaled_inverse(x: Column, m: float, depth: int = 6) -> Column:
    """m/(2x) for 0 < x < m."""
    return inverse(x * F.lit(2.0 / m), depth)


def square_root(x: Column, depth: int = 6) -> Column:
    """sqrt(x) for 0 <= x <= 1."""
    return _repeat(_pair(x, x - 1), depth, lambda s: _pair(s.a * (1 - s.b / 2), s.b * s.b * ((s.b - 3) / 4)), lambda s: s.a)


def minimum(a: Column, b: Column, depth: int = 6) -> Column:
    half = (a - b) / 2
    return (a + b) / 2 - square_root(half * half, depth)


def maximum(a: Column, b: Column, depth: int = 6) -> Column:
    half = (a - b) / 2
    return (a + b) / 2 + square_root(half * half, depth)


def compare(a: Column, b: Column, rounds: int = 4, power: int = 4, depth: int = 5) -> Column:
    """Towards 1 where a > b, 0 where a < b, one half where equal; for a, b in [1/2, 3/2)."""
    start = a / 2 * inverse((a + b) / 2, depth)
    square = lambda v: _repeat(v, int(math.log2(power)), lambda t: t * t)

    def step(x: Column) -> Column:
        both = _pair(square(x), square(1 - x))
        return _repeat(both, 1, lambda s: _pair(s.a * inverse(s.a + s.b, depth), s.b), lambda s: s.a)

    return _repeat(start, rounds, step)


def argmax_one_hot(values: Column, rounds: int = 4, power: int = 2) -> Column:
    """An array's values over their sum, raised and scaled again and again: near 1 at the largest."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    share = lambda v: F.transform(v, lambda x: x / total(v))
    return _repeat(share(values), rounds, lambda v: share(F.transform(v, lambda x: F.pow(x, F.lit(float(power))))))


def cubic_sign(x: Column, steps: int = 5) -> Column:
    """1.5 x - 0.5 x^3, repeated: towards the sign of x in [-1, 1]."""
    return _repeat(x.cast("double"), steps, lambda v: v * 1.5 - v * v * v * 0.5)


def steps_to_lift(least: float, target: float = 0.9) -> int:
    """Steps of factor 1.5 that lift ``least`` to the target."""
    return max(0, math.ceil(math.log(target / least) / math.log(1.5))) if least < target else 0


def steps_for(n: float) -> int:
    """Steps for values of at least 1/n."""
    return math.ceil(math.log(n) / math.log(1.5)) + 1


def sharp_sign(x: Column, least: float, polish: int = 3) -> Column:
    return cubic_sign(x, steps_to_lift(least) + polish)


def step_function(x: Column, least: float = 1e-2, polish: int = 3) -> Column:
    """(1 + sign)/2: towards 1 above 0, 0 below, one half at 0."""
    return (sharp_sign(x, least, polish) + 1) / 2


def hard_mask(x: Column, steps: int = 8) -> Column:
    """A noisy 0/1 value made clean: the step at one half."""
    return F.round((cubic_sign(x * 2 - 1, steps) + 1) / 2)


def maximum_by_sign(u: Column, v: Column, steps: int = 12) -> Column:
    return u + (v - u) * (1 + cubic_sign(v - u, steps)) / 2


def clean_bit(x: Column, steps: int = 1) -> Column:
    """3 x^2 - 2 x^3, repeated: values near 0 and 1 come nearer."""
    return _repeat(x.cast("double"), steps, lambda v: v * v * (3 - 2 * v))


def clean_sign(x: Column, steps: int = 1) -> Column:
    return cubic_sign(x, steps)


def odd_polynomial(x: Column, coefficients: list[float]) -> Column:
    """The sum of c_k x^(2k+1), by Horner's rule in x^2."""
    square, out = x * x, F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * square + F.lit(float(c))
    return out * x


def odd_chebyshev(x: Column, coefficients: list[float], bound: float = 1.0) -> Column:
    """The sum of c_k T_(2k+1)(x / bound), by Clenshaw's recurrence for odd degrees."""
    x = x / F.lit(float(bound))
    turn = 2 * (2 * x * x - 1)  # T_(n+2) = 2 T_2 T_n - T_(n-2)
    terms = F.array(*[F.lit(float(c)) for c in reversed(coefficients)])
    return x * F.aggregate(terms, _pair(F.lit(0.0), F.lit(0.0)), lambda s, c: _pair(c + turn * s.a - s.b, s.a), lambda s: s.a - s.b)


def odd_chebyshev_values(x: np.ndarray, coefficients: list[float], bound: float = 1.0) -> np.ndarray:
    full = np.zeros(2 * len(coefficients))
    full[1::2] = coefficients
    return np.polynomial.chebyshev.chebval(np.asarray(x, float) / bound, full)


def polynomial_chain(components: list[dict], basis: str | None = None):
    """A function of a column that applies the components one after the other, in Arrow batches."""
    chain = [(c["coeffs"], float(c.get("domain_b", 1.0)), basis or c.get("basis", "chebyshev")) for c in components]

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        for coefficients, bound, kind in chain:
            if kind == "chebyshev":
                v = odd_chebyshev_values(v, coefficients, bound)
            else:
                v = v * np.polynomial.polynomial.polyval(v * v, coefficients)
        return pd.Series(v)

    return apply


def exact_compare(a: Column, b: Column) -> Column:
    return F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)


def exact_argmax(values: Column) -> Column:
    return F.transform(values, lambda v: F.when(v == F.array_max(values), 1.0).otherwise(0.0))


def precision(n: int, use: str) -> int:
    """Bits of precision for n points: of the neighbour test, the core test and the propagation."""
    bits = {"neighbour": (math.log2(n), 8, 15, 20), "core": (math.log2(2 * n), 2, 8, 16), "propagation": (math.log2(1.1 * n), 1, 8, 16)}
    log, add, low, high = bits[use]
    return min(high, max(low, math.ceil(log) + add))
