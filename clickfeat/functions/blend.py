"""Blending model scores that stand side by side in one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _any_zero(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) == 0 for c in cols])


def mean(cols: Sequence[str]) -> Column:
    return _total([F.col(c) for c in cols]) / F.lit(len(cols))


def geometric(cols: Sequence[str]) -> Column:
    """Zero as soon as one score is zero."""
    logs = _total([F.log(F.col(c)) for c in cols]) / F.lit(len(cols))
    return F.when(_any_zero(cols), 0.0).otherwise(F.exp(logs))


def harmonic(cols: Sequence[str], true_form: bool = False) -> Column:
    """``1 / sum(1/p)``; the true harmonic mean is k times that."""
    inverse = _total([F.lit(1.0) / F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    scale = float(len(cols)) if true_form else 1.0
    return F.when(_any_zero(cols), 0.0).otherwise(F.lit(scale) / inverse)


def final(cols: Sequence[str], divide_by: int | None = None) -> Column:
    """Sum of the three means over the number of models, or over ``divide_by``."""
    total = mean(cols) + harmonic(cols) + geometric(cols)
    return total / F.lit(float(divide_by or len(cols)))


def weighted(weights: Mapping[str, float]) -> Column:
    """Weighted mean over the scores that are there; null if none is."""
    sums = [F.when(F.col(c).isNotNull(), F.col(c) * F.lit(w)).otherwise(0.0) for c, w in weights.items()]
    used = [F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()]
    return _total(sums) / F.nullif(_total(used), F.lit(0.0))
