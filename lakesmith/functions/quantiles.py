"""Exact order statistics of a whole column, from the rank index of
:mod:`ranks`: Spark's exact ``percentile`` would merge all distinct values
into one buffer. Nulls and NaN are ignored, as in pandas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import group_quantiles, quantiles_of, rank_quantiles_of, ranked_values


def kth_values(df: DataFrame, col: str, ks: Sequence[int]) -> dict[int, float]:
    """Exact k-th smallest (0-based) values of ``col``; ranks out of range
    are left out."""
    def place(k: int):
        return lambda size: F.lit(k).cast("long")
    wanted = {str(k): place(k) for k in sorted(set(ks)) if k >= 0}
    size, found = ranked_values(df, [col], wanted)[col]
    return {int(k): v for k, v in zip(wanted, found, strict=True) if int(k) < size}


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles of one column."""
    return quantiles_of(df, [col], probs)[col]


def rank_quantiles(df: DataFrame, col: str, fractions: Sequence[tuple[int, int]]) -> list[float | None]:
    """Quantiles by rank ``sorted[n * num // den]`` (no interpolation)."""
    return rank_quantiles_of(df, [col], fractions)[col][1]


def grouped_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                      names: Sequence[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles per group; a group of any size is split
    over partitions by value."""
    return group_quantiles(df, keys, col, probs, names or [f"q{i}" for i in range(len(probs))])
