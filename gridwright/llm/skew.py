"""Joins that keep hot keys out of any single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 10_000


def join_counted(many: DataFrame, one: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row per key and the key's row count in ``many``.

    A key is hot if it has over ``total / MOST_HOT`` rows (1,000 at least), so at
    most ``MOST_HOT`` keys are: their rows of ``one`` are broadcast, with that
    proven bound, and the hot rows of ``many`` stay where they are.  All other
    keys meet in a shuffled join.
    """
    at = max(1_000, total // MOST_HOT)
    hot = one.where(F.col(count_col) > at)
    cold = one.where(F.col(count_col) <= at)
    here = many.join(F.broadcast(hot), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return here.unionByName(rest)
