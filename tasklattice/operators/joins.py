"""Joins that stay even when a key is mostly absent or very common.

Adaptive execution splits a skewed partition only if both sides of the join come
straight from a shuffle. So where a side took joins or aggregates to find, it is
written out first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "_lookup_key"


def left_lookup(rows: DataFrame, extra: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on a key that is NULL in many rows.

    A plain join would shuffle all NULL keys to one task. Here such a row gets a
    key of its own, made from the column ``spread``, that nothing can match.
    A key that is common but not NULL is left to the adaptive skew join: the
    looked-up side has one row per key, so its partition can be split freely.
    """
    absent = F.concat(F.lit("\0"), F.col(spread).cast("string"))
    return (
        rows.withColumn(_KEY, F.coalesce(key, absent))
        .join(extra.withColumnRenamed(key, _KEY), _KEY, "left")
        .drop(_KEY)
    )
