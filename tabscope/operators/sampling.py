"""Bounded random samples, chosen by hash so that they do not depend on the partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.bounded import column_ref

HASH_RANGE = float(2**32)


def draw(key: Sequence[str], seed: int, *salt: Column) -> Column:
    """A number in [0, 1) for a row: fixed by its key, or seeded per partition without one."""
    if not key:
        return F.rand(seed)
    mixed = F.xxhash64(F.lit(seed), *salt, *[column_ref(c) for c in key])
    return F.pmod(mixed, F.lit(2**32)) / F.lit(HASH_RANGE)


def generous_share(size: int, total: Column) -> Column:
    """A share of ``total`` rows that holds at least ``size`` of them, short of a 1e-20 chance."""
    return F.lit(size + 10 * math.sqrt(size) + 30) / F.greatest(total, F.lit(1))


def sample(df: DataFrame, size: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``size`` random rows: the ones whose key and seed have the smallest MD5.

    Every task keeps its own ``size`` smallest. ``key`` must identify a row.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *[column_ref(c).cast("string") for c in key]))
    return df.withColumn("draw_", mark).orderBy("draw_", *[column_ref(c) for c in key]).limit(size).drop("draw_")
