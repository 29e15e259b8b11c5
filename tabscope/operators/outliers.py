"""Univariate outliers by the interquartile range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabscope.functions.bounded import local_table, stacked_aggregates
from tabscope.operators.columns import as_double, long_cells, long_numbers
from tabscope.operators.forest import isolation_summary
from tabscope.operators.quantiles import quantile_values

# Reach of the whiskers and the smallest column that is judged.
IQR_REACH = 1.5
MIN_VALUES = 4


def iqr_bounds(df: DataFrame, columns: Sequence[str], method: str = "nearest") -> dict[str, tuple[float, float]]:
    """Lower and upper bound of every column with at least 4 values."""
    row = df.agg(*[F.count(as_double(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    counts = {c: row[i] for i, c in enumerate(columns) if row[i] >= MIN_VALUES}
    values = quantile_values(df, {c: [(0.25, method), (0.75, method)] for c in counts}, counts)
    bounds = {}
    for c in counts:
        q1, q3 = values[c, 0.25, method], values[c, 0.75, method]
        bounds[c] = (q1 - IQR_REACH * (q3 - q1), q3 + IQR_REACH * (q3 - q1))
    return bounds


def iqr_outliers(df: DataFrame, columns: Sequence[str], method: str = "nearest") -> DataFrame:
    """(column, count, pct, lower, upper): values strictly outside the bounds.

    Columns with fewer than 4 values have count 0 and no bounds. Counting is one pass of
    global aggregates, since bounds are two numbers per column.
    """
    bounds = iqr_bounds(df, columns, method)
    empty = local_table(
        df.sparkSession, [(c, 0, None, None, None) for c in columns if c not in bounds], OUTLIER_SCHEMA
    )
    if not bounds:
        return empty
    counts = stacked_aggregates(
        df,
        {
            c: {
                "count": F.count_if((as_double(c) < low) | (as_double(c) > high)),
                "known": F.count(as_double(c)),
                "lower": F.lit(low),
                "upper": F.lit(high),
            }
            for c, (low, high) in bounds.items()
        },
    )
    return counts.select(
        "column", "count", F.round(F.col("count") / F.col("known") * 100, 2).alias("pct"),
        F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"),
    ).unionByName(empty)


OUTLIER_SCHEMA = "column string, count long, pct double, lower double, upper double"


def iqr_outlier_rows(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], method: str = "nearest"
) -> DataFrame:
    """(key..., column, value): every value outside its column's bounds, with its row's key."""
    bounds = iqr_bounds(df, columns, method)
    if not bounds:
        return long_numbers(df, columns, keep=key).where(F.lit(False))
    cells = {
        c: F.when((as_double(c) < low) | (as_double(c) > high), as_double(c)) for c, (low, high) in bounds.items()
    }
    return long_cells(df, cells, keep=key)


def univariate_report(df: DataFrame, columns: Sequence[str], method: str = "nearest") -> DataFrame:
    """``iqr_outliers`` of the columns that have any."""
    return iqr_outliers(df, columns, method).where(F.col("count") > 0)


def all_outliers(df: DataFrame, columns: Sequence[str], key: Sequence[str], method: str = "nearest") -> DataFrame:
    """(kind, column, count): outliers of each column that has any, and of the columns together."""
    single = univariate_report(df, columns, method).select(F.lit("iqr").alias("kind"), "column", "count")
    together = isolation_summary(df, columns, key).select(
        F.lit("isolation_forest").alias("kind"), F.lit(",".join(columns)).alias("column"), "count"
    )
    return single.unionByName(together)
