"""Trend and seasonality of numeric columns in the order of a time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscope.functions.bounded import column_ref, pin, small_rows, stacked_aggregates
from tabscope.functions.text import strip
from tabscope.operators.columns import as_double
from tabscope.operators.ordering import in_row_order

# Limits of the analysis.
MIN_ROWS = 20
MIN_TREND_ROWS = 5
MAX_LAG = 50
PEAK = 0.3
STEADY = 0.001
MAX_MISSING_DATES = 0.3

# Date formats in the order they are tried.
DATE_FORMATS = (
    "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd",
)

TREND_FIELDS = ("direction", "slope", "normalized_slope")


def time_columns(types: DataFrame) -> DataFrame:
    """(column, is_primary): the datetime columns; the first in table order is primary."""
    times = pin(types.where(F.col("detected_type") == "datetime").select("position", "column"))
    first = min((row["position"] for row in small_rows(times)), default=None)
    return times.select("column", (F.col("position") == F.lit(first)).alias("is_primary"))


def _parsed(text: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def choose_date_format(df: DataFrame, column: str) -> str | None:
    """The first format that leaves less than 30% of all rows unparsed."""
    return choose_date_formats(df, [column])[column]


def choose_date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """The same for several columns, in one pass."""
    row = df.agg(*[
        F.avg(_parsed(column_ref(c), fmt).isNull().cast("double")).alias(f"f{k}_{i}")
        for k, c in enumerate(columns) for i, fmt in enumerate(DATE_FORMATS)
    ]).first()
    return {
        c: next((
            fmt for i, fmt in enumerate(DATE_FORMATS)
            if row[f"f{k}_{i}"] is not None and row[f"f{k}_{i}"] < MAX_MISSING_DATES
        ), None)
        for k, c in enumerate(columns)
    }


def parse_dates(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Turn a text column into dates by the first fitting format; unchanged if none fits."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return df if into is None else df.withColumn(into, column_ref(column))
    fmt = choose_date_format(df, column) if isinstance(kind, T.StringType) else None
    if fmt is None:
        return df
    return df.withColumn(into or column, _parsed(column_ref(column), fmt))


def parse_all_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn text columns into dates, each by its first fitting format; one pass finds the formats of all of them."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    formats = choose_date_formats(df, texts) if texts else {}
    return df.withColumns({c: _parsed(column_ref(c), fmt) for c, fmt in formats.items() if fmt is not None})


def series_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, known, mean, variance) of each column's values, nulls left out; NaN counts in ``n`` only. A row for each."""
    def known(c: str) -> Column:
        return F.when(~F.isnan(as_double(c)), as_double(c))

    return pin(stacked_aggregates(df, {
        c: {
            "n": F.count(as_double(c)), "known": F.count(known(c)), "mean": F.avg(known(c)), "variance": F.var_pop(known(c)),
        } for c in columns
    }).drop("position"))


def series_in_order(df: DataFrame, moments: DataFrame, order_by: Sequence[str], max_lag: int = 0) -> DataFrame:
    """The moments of each series with its slope, and its sums of products (``totals``, ``pairs``) up to ``max_lag``.

    One pass over the table in order serves the trend and all lags; the result has a row for each column.
    """
    means = {r["column"]: r["mean"] if r["mean"] is not None else 0.0 for r in small_rows(moments.where("n > 0"))}
    if not means:
        return moments.where("false").withColumns({
            "slope": F.lit(0.0), "totals": F.array().cast("array<double>"), "pairs": F.array().cast("array<long>"),
        })
    return pin(moments.join(in_row_order(df, means, order_by, max_lag), "column"))


def trend_of(moments: DataFrame) -> DataFrame:
    """(column, direction, slope, normalized_slope) from the moments and slope of each series."""
    relative = F.when(F.col("mean") != 0, F.col("slope") / F.abs("mean")).otherwise(F.col("slope"))
    enough = (F.col("n") >= MIN_TREND_ROWS) & (F.col("known") >= MIN_TREND_ROWS)
    return moments.select(
        "column",
        F.when(~enough, "none")
        .when(relative > STEADY, "increasing")
        .when(relative < -STEADY, "decreasing")
        .otherwise("stable").alias("direction"),
        F.when(enough, F.round("slope", 6)).otherwise(F.lit(0.0)).alias("slope"),
        F.when(enough, F.round(relative, 6)).alias("normalized_slope"),
    )


def trend(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Least-squares trend of each column against its position in time order."""
    return trend_of(series_in_order(df, series_moments(df, columns), order_by))


def lag_limit(n: Column, max_lag: int = MAX_LAG) -> Column:
    """The largest lag to test: a quarter of a short series."""
    return F.when(n < 2 * max_lag, F.floor(n / 4)).otherwise(F.lit(max_lag)).cast("int")


def autocorrelation_of(series: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """(column, lag, autocorrelation) for lags 1 to ``max_lag``, from ``series_in_order``."""
    limit = lag_limit(F.col("n"), max_lag)
    by_lag = series.where(F.col("variance") > 0).select(
        "column", "n", "variance", F.posexplode(F.arrays_zip("totals", "pairs")).alias("place", "sums")
    ).withColumn("lag", F.col("place") + 1)
    return by_lag.where((F.col("sums.pairs") > 0) & (limit >= 2) & (F.col("lag") <= limit)).select(
        "column", "lag", (F.col("sums.totals") / F.col("sums.pairs") / F.col("variance")).alias("autocorrelation")
    )


def autocorrelation(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], max_lag: int = MAX_LAG) -> DataFrame:
    """(column, lag, autocorrelation) of each column in time order.

    Range partitions stream by in time order: each forms the products of its own neighbours, and the first and last
    ``max_lag`` values of a partition supply those across partitions.
    """
    return autocorrelation_of(series_in_order(df, series_moments(df, columns), order_by, max_lag), max_lag)


def seasonality_of(correlations: DataFrame) -> DataFrame:
    """(column, period, strength) of the columns with a peak above 0.3.

    A peak is larger than both neighbours; the strongest after rounding wins, the shortest
    lag on a tie. The input has at most ``max_lag`` rows per column.
    """
    order = Window.partitionBy("column").orderBy("lag")
    here = F.col("autocorrelation")
    peaks = (
        correlations.withColumn("previous", F.lag("autocorrelation").over(order))
        .withColumn("next", F.lead("autocorrelation").over(order))
        .where((here > F.col("previous")) & (here > F.col("next")) & (here > PEAK))
        .withColumn("strength", F.round(here, 4))
    )
    best = F.max(F.struct("strength", (-F.col("lag")).alias("minus_lag")))
    return peaks.groupBy("column").agg(best.alias("best")).select(
        "column", (-F.col("best.minus_lag")).alias("period"), F.col("best.strength").alias("strength")
    )


def seasonality(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                max_lag: int = MAX_LAG) -> DataFrame:
    """(column, detected, period, strength) of each column."""
    from tabscope.functions.bounded import local_table

    names = local_table(df.sparkSession, [(c,) for c in columns], "column string")
    found = seasonality_of(autocorrelation(df, columns, order_by, max_lag))
    return names.join(found, "column", "left").select(
        "column", F.col("period").isNotNull().alias("detected"), "period", "strength"
    )


def timeseries_report(
    df: DataFrame,
    numeric: Sequence[str],
    time_column: str,
    tie_break: Sequence[str] = (),
    max_columns: int | None = None,
) -> DataFrame:
    """(column, time_column, direction, slope, normalized_slope, detected, period, strength).

    For all numeric columns (or the first ``max_columns``) that have at least 20 values, in the order
    of the time column; ``tie_break`` names columns that order rows with equal times.
    """
    chosen = list(numeric[:max_columns])
    if not chosen:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)
    moments = series_moments(df, chosen).where(F.col("n") >= MIN_ROWS)
    series = series_in_order(df, moments, [time_column, *tie_break], MAX_LAG)
    peaks = seasonality_of(autocorrelation_of(series))
    return (
        trend_of(series)
        .join(peaks, "column", "left")
        .select(
            "column", F.lit(time_column).alias("time_column"), *TREND_FIELDS,
            F.col("period").isNotNull().alias("detected"), "period", "strength",
        )
    )


REPORT_SCHEMA = (
    "column string, time_column string, direction string, slope double, normalized_slope double, "
    "detected boolean, period int, strength double"
)
