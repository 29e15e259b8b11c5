"""The whole analysis of one table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.bounded import column_ref, local_table, pin, small_rows
from tabscope.operators import (
    association,
    charts,
    documents,
    findings,
    forest,
    frequency,
    inference,
    outliers,
    profile,
    series,
)
from tabscope.sources import require_rows

NO_SERIES = "note string"


def analyze(
    df: DataFrame,
    key: Sequence[str] = (),
    options: profile.Options = profile.Options(),
    dataset_id: str = "dataset",
    file_name: str = "unknown",
) -> dict[str, DataFrame]:
    """Every analysis of a table as a dictionary of result tables.

    ``key`` names columns that identify a row. It orders rows with equal times and fixes the
    random draws of the isolation forest, so results do not depend on the partitions.

    The column classes are computed first, since they decide what else is done. Results with a
    row per column or per pair are pinned, so that findings, statistics, plan and report read
    them instead of scanning again; row-level results stay lazy.
    """
    require_rows(df)
    summary = profile.summarize(df, options)
    columns = pin(profile.profile_columns(df, options, summary))
    numeric, categorical, times = (
        profile.columns_of_class(summary, c) for c in (profile.NUMERIC, profile.CATEGORICAL, profile.DATETIME)
    )
    duplicates = pin(frequency.duplicate_rows(df))
    dataset = pin(profile.dataset_profile_of(summary, duplicates))
    extreme = pin(outliers.univariate_report(df, numeric, options.quantile_method)) if numeric else local_table(
        df.sparkSession, [], outliers.OUTLIER_SCHEMA
    )
    matrix = association.correlations(df, numeric) if len(numeric) > 1 else None
    correlations = pin(association.high_correlations(df, numeric, found=matrix))
    pairs = list(combinations(categorical, 2))
    cells = pin(association.pair_statistics(df, pairs), max(1, len(pairs))) if pairs else None
    associations = pin(association.categorical_associations(df, categorical, stats=cells))
    normality = _tests_of(df, numeric)
    chi_square = pin(inference.chi_square_tests(df, categorical, stats=cells))
    distributions = (
        pin(inference.distribution_tests(df, numeric)) if numeric
        else local_table(df.sparkSession, [], _ANDERSON_SCHEMA)
    )
    takeaways = pin(inference.takeaways(normality, chi_square))
    found = pin(findings.findings_report(columns, duplicates, extreme))
    score = pin(findings.quality_score(dataset, extreme))
    results = {
        "columns": columns,
        "dataset": dataset,
        "outliers": extreme,
        "multivariate_outliers": forest.isolation_summary(df, numeric, key),
        "correlation_matrix": association.pearson_matrix(df, numeric, found=matrix),
        "correlations": correlations,
        "associations": associations,
        "timeseries": _series_of(df, numeric, times, key, dataset),
        "findings": found,
        "quality_score": score,
        "normality": normality,
        "chi_square": chi_square,
        "distributions": distributions,
        "interpretations": inference.interpretations(normality, chi_square),
        "takeaways": takeaways,
        "statistics": inference.statistics_report(normality, chi_square, distributions, correlations),
        "chart_plan": charts.chart_plan(summary, correlations),
        "summary_documents": documents.summary_documents(
            dataset_id, columns, dataset, _first_rows(df, key), file_name
        ),
        "report": documents.report_lines(dataset, score, found, takeaways, correlations),
    }
    return results


_ANDERSON_SCHEMA = (
    "column string, test string, statistic double, critical_15pct double, critical_10pct double, "
    "critical_5pct double, critical_2_5pct double, critical_1pct double, likely_normal boolean"
)

def _tests_of(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    if not numeric:
        return local_table(df.sparkSession, [], inference.NORMALITY_SCHEMA)
    return inference.normality_tests(df, numeric)


def _first_rows(df: DataFrame, key: Sequence[str]) -> DataFrame | None:
    """The first rows in key order, numbered; none without a key, since rows have no order."""
    if not key:
        return None
    # ten rows at most: the number of their place is taken from their sorted list
    rows = pin(df.orderBy(*[column_ref(c) for c in key]).limit(documents.SAMPLE_ROWS))
    ordered = F.array_sort(F.collect_list(F.struct(*[column_ref(c) for c in key], F.struct("*").alias("row_"))))
    return rows.agg(ordered.alias("rows_")).select(F.posexplode("rows_").alias("place", "entry_")).select(
        "place", "entry_.row_.*"
    )


def _series_of(
    df: DataFrame, numeric: Sequence[str], times: Sequence[str], key: Sequence[str], dataset: DataFrame
) -> DataFrame:
    """The time series report; a note instead where there is too little to analyze."""
    spark = df.sparkSession
    if not times:
        return local_table(spark, [("no time columns",)], NO_SERIES)
    if small_rows(dataset)[0]["rows"] < series.MIN_ROWS:
        return local_table(spark, [("too few rows for meaningful analysis",)], NO_SERIES)
    primary = times[0]
    dated = series.parse_dates(df, primary) if isinstance(df.schema[primary].dataType, T.StringType) else df
    return series.timeseries_report(dated, numeric, primary, [k for k in key if k != primary])
