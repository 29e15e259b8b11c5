"""The texts that sum up an analysis for a reader or a language model, one row per line.

Each takes the small result tables (a row per column, pair or finding) and returns (part, place, text): lines in
the order of part and place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.text import number_text


def _part(number: int, rows: DataFrame, place: Column | int, text: Column | str) -> DataFrame:
    place = F.lit(place) if isinstance(place, int) else place
    text = F.lit(text) if isinstance(text, str) else text
    return rows.select(F.lit(number).alias("part"), place.cast("int").alias("place"), text.alias("text"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _some(rows: DataFrame) -> DataFrame:
    """One row if there are any."""
    return rows.agg(F.count(F.lit(1)).alias("n_")).where("n_ > 0")


def _numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """A small result table with its rows numbered."""
    return rows.withColumn("n_", F.row_number().over(Window.orderBy(*order)))


# The wording of the lines below.

def quality_context(columns: DataFrame, dataset: DataFrame, outliers: DataFrame, multivariate: DataFrame) -> DataFrame:
    """Shape, completeness, a line for each column, and the outliers."""
    facts = [
        F.format_string("Dataset: %d rows, %d columns", "rows", "columns"),
        F.concat(F.lit("Completeness: "), F.col("completeness_pct").cast("string"), F.lit("%")),
        F.format_string("Duplicate rows: %d", "duplicate_rows"),
    ]
    described = F.concat(
        F.lit("- "), F.col("column"), F.lit(" ("), F.col("detected_type"), F.lit("): "),
        F.col("null_pct").cast("string"), F.lit("% null, "), F.col("n_unique").cast("string"), F.lit(" unique"),
        F.when(F.size("pii_flags") > 0, F.concat(F.lit(" [PII: "), F.array_join("pii_flags", ", "), F.lit("]"))).otherwise(""),
        F.when(
            F.col("mean").isNotNull(),
            F.concat(F.lit(", mean="), number_text(F.col("mean")), F.lit(", std="),
                     F.coalesce(number_text(F.col("std")), F.lit("None"))),
        ).otherwise(""),
    )
    extreme = F.concat(
        F.lit("- "), F.col("column"), F.lit(": "), F.col("count").cast("string"), F.lit(" outliers ("),
        F.col("pct").cast("string"), F.lit("%)"),
    )
    together = F.concat(
        F.lit("Multivariate outliers (Isolation Forest): "), F.col("count").cast("string"), F.lit(" ("),
        F.col("pct").cast("string"), F.lit("%)"),
    )
    return _all([
        *(_part(1, dataset, i, text) for i, text in enumerate(facts)),
        _part(2, columns, F.col("position"), described),
        _part(3, _some(outliers), 0, "Outliers (IQR method):"),
        _part(3, _numbered(outliers, "column"), F.col("n_"), extreme),
        _part(4, multivariate.where("count > 0"), 0, together),
    ])


def report_context(
    dataset: DataFrame, findings: DataFrame, score: DataFrame, takeaways: DataFrame, interpretations: DataFrame,
    correlations: DataFrame, timeseries: DataFrame | None = None,
) -> DataFrame:
    """Overview, findings, takeaways, test results, correlations and time series under their headings."""
    overview = [
        F.lit("DATASET OVERVIEW"), F.format_string("Rows: %d, Columns: %d", "rows", "columns"),
        F.concat(F.lit("Completeness: "), F.col("completeness_pct").cast("string"), F.lit("%")),
        F.format_string("Duplicate rows: %d", "duplicate_rows"),
        F.concat(F.lit("Type breakdown: "), F.concat_ws(", ", *(
            F.concat(F.lit(f"{kind}: "), F.col(f"{kind}_columns").cast("string"))
            for kind in ("numeric", "categorical", "datetime", "text")
        ))),
    ]
    finding = F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit(": "), F.col("description"))
    detail = F.concat(
        F.lit("- "), F.col("test_name"), F.lit(" on "), F.array_join("columns", ", "), F.lit(": "), F.col("result_summary")
    )
    related = F.concat(
        F.lit("- "), F.col("col1"), F.lit(" <-> "), F.col("col2"), F.lit(": r="), number_text(F.col("correlation"))
    )
    listed = [
        ("DATA QUALITY FINDINGS", _numbered(findings, "title"), finding),
        ("STATISTICAL TAKEAWAYS", _numbered(takeaways, "place"), F.concat(F.lit("- "), F.col("takeaway"))),
        ("STATISTICAL DETAILS", _numbered(interpretations, "test_name", F.array_join("columns", ",")), detail),
        ("HIGH CORRELATIONS", _numbered(correlations, F.abs("correlation").desc(), "col1", "col2"), related),
    ]
    if timeseries is not None:
        pattern = F.concat(
            F.lit("- "), F.col("column"), F.lit(": trend="), F.col("direction"), F.lit(", seasonal="),
            F.when(F.col("detected"), "yes").otherwise("no"),
        )
        listed.append(("TIME SERIES PATTERNS", _numbered(timeseries, "column"), pattern))
    parts = [_part(1, dataset, i, text) for i, text in enumerate(overview)]
    for number, (heading, rows, text) in enumerate(listed, 2):
        parts += [_part(number, _some(rows), 0, heading), _part(number, rows, F.col("n_"), text)]
    score_line = F.concat(F.lit("Quality score: "), F.col("quality_score").cast("string"), F.lit("/100"))
    parts.append(_part(len(listed) + 2, score, 0, score_line))
    return _all(parts)


def _sections(listed: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Numbered rows under their headings; a section without rows has no heading."""
    parts = []
    for number, (heading, rows, text) in enumerate(listed, 1):
        parts += [_part(number, _some(rows), 0, heading), _part(number, rows, F.col("n_"), text)]
    return _all(parts)


def tests_context(normality: DataFrame, chi_square: DataFrame, correlations: DataFrame) -> DataFrame:
    """The statistical results to be interpreted: normality, independence of pairs, high correlations.

    Pairs that could not be tested are left out.
    """
    normal = F.concat(
        F.lit("  "), F.col("column"), F.lit(": p="), number_text(F.col("p_value")),
        F.when(F.col("is_normal"), " (normal), skew=").otherwise(" (not normal), skew="), number_text(F.col("skewness")),
    )
    related = F.concat(
        F.lit("  "), F.col("col1"), F.lit(" vs "), F.col("col2"), F.lit(": p="), number_text(F.col("p_value")),
        F.when(F.col("significant"), " (significant)").otherwise(" (not significant)"),
    )
    correlated = F.concat(
        F.lit("  "), F.col("col1"), F.lit(" <-> "), F.col("col2"), F.lit(": r="), number_text(F.col("correlation"))
    )
    return _sections([
        ("Normality Tests (Shapiro-Wilk):", _numbered(normality, "column"), normal),
        ("Chi-Square Independence Tests:", _numbered(chi_square.where("significant is not null"), "col1", "col2"), related),
        ("High Correlations:", _numbered(correlations, F.abs("correlation").desc(), "col1", "col2"), correlated),
    ])


#: Correlated pairs that a chart plan is told of.
CHART_PAIRS = 5


def chart_context(columns: DataFrame, correlations: DataFrame, k: int = CHART_PAIRS) -> DataFrame:
    """What there is to draw: every column with its class, the ``k`` highest correlations, the time columns."""
    described = F.concat(
        F.lit("  "), F.col("column"), F.lit(": "), F.col("detected_type"), F.lit(", "),
        F.col("n_unique").cast("string"), F.lit(" unique, "), F.col("null_pct").cast("string"), F.lit("% null"),
    )
    correlated = F.concat(
        F.lit("  "), F.col("col1"), F.lit(" <-> "), F.col("col2"), F.lit(": "), number_text(F.col("correlation"))
    )
    highest = _numbered(correlations, F.abs("correlation").desc(), "col1", "col2").where(F.col("n_") <= k)
    times = columns.where("detected_type = 'datetime'").agg(
        F.array_sort(F.collect_list(F.struct("position", "column"))).getField("column").alias("times_")
    ).where("size(times_) > 0")
    listed = F.concat(F.lit("Time columns: "), F.array_join("times_", ", "))
    return _sections([
        ("Columns:", _numbered(columns, "position"), described), ("High correlations:", highest, correlated),
    ]).unionByName(_part(3, times, 0, listed))
