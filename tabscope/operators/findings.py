"""Data-quality findings and the quality score, by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FINDING = ("title", "severity", "description", "affected_columns", "recommendation")

# The limits of the rules.
MANY_MISSING, SOME_MISSING = 50, 10
MANY_DUPLICATES = 100
MANY_OUTLIERS = 5
MAX_DUPLICATE_PENALTY = 20
OUTLIER_COLUMN_PENALTY, MAX_OUTLIER_PENALTY = 3, 15
GOOD_SCORE, FAIR_SCORE = 70, 40


def _finding(title: Column, severity: Column, description: Column, columns: Column, recommendation: Column):
    return [value.alias(name) for name, value in zip(FINDING, (title, severity, description, columns, recommendation))]


# The titles, descriptions and recommendations of the findings below.

def missing_findings(profile: DataFrame) -> DataFrame:
    """Columns with more than 10% or 50% missing values."""
    many = F.col("null_pct") > MANY_MISSING
    pct = F.col("null_pct").cast("string")
    return profile.where(F.col("null_pct") > SOME_MISSING).select(*_finding(
        F.concat(
            F.when(many, "High missing rate in '").otherwise("Notable missing values in '"),
            F.col("column"), F.lit("'"),
        ),
        F.when(many, "high").otherwise("medium"),
        F.concat(pct, F.when(many, "% of values are missing.").otherwise("% missing.")),
        F.array("column"),
        F.when(many, "Consider dropping or imputing this column.")
        .otherwise("Investigate why data is missing. Impute if appropriate."),
    ))


def pii_findings(profile: DataFrame) -> DataFrame:
    """Columns flagged for personal data."""
    return profile.where(F.size("pii_flags") > 0).select(*_finding(
        F.concat(F.lit("Potential PII in '"), F.col("column"), F.lit("'")),
        F.lit("high"),
        F.concat(F.lit("Detected patterns: "), F.array_join("pii_flags", ", ")),
        F.array("column"),
        F.lit("Review and mask/remove PII before sharing."),
    ))


def duplicate_findings(duplicates: DataFrame) -> DataFrame:
    """At most one finding, from the one-row duplicate count."""
    n = F.col("duplicate_rows")
    return duplicates.where(n > 0).select(*_finding(
        F.lit("Duplicate rows detected"),
        F.when(n < MANY_DUPLICATES, "medium").otherwise("high"),
        F.format_string("%d duplicate rows found.", n),
        F.array().cast("array<string>"),
        F.lit("Review and deduplicate if not intentional."),
    ))


def outlier_findings(outliers: DataFrame) -> DataFrame:
    """Columns with more than 5% of values outside the interquartile bounds."""
    return outliers.where(F.col("pct") > MANY_OUTLIERS).select(*_finding(
        F.concat(F.lit("High outlier rate in '"), F.col("column"), F.lit("'")),
        F.lit("medium"),
        F.concat(
            F.col("count").cast("string"), F.lit(" outliers ("), F.col("pct").cast("string"),
            F.lit("%) outside IQR bounds."),
        ),
        F.array("column"),
        F.lit("Check if these are data entry errors or genuine extreme values."),
    ))


def findings_report(profile: DataFrame, duplicates: DataFrame, outliers: DataFrame) -> DataFrame:
    """All findings of a table."""
    return (
        missing_findings(profile)
        .unionByName(pii_findings(profile))
        .unionByName(duplicate_findings(duplicates))
        .unionByName(outlier_findings(outliers))
    )


def score_band(score: Column) -> Column:
    return F.when(score >= GOOD_SCORE, "high").when(score >= FAIR_SCORE, "mid").otherwise("low")


def quality_score(dataset: DataFrame, outliers: DataFrame) -> DataFrame:
    """(quality_score, band) from the one-row table profile and the outlier table.

    Completeness, less a penalty for duplicates and one for columns with outliers.
    """
    counted = outliers.agg(F.count_if(F.col("count") > 0).alias("outlier_columns"))
    joined = dataset.withColumn("one_", F.lit(1)).join(counted.withColumn("one_", F.lit(1)), "one_")
    rate = F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 100
    score = F.greatest(
        F.lit(0.0),
        F.col("completeness_pct") - F.least(rate, F.lit(float(MAX_DUPLICATE_PENALTY)))
        - F.least(F.col("outlier_columns") * OUTLIER_COLUMN_PENALTY, F.lit(MAX_OUTLIER_PENALTY)),
    )
    rounded = F.bround(score).cast("int")
    return joined.select(rounded.alias("quality_score"), score_band(rounded).alias("band"))
