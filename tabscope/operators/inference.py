"""Statistical tests: normality of numbers, independence of categories, and their wording."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions import shapiro
from tabscope.functions.bounded import local_table, pin, small_rows, stacked_aggregates
from tabscope.functions.normal import chi_square_upper_tail, log_lower_tail, log_upper_tail
from tabscope.functions.text import number_text
from tabscope.operators.association import pair_statistics
from tabscope.operators.columns import as_double
from tabscope.operators.ordering import ranked_values, split_points

# Sizes, levels and limits of the tests.
SHAPIRO_MIN = 8
ALPHA = 0.05
MAX_CHI_LEVELS = 20
MIN_CHI_ROWS = 10
MIN_ANDERSON_ROWS = 20

# Stephens (1974), mean and variance unknown, at 15, 10, 5, 2.5 and 1 %.
STEPHENS = {"15": 0.576, "10": 0.656, "5": 0.787, "2.5": 0.918, "1": 1.092}


def skew_kurtosis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, skewness, kurtosis): population skewness and excess kurtosis of all values."""
    return stacked_aggregates(
        df,
        {
            c: {
                "n": F.count(as_double(c)),
                "skewness": F.round(F.skewness(as_double(c)), 4),
                "kurtosis": F.round(F.kurtosis(as_double(c)), 4),
            }
            for c in columns
        },
    ).drop("position")


def normality_tests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk per column of 8 values or more: statistic, p_value, is_normal, and skewness and kurtosis.

    All values take part. W is a sum over the order of the values, and a value's ranks follow from
    the number of values below it, so the work follows the distinct values: the scores of a value's
    ranks are added in closed form. A constant column has W = 1.
    """
    shape = pin(stacked_aggregates(df, {
        c: {
            "n": F.count(as_double(c)), "mean": F.avg(as_double(c)),
            "spread": F.var_pop(as_double(c)) * F.count(as_double(c)),
            "skewness": F.round(F.skewness(as_double(c)), 4), "kurtosis": F.round(F.kurtosis(as_double(c)), 4),
        }
        for c in columns
    }).drop("position")).where(F.col("n") >= SHAPIRO_MIN)
    shapes = {r["column"]: r for r in small_rows(shape)}
    if not shapes:
        return local_table(df.sparkSession, [], NORMALITY_SCHEMA)
    sums = _weighted_sums(ranked_values(df, split_points(df, list(shapes))), {c: (r["n"], r["mean"]) for c, r in shapes.items()})
    results = []
    for s in small_rows(sums):  # a row for each column
        r = shapes[s["column"]]
        w = shapiro.statistic(r["n"], s["inner"], shapiro.squared_scores(r["n"]), s["outermost"], s["next_to_it"], r["spread"])
        p = shapiro.p_value(w, r["n"])
        results.append((s["column"], "shapiro_wilk", r["n"], w, p, p > ALPHA, r["skewness"], r["kurtosis"]))
    return local_table(df.sparkSession, results, NORMALITY_SCHEMA).withColumns({
        c: F.round(c, 6) for c in ("statistic", "p_value")
    })


def _weighted_sums(ranked: DataFrame, shapes: dict[str, tuple[int, float]]) -> DataFrame:
    """(column, inner, outermost, next_to_it): what W needs of the values in order, as deviations from the mean.

    Each task adds scores times values in Arrow batches, so a few rows a task are shuffled.
    """
    places = ("lowest", "second", "second_last", "highest")
    schema = ", ".join(["column string", "inner double", *(f"{p} double" for p in places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, rows = pa.Table.from_batches([batch]), []
            for column in pc.unique(table["column"]).to_pylist():
                own = table.filter(pc.equal(table["column"], column))
                n, mean = shapes[column]
                value = own["value"].to_numpy() - mean
                first = own["before"].to_numpy() + 1
                last = own["before"].to_numpy() + own["count"].to_numpy()
                a, b = np.maximum(first, 3), np.minimum(last, n - 2)  # the two at either end have weights of their own
                some = a <= b
                inner = float(shapiro.score_sums(a[some], b[some], n) @ value[some])
                at = [value[(first <= rank) & (rank <= last)] for rank in (1, 2, n - 1, n)]
                rows.append({"column": column, "inner": inner, **{p: float(v[0]) if len(v) else None for p, v in zip(places, at, strict=True)}})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("column", pa.string()), ("inner", pa.float64()), *((p, pa.float64()) for p in places)]))

    found = ranked.select("column", "value", "count", "before").mapInArrow(run, schema)
    return found.groupBy("column").agg(
        F.sum("inner").alias("inner"), (F.max("highest") - F.max("lowest")).alias("outermost"),
        (F.max("second_last") - F.max("second")).alias("next_to_it"),
    )


NORMALITY_SCHEMA = (
    "column string, test string, sample_size long, statistic double, p_value double, is_normal boolean, "
    "skewness double, kurtosis double"
)


def chi_square_tests(
    df: DataFrame,
    columns: Sequence[str],
    max_columns: int | None = None,
    max_levels: int = MAX_CHI_LEVELS,
    stats: DataFrame | None = None,
) -> DataFrame:
    """(col1, col2, test, statistic, p_value, dof, significant, skipped) for all pairs of columns.

    A pair is tested if it has 10 complete rows and 2 to 20 levels on either side; if not, the
    row says why in ``skipped``. With one degree of freedom the statistic carries the continuity
    correction. ``max_columns`` bounds the columns that are paired; ``stats`` are known ``pair_statistics``.
    """
    pairs = list(combinations(columns[:max_columns], 2))
    if not pairs:
        return local_table(df.sparkSession, [], CHI_SCHEMA)
    wanted = local_table(df.sparkSession, pairs, "col1 string, col2 string")
    stats = wanted.join(pair_statistics(df, pairs) if stats is None else stats, ["col1", "col2"], "left")
    skipped = (
        F.when(F.coalesce("n", F.lit(0)) < MIN_CHI_ROWS, "fewer than 10 complete rows")
        .when(F.least("levels1", "levels2") < 2, "a column has one value")
        .when(F.greatest("levels1", "levels2") > max_levels, "too many values")
    )
    dof = F.when(skipped.isNull(), (F.col("levels1") - 1) * (F.col("levels2") - 1))
    scored = stats.withColumns({"dof": dof.cast("int"), "skipped": skipped}).withColumn(
        "raw", F.when(F.col("dof") == 1, F.col("chi2_yates")).when(F.col("dof") > 1, F.col("chi2"))
    ).withColumn("tail", F.when(F.col("dof") >= 1, chi_square_upper_tail(F.col("raw"), F.col("dof"))))
    return scored.select(
        "col1", "col2", F.lit("chi_square").alias("test"),
        F.round("raw", 4).alias("statistic"), F.round("tail", 6).alias("p_value"),
        "dof", (F.col("tail") < ALPHA).alias("significant"), "skipped",
    )


CHI_SCHEMA = (
    "col1 string, col2 string, test string, statistic double, p_value double, dof int, significant boolean, "
    "skipped string"
)


def critical_values(n: Column) -> dict[str, Column]:
    """Anderson-Darling critical values for a sample size, by significance level in percent."""
    size = n.cast("double")
    correction = 1.0 + 4.0 / size - 25.0 / (size * size)
    return {level: F.round(F.lit(value) / correction, 3) for level, value in STEPHENS.items()}


def distribution_tests(df: DataFrame, columns: Sequence[str], max_columns: int | None = None) -> DataFrame:
    """Anderson-Darling normality on all rows of the columns that have 20 values and are not constant.

    Equal values share their ranks' weights, so the statistic is a sum over distinct values
    with the number of rows below each, which counts by bucket supply.
    """
    chosen = list(columns[:max_columns])
    shape = pin(stacked_aggregates(
        df,
        {
            c: {
                "n": F.count(as_double(c)), "mean": F.avg(as_double(c)), "sd": F.stddev_samp(as_double(c)),
            }
            for c in chosen
        },
    ).where((F.col("n") >= MIN_ANDERSON_ROWS) & (F.col("sd") > 0)).drop("position"))
    # where no column qualifies, any will do: the join leaves nothing
    tested = [r["column"] for r in small_rows(shape)] or chosen[:1]
    joined = ranked_values(df, split_points(df, tested)).join(shape, "column")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    c, before, n = F.col("count").cast("double"), F.col("before").cast("double"), F.col("n")
    term = c * (2 * before + c) * log_lower_tail(z) + c * (2 * n - 2 * before - c) * log_upper_tail(z)
    summed = joined.groupBy("column", "n").agg(F.sum(term).alias("weighted"))
    statistic = -F.col("n") - F.col("weighted") / F.col("n")
    limits = critical_values(F.col("n"))
    return summed.select(
        "column", F.lit("anderson_darling").alias("test"), F.round(statistic, 4).alias("statistic"),
        *[limit.alias(f"critical_{level.replace('.', '_')}pct") for level, limit in limits.items()],
        (statistic < limits["5"]).alias("likely_normal"),
    )


def interpretations(normality: DataFrame, chi_square: DataFrame) -> DataFrame:
    """(test_name, columns, result_summary, significance, practical_meaning) of both tests."""
    normal = F.col("is_normal")
    shapiro = normality.select(
        F.lit("Shapiro-Wilk normality").alias("test_name"),
        F.array("column").alias("columns"),
        F.concat(
            F.when(normal, "Appears normally distributed").otherwise("Not normally distributed"),
            F.lit(" (p="), number_text(F.col("p_value")), F.lit("). Skewness: "),
            number_text(F.col("skewness")), F.lit("."),
        ).alias("result_summary"),
        F.when(normal, "not_significant").otherwise("significant").alias("significance"),
        F.when(normal, "Parametric tests are appropriate.")
        .otherwise("Consider non-parametric methods or transformations.").alias("practical_meaning"),
    )
    related = F.col("significant")
    # The sentences of an interpretation
    chi = chi_square.where(related.isNotNull()).select(
        F.lit("Chi-square independence").alias("test_name"),
        F.array("col1", "col2").alias("columns"),
        F.concat(
            F.when(related, "Statistically significant").otherwise("No significant"),
            F.lit(" relationship found (p="), number_text(F.col("p_value")), F.lit(")."),
        ).alias("result_summary"),
        F.when(related, "significant").otherwise("not_significant").alias("significance"),
        F.when(related, "These variables appear to be related.")
        .otherwise("No evidence of association between these variables.").alias("practical_meaning"),
    )
    return shapiro.unionByName(chi)


def takeaways(normality: DataFrame, chi_square: DataFrame) -> DataFrame:
    """(place, takeaway): one line per kind of test that was run."""
    normal = normality.agg(
        F.count_if("is_normal").alias("hits"), F.count(F.lit(1)).alias("tests")
    ).where(F.col("tests") > 0).select(
        F.lit(1).alias("place"),
        F.format_string("%d/%d numeric columns follow a normal distribution.", "hits", "tests").alias("takeaway"),
    )
    related = chi_square.where(F.col("significant").isNotNull()).agg(
        F.count_if("significant").alias("hits"), F.count(F.lit(1)).alias("tests")
    ).where(F.col("tests") > 0).select(
        F.lit(2).alias("place"),
        F.format_string("%d significant categorical relationships found.", "hits").alias("takeaway"),
    )
    return normal.unionByName(related)


def statistics_report(
    normality: DataFrame, chi_square: DataFrame, distributions: DataFrame, correlations: DataFrame
) -> DataFrame:
    """(test, columns, statistic, p_value, verdict): all test results in one table."""
    none = F.lit(None).cast("double")
    return (
        normality.select(
            "test", F.array("column").alias("columns"), "statistic", "p_value",
            F.when(F.col("is_normal"), "normal").otherwise("not normal").alias("verdict"),
        )
        .unionByName(chi_square.where(F.col("significant").isNotNull()).select(
            "test", F.array("col1", "col2").alias("columns"), "statistic", "p_value",
            F.when(F.col("significant"), "significant").otherwise("not significant").alias("verdict"),
        ))
        .unionByName(distributions.select(
            "test", F.array("column").alias("columns"), "statistic", none.alias("p_value"),
            F.when(F.col("likely_normal"), "likely normal").otherwise("not normal").alias("verdict"),
        ))
        .unionByName(correlations.select(
            F.lit("pearson").alias("test"), F.array("col1", "col2").alias("columns"),
            F.col("correlation").alias("statistic"), none.alias("p_value"),
            F.lit("high correlation").alias("verdict"),
        ))
    )
