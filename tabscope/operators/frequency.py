"""Counting: value frequencies, distinct values, nulls, completeness and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscope.functions.bounded import column_ref, stacked_aggregates
from tabscope.operators.columns import as_text, column_name, long_values, rendered

VALUE_SLOTS = ("v_long", "v_double", "v_text")


def frequency_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_no, v_long, v_double, v_text, count) for every distinct value of every column.

    Null is a value. One scan and one shuffle for all columns; counts are combined before the
    shuffle, so a value that fills a third of the table travels as one row per task.
    """
    columns = list(columns or df.columns)
    return long_values(df, columns).groupBy("column_no", *VALUE_SLOTS).count()


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) with the value as text and null kept as null."""
    columns = list(columns or df.columns)
    freq = frequency_table(df, columns)
    return freq.select(column_name(columns).alias("column"), rendered(df, columns).alias("value"), "count")


def n_unique(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_unique): exact number of distinct values, null counted as one of them."""
    columns = list(columns or df.columns)
    counted = frequency_table(df, columns).groupBy("column_no").agg(F.count(F.lit(1)).alias("n_unique"))
    return counted.select(column_name(columns).alias("column"), "n_unique")


def approximate_n_unique(df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """The cheap alternative to ``n_unique``: a sketch per column in a single pass."""
    columns = list(columns or df.columns)
    return stacked_aggregates(
        df,
        {
            c: {
                "n_unique": F.approx_count_distinct(column_ref(c), rsd)
                + F.max(column_ref(c).isNull().cast("long"))
            }
            for c in columns
        },
    ).drop("position")


def top_of(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column; ties by value ascending, null last.

    The rank limit is applied inside every task before the shuffle, so a column's last sort
    sees ``k`` rows per task however many distinct values it has.
    """
    order = Window.partitionBy("column_no").orderBy(
        F.desc("count"), *[F.col(slot).asc_nulls_last() for slot in VALUE_SLOTS]
    )
    return freq.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, rank, value, count): the most frequent values, null shown as ``None``."""
    columns = list(columns or df.columns)
    top = top_of(frequency_table(df, columns), k)
    return top.select(
        column_name(columns).alias("column"), "rank", F.coalesce(rendered(df, columns), F.lit("None")).alias("value"), "count"
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, total_count, null_count, null_pct)."""
    columns = list(columns or df.columns)
    counts = stacked_aggregates(
        df,
        {
            c: {
                "total_count": F.count(F.lit(1)),
                "null_count": F.count_if(column_ref(c).isNull()),
            }
            for c in columns
        },
    )
    return counts.select("column", "total_count", "null_count", null_pct().alias("null_pct"))


def null_pct():
    return F.round(F.col("null_count") / F.greatest(F.col("total_count"), F.lit(1)) * 100, 2)


def completeness_of(counts: DataFrame) -> DataFrame:
    """Shape, total nulls and completeness of a (column, total_count, null_count) table."""
    sums = counts.agg(
        F.max("total_count").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("null_count").alias("total_nulls"),
    )
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    return sums.withColumn("completeness_pct", F.round((1 - F.col("total_nulls") / cells) * 100, 2))


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, columns, total_nulls, completeness_pct."""
    return completeness_of(null_counts(df))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows without repeats; nulls are equal to each other."""
    return df.distinct()


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row. Nulls are equal to each other, as are 0.0 and -0.0."""
    values = []
    for i, field in enumerate(df.schema.fields):
        value = column_ref(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0).cast(field.dataType)
        elif isinstance(field.dataType, T.MapType):
            value = as_text(df, field.name)
        values.append(value.alias(f"k{i}"))
    return F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one.

    A row is shuffled as its digest. Copies are counted before the shuffle, so a row repeated
    over a third of the table is one digest per task when it reaches its group.
    """
    groups = df.select(row_digest(df).alias("row_")).groupBy("row_").agg(F.count(F.lit(1)).alias("n_copies_"))
    repeats = F.coalesce(F.sum(F.col("n_copies_") - 1), F.lit(0))
    return groups.agg(repeats.alias("duplicate_rows"))
