"""Semantic column classes and the column and table profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.bounded import column_ref, local_table, pin, small_rows, stacked_aggregates
from tabscope.functions.text import has_email, has_phone, share, starts_with_date
from tabscope.operators.columns import (
    TEMPORAL,
    as_double,
    as_text,
    column_name,
    data_type,
    is_number,
    rendered,
)
from tabscope.operators.frequency import (
    VALUE_SLOTS,
    completeness_of,
    duplicate_rows,
    frequency_table,
    null_pct,
    top_of,
)
from tabscope.operators.quantiles import quantile_values

NUMERIC, CATEGORICAL, DATETIME, TEXT = "numeric", "categorical", "datetime", "text"

# The thresholds that separate the classes and raise the flags.
MAX_CATEGORIES = 50
MAX_CATEGORY_SHARE = 0.05
DATE_SHARE = 0.8
PII_SHARE = 0.3


@dataclass(frozen=True)
class Options:
    """Choices that differ between parity with small files and use at scale.

    ``decimal_as_numeric``: treat decimals as numbers instead of text.
    ``pii_scope``: "text" looks for personal data in text-class columns, "string" in all strings.
    ``date_sample`` / ``pii_sample`` with ``order_by``: judge by the first rows in an order
    instead of by all rows.
    ``quantile_method``: "nearest" or "linear".
    """

    decimal_as_numeric: bool = False
    pii_scope: str = "text"
    order_by: tuple[str, ...] = ()
    date_sample: int | None = None
    pii_sample: int | None = None
    quantile_method: str = "nearest"


def _kind(data: T.DataType, options: Options) -> str:
    if isinstance(data, TEMPORAL):
        return "temporal"
    if is_number(data) or (options.decimal_as_numeric and isinstance(data, T.DecimalType)):
        return "number"
    if isinstance(data, T.StringType):
        return "string"
    if isinstance(data, T.BooleanType):
        return "boolean"
    return "other"


def _first_known(df: DataFrame, column: str, order_by: Sequence[str], n: int) -> DataFrame:
    known = df.where(column_ref(column).isNotNull())
    return known.orderBy(*[column_ref(c) for c in order_by]).select(column_ref(column)).limit(n)


def pattern_shares(
    df: DataFrame,
    columns: Sequence[str],
    patterns: dict,
    sample: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """(column, <pattern>...): share of non-null values that satisfy each pattern.

    Over all rows in one pass, or over the first ``sample`` non-null values in ``order_by``.
    """
    def shares(col: Column) -> dict:
        return {name: share(test(col)) for name, test in patterns.items()}

    if sample is None:
        return stacked_aggregates(df, {c: shares(column_ref(c)) for c in columns}).drop("position")
    if not order_by:
        raise ValueError("a sample of first rows needs order_by")
    parts = [
        stacked_aggregates(_first_known(df, c, order_by, sample), {c: shares(column_ref(c))}).drop("position")
        for c in columns
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def date_like_share(df: DataFrame, columns: Sequence[str], sample: int | None = None,
                    order_by: Sequence[str] = ()) -> DataFrame:
    """(column, date_share): how much of each string column begins like a date."""
    return pattern_shares(df, columns, {"date_share": starts_with_date}, sample, order_by)


def pii_shares(df: DataFrame, columns: Sequence[str], sample: int | None = None,
               order_by: Sequence[str] = ()) -> DataFrame:
    """(column, email_share, phone_share, pii_flags): personal data found in string columns."""
    shares = pattern_shares(
        df, columns, {"email_share": has_email, "phone_share": has_phone}, sample, order_by
    )
    return shares.withColumn("pii_flags", _flags(F.col("email_share"), F.col("phone_share")))


def _flags(email: Column, phone: Column) -> Column:
    return F.array_compact(F.array(
        F.when(email > PII_SHARE, F.lit("potential_email")),
        F.when(phone > PII_SHARE, F.lit("potential_phone")),
    ))


def pii_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text holds an e-mail address or a phone number."""
    text = column_ref(column)
    return (
        df.withColumn("has_email", has_email(text))
        .withColumn("has_phone", has_phone(text))
        .where(F.col("has_email") | F.col("has_phone"))
    )


def semantic_class(kind: Column, n_unique: Column, total: Column, date_share: Column) -> Column:
    """The class of a column from its physical kind and its counts."""
    few = n_unique <= MAX_CATEGORIES
    rare = n_unique / F.greatest(total, F.lit(1)) < MAX_CATEGORY_SHARE
    return (
        F.when(kind == "temporal", DATETIME)
        .when((kind == "number") & few & rare, CATEGORICAL)
        .when(kind == "number", NUMERIC)
        .when((kind == "string") & (F.coalesce(date_share, F.lit(0.0)) > DATE_SHARE), DATETIME)
        .when((kind == "string") & few, CATEGORICAL)
        .when(kind == "boolean", CATEGORICAL)
        .otherwise(TEXT)
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, std, min, max) of number columns: one pass of global aggregates."""
    if not columns:
        return local_table(df.sparkSession, [], "column string, mean double, std double, min double, max double")
    return stacked_aggregates(
        df,
        {
            c: {
                "mean": F.avg(as_double(c)), "std": F.stddev_samp(as_double(c)),
                "min": F.min(as_double(c)), "max": F.max(as_double(c)),
            }
            for c in columns
        },
    ).drop("position")


def _value_facts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """What the value frequencies tell: counts, the share of dates, and the top values.

    Dates are recognised once per distinct value and weighted by its count. Both branches
    read the same shuffled frequency table.
    """
    freq = frequency_table(df, columns)
    known = F.col("v_long").isNotNull() | F.col("v_double").isNotNull() | F.col("v_text").isNotNull()
    text_rows = F.when(F.col("v_text").isNotNull(), F.col("count"))
    dated = starts_with_date(F.col("v_text"))
    counts = freq.groupBy("column_no").agg(
        F.sum("count").alias("total_count"),
        F.sum(F.when(known, 0).otherwise(F.col("count"))).alias("null_count"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.sum(F.when(dated, text_rows).otherwise(0)) / F.sum(text_rows)).alias("date_share"),
    )
    slots = F.struct("rank", "count", *VALUE_SLOTS)
    lists = top_of(freq, k).groupBy("column_no").agg(F.array_sort(F.collect_list(slots)).alias("slots"))
    facts = pin(counts.join(lists, "column_no"))
    shown = F.coalesce(rendered(df, columns), F.lit("None")).alias("value")
    top = facts.select("column_no", F.inline("slots")).select("column_no", "rank", shown, "count")
    entries = top.groupBy("column_no").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("entries")
    )
    return facts.join(entries, "column_no").select(
        column_name(columns).alias("column"), "total_count", "null_count", "n_unique", "date_share",
        F.transform(
            "entries", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))
        ).alias("top_values"),
    )


def summarize(df: DataFrame, options: Options = Options(), k: int = 10) -> DataFrame:
    """One row per column: class, counts, moments, ranges and most frequent values.

    A few scans whatever the number of columns: value frequencies, moments of numbers, ranges
    of dates. The result has as many rows
    as the table has columns and is pinned, because later plans are chosen by the classes.
    """
    columns = list(df.columns)
    if not columns:
        raise ValueError("the table has no columns")
    kinds = {c: _kind(data_type(df, c), options) for c in columns}
    names = local_table(
        df.sparkSession,
        [(i, c, data_type(df, c).simpleString(), kinds[c]) for i, c in enumerate(columns)],
        "position int, column string, dtype string, kind string",
    )
    facts = pin(_value_facts(df, columns, k))
    moments = pin(_moments(df, [c for c in columns if kinds[c] == "number"]))
    strings = [c for c in columns if kinds[c] == "string"]
    if strings and options.date_sample is not None:
        sampled = date_like_share(df, strings, options.date_sample, options.order_by)
        facts = facts.drop("date_share").join(pin(sampled), "column", "left")
    zero = F.lit(0).cast("long")
    counted = names.join(facts, "column", "left").join(moments, "column", "left").withColumns({
        c: F.coalesce(c, zero) for c in ("total_count", "null_count", "n_unique")
    })
    shared = F.when(F.col("kind") == "string", F.col("date_share"))
    classed = pin(counted.select(
        "position", "column",
        semantic_class(F.col("kind"), F.col("n_unique"), F.col("total_count"), shared).alias("detected_type"),
        "dtype", "total_count", "null_count", null_pct().alias("null_pct"), "n_unique",
        shared.alias("date_share"), "mean", "std", "min", "max",
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
    ))
    times = columns_of_class(classed, DATETIME)
    if not times:
        nothing = F.lit(None).cast("string")
        return classed.withColumns({"min_text": nothing, "max_text": nothing})
    return classed.join(pin(datetime_profile(df, times).toDF("column", "min_text", "max_text")), "column", "left")


def column_types(df: DataFrame, options: Options = Options()) -> DataFrame:
    """(position, column, dtype, n_unique, total_count, detected_type)."""
    return summarize(df, options, k=1).select(
        "position", "column", "dtype", "n_unique", "total_count", "detected_type"
    )


def columns_of_class(summary: DataFrame, wanted: str) -> list[str]:
    """The names of the columns of one class, in table order."""
    rows = small_rows(summary.where(F.col("detected_type") == wanted).select("position", "column"))
    return [row["column"] for row in sorted(rows)]


def numeric_profile(df: DataFrame, columns: Sequence[str], method: str = "nearest") -> DataFrame:
    """(column, mean, median, std, min, max, q25, q75) of the non-null values."""
    moments = stacked_aggregates(
        df,
        {
            c: {
                "n": F.count(as_double(c)),
                "mean": F.round(F.avg(as_double(c)), 4),
                "std": F.round(F.stddev_samp(as_double(c)), 4),
                "min": F.min(as_double(c)),
                "max": F.max(as_double(c)),
            }
            for c in columns
        },
    )
    rows = pin(moments)
    counts = {row["column"]: row["n"] for row in small_rows(rows)}
    return rows.drop("n", "position").join(_quartiles(df, columns, counts, method), "column")


def _quartiles(df: DataFrame, columns: Sequence[str], counts: dict, method: str) -> DataFrame:
    wanted = [(0.25, method), (0.5, "linear"), (0.75, method)]
    values = quantile_values(df, {c: wanted for c in columns}, counts)
    rows = [
        (c, *[None if values[c, p, m] is None else float(values[c, p, m]) for p, m in wanted])
        for c in columns
    ]
    table = local_table(df.sparkSession, rows, "column string, q25 double, median double, q75 double")
    return table.select("column", *[F.round(q, 4).alias(q) for q in ("q25", "median", "q75")])


def categorical_profile(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, n_unique, top_values) with null counted as a value."""
    return summarize(df.select(*[column_ref(c) for c in columns]), k=k).select(
        "column", "n_unique", "top_values"
    )


def datetime_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max) as text."""
    return stacked_aggregates(
        df,
        {
            c: {"min": F.min(column_ref(c)).cast("string"), "max": F.max(column_ref(c)).cast("string")}
            for c in columns
        },
    ).drop("position")


def profile_columns(df: DataFrame, options: Options = Options(), summary: DataFrame | None = None) -> DataFrame:
    """One record per column; statistics that do not apply to its class are null.

    numeric: mean, median, std, min, max, q25, q75. categorical and text: top_values.
    datetime: min_text, max_text. text: pii_flags.
    """
    summary = summary if summary is not None else summarize(df, options)
    spark = df.sparkSession
    rows = small_rows(summary.select("column", "detected_type", "total_count", "null_count"))
    numbers = {r["column"]: r["total_count"] - r["null_count"] for r in rows if r["detected_type"] == NUMERIC}
    profile = summary
    if numbers:
        profile = profile.join(
            _quartiles(df, list(numbers), numbers, options.quantile_method), "column", "left"
        )
    else:
        for q in ("q25", "median", "q75"):
            profile = profile.withColumn(q, F.lit(None).cast("double"))
    scanned = [
        r["column"] for r in rows
        if r["detected_type"] == TEXT
        or (options.pii_scope == "string" and isinstance(data_type(df, r["column"]), T.StringType))
    ]
    if scanned:
        texts = df.select(
            *[as_text(df, c).alias(c) for c in scanned],
            *[column_ref(c) for c in options.order_by if c not in scanned],
        )
        shares = pin(pii_shares(texts, scanned, options.pii_sample, options.order_by))
        profile = profile.join(shares, "column", "left")
    else:
        profile = (
            profile.withColumn("email_share", F.lit(None).cast("double"))
            .withColumn("phone_share", F.lit(None).cast("double"))
            .withColumn("pii_flags", F.lit(None).cast("array<string>"))
        )
    numeric = F.col("detected_type") == NUMERIC
    counted = F.col("detected_type").isin(CATEGORICAL, TEXT)
    dated = F.col("detected_type") == DATETIME
    return profile.select(
        "position", "column", "detected_type", "dtype", "total_count", "null_count", "null_pct",
        "n_unique",
        F.when(numeric, F.round("mean", 4)).alias("mean"),
        F.when(numeric, F.col("median")).alias("median"),
        F.when(numeric, F.round("std", 4)).alias("std"),
        F.when(numeric, F.col("min")).alias("min"),
        F.when(numeric, F.col("max")).alias("max"),
        F.when(numeric, F.col("q25")).alias("q25"),
        F.when(numeric, F.col("q75")).alias("q75"),
        F.when(dated, F.col("min_text")).alias("min_text"),
        F.when(dated, F.col("max_text")).alias("max_text"),
        F.when(counted, F.col("top_values")).alias("top_values"),
        F.coalesce("pii_flags", F.array().cast("array<string>")).alias("pii_flags"),
    )


def dataset_profile_of(summary: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Roll the column records and the duplicate count up to one row."""
    shape = completeness_of(summary)
    classes = summary.agg(*[
        F.count_if(F.col("detected_type") == c).alias(f"{c}_columns")
        for c in (NUMERIC, CATEGORICAL, DATETIME, TEXT)
    ])
    # three one-row tables side by side
    one = F.lit(1).alias("one_")
    return (
        shape.select("*", one)
        .join(classes.select("*", one), "one_")
        .join(duplicates.select("*", one), "one_")
        .drop("one_")
    )


def profile_dataset(df: DataFrame, options: Options = Options()) -> DataFrame:
    """One row: shape, class counts, completeness, total nulls, duplicate rows."""
    return dataset_profile_of(summarize(df, options, k=1), duplicate_rows(df))
