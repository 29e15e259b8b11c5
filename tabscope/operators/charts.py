"""The data behind each chart, reduced to what a drawing can show, and the choice of charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.bounded import column_ref, local_table, small_rows, stacked_aggregates
from tabscope.operators.association import pearson_matrix
from tabscope.operators.columns import INTEGRAL, as_double, local_micros, numeric_columns
from tabscope.operators.frequency import top_values
from tabscope.operators.outliers import IQR_REACH
from tabscope.operators.quantiles import quantile_values
from tabscope.operators.sampling import sample

# Sizes of the charts and of the plan.
HISTOGRAM_BINS = 50
BAR_VALUES = 20
PIE_VALUES = 10
SCATTER_BINS = 50
MAX_CHARTS = 10
LINE_PIXELS = 1000


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, count): equal-width bins between minimum and maximum, empty ones kept.

    One pass for the range and one for the counts; at most ``bins`` rows leave a task.
    """
    value = as_double(column)
    usable = value.isNotNull() & ~F.isnan(value)
    low, high = df.where(usable).agg(F.min(value), F.max(value)).first()
    if low is None:
        return local_table(df.sparkSession, [], "bin int, low double, high double, count long")
    width = (high - low) / bins
    place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)) if high > low else F.lit(0)
    counted = (
        df.where(usable).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * width).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * width).alias("high"),
    )
    return edges.join(counted, "bin", "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("long"))
    ).select("bin", "low", "high", "count")


def box(df: DataFrame, columns: Sequence[str], method: str = "nearest") -> DataFrame:
    """(column, min, q25, median, q75, max, lower_whisker, upper_whisker) per column.

    A whisker ends at the last value within 1.5 interquartile ranges of its quartile.
    """
    row = df.agg(*[F.count(as_double(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    counts = {c: row[i] for i, c in enumerate(columns) if row[i]}
    wanted = [(0.25, method), (0.5, "linear"), (0.75, method)]
    if not counts:
        return local_table(df.sparkSession, [], BOX_SCHEMA)
    found = quantile_values(df, {c: wanted for c in counts}, counts)

    def aggregates(c: str) -> dict:
        value = as_double(c)
        q1, median, q3 = (found[(c, *w)] for w in wanted)
        reach = IQR_REACH * (q3 - q1)
        return {
            "min": F.min(value), "q25": F.lit(q1), "median": F.lit(median), "q75": F.lit(q3),
            "max": F.max(value),
            "lower_whisker": F.min(F.when(value >= q1 - reach, value)),
            "upper_whisker": F.max(F.when(value <= q3 + reach, value)),
        }

    return stacked_aggregates(df, {c: aggregates(c) for c in counts}).drop("position")


BOX_SCHEMA = (
    "column string, min double, q25 double, median double, q75 double, max double, "
    "lower_whisker double, upper_whisker double"
)


def bar(df: DataFrame, column: str, k: int = BAR_VALUES) -> DataFrame:
    """(value, count) of the most frequent values, null as ``None``."""
    return top_values(df, [column], k).orderBy("rank").select("value", "count")


def pie(df: DataFrame, column: str, k: int = PIE_VALUES) -> DataFrame:
    """(value, count, share) of the most frequent values; shares are of the values shown."""
    shown = top_values(df, [column], k).orderBy("rank").select("value", "count")
    total = shown.agg(F.sum("count").alias("total_"))
    return shown.withColumn("one_", F.lit(1)).join(total.withColumn("one_", F.lit(1)), "one_").select(
        "value", "count", F.round(F.col("count") / F.col("total_"), 6).alias("share")
    )


def scatter(df: DataFrame, x: str, y: str, key: Sequence[str], sample_size: int | None = None) -> DataFrame:
    """(key..., x, y) of the rows that have both values; on request a fixed random sample of them."""
    names = list(dict.fromkeys([*key, x, y]))
    complete = df.select(*[column_ref(c) for c in names]).na.drop(subset=[x, y])
    return complete if sample_size is None else sample(complete, sample_size, key)


def binned_scatter(df: DataFrame, x: str, y: str, bins: int = SCATTER_BINS) -> DataFrame:
    """(x_bin, y_bin, count) of all rows that have both values, on a grid between their extremes."""
    complete = df.select(as_double(x).alias("x"), as_double(y).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )
    ends = complete.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return local_table(df.sparkSession, [], "x_bin int, y_bin int, count long")

    def cell(name: str, low: float, high: float) -> Column:
        if high == low:
            return F.lit(0)
        place = F.floor((F.col(name) - low) / (high - low) * bins)
        return F.least(place, F.lit(bins - 1)).cast("int")

    return complete.groupBy(
        cell("x", ends[0], ends[1]).alias("x_bin"), cell("y", ends[2], ends[3]).alias("y_bin")
    ).count()


def heatmap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col1, col2, correlation) of all columns, constant ones included."""
    return pearson_matrix(df, columns, drop_constant=False)


def line(
    df: DataFrame, time_column: str, column: str, every: str | None = None, pixels: int | None = LINE_PIXELS
) -> DataFrame:
    """(time, value) in time order, for a drawing ``pixels`` wide: at most four rows a pixel column.

    Each pixel column keeps its first, last, lowest and highest value, which draw the same line as all rows do. ``every``
    averages per date_trunc unit instead; ``pixels=None`` keeps all rows, and so does a time column of texts.
    """
    complete = df.select(
        column_ref(time_column).alias("time"), column_ref(column).alias("value")
    ).na.drop()
    if every is not None:
        complete = complete.groupBy(F.date_trunc(every, "time").alias("time")).agg(
            F.avg("value").alias("value")
        )
    elif pixels is not None and (place := _whole_time(complete)) is not None:
        complete = _outline(complete, place, pixels)
    return complete.orderBy("time")


def _whole_time(df: DataFrame) -> Column | None:
    """The column ``time`` as a whole number, if its type has an even scale."""
    kind, time = df.schema["time"].dataType, F.col("time")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time)
    if isinstance(kind, T.TimestampNTZType):
        return local_micros(time)
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("long")
    return time.cast("long") if isinstance(kind, INTEGRAL) else None


def _outline(df: DataFrame, place: Column, pixels: int) -> DataFrame:
    placed = df.withColumn("place_", place)
    low, high = placed.agg(F.min("place_"), F.max("place_")).first()
    if low is None:
        return df
    pixel = F.expr(f"(CAST(place_ AS DECIMAL(20, 0)) - {low}) * {pixels} div {high - low + 1}")
    by_time, by_value = F.struct("time", "value"), F.struct("value", "time")
    ends = placed.groupBy(pixel.alias("pixel")).agg(
        F.min(by_time).alias("a"), F.max(by_time).alias("b"), F.min(by_value).alias("c"), F.max(by_value).alias("d"),
    )
    kept = F.array_distinct(F.array(*(F.struct(F.col(f"{x}.time"), F.col(f"{x}.value")) for x in "abcd")))
    return ends.select(F.inline(kept))


def chart_plan(summary: DataFrame, correlations: DataFrame, max_charts: int = MAX_CHARTS) -> DataFrame:
    """(place, chart_type, columns, title, reason): which charts to draw, by rule.

    Reads the column classes and the high correlations, a row per column and per pair.
    """
    rows = sorted(small_rows(summary.select("position", "column", "detected_type")))
    classed = {
        kind: [r["column"] for r in rows if r["detected_type"] == kind]
        for kind in ("numeric", "categorical", "datetime")
    }
    numbers, categories, times = classed.values()
    pairs = sorted(small_rows(correlations), key=lambda r: (-abs(r["correlation"]), r["col1"], r["col2"]))
    plan = [
        ("histogram", [c], f"Distribution of {c}", "Shows the spread and shape of values") for c in numbers[:3]
    ]
    if numbers:
        plan.append(("box", numbers[:6], "Box plots of numeric columns", "Compare distributions and spot outliers"))
    plan += [("bar", [c], f"Value counts for {c}", "Shows category distribution") for c in categories[:2]]
    plan += [
        ("scatter", [r["col1"], r["col2"]], f"{r['col1']} vs {r['col2']} (r={r['correlation']})",
         f"High correlation: {r['correlation']}")
        for r in pairs[:2]
    ]
    if len(numbers) >= 3:
        plan.append(("heatmap", numbers[:10], "Correlation heatmap", "Overview of numeric relationships"))
    if times:
        plan += [("line", [times[0], c], f"{c} over time", "Time trend visualization") for c in numbers[:2]]
    return local_table(
        summary.sparkSession,
        [(i, *chart) for i, chart in enumerate(plan[:max_charts])],
        "place int, chart_type string, columns array<string>, title string, reason string",
    )


def chart_data(df: DataFrame, plan: DataFrame, key: Sequence[str]) -> dict[str, DataFrame]:
    """Title to data for every planned chart whose type is known and whose columns exist."""
    builders = {
        "histogram": lambda cols: histogram(df, cols[0]),
        "box": lambda cols: box(df, cols),
        "bar": lambda cols: bar(df, cols[0]),
        "scatter": lambda cols: scatter(df, cols[0], cols[1], key),
        "heatmap": lambda cols: heatmap(df, cols),
        "line": lambda cols: line(df, cols[0], cols[1]),
        "pie": lambda cols: pie(df, cols[0]),
    }
    numbers = set(numeric_columns(df))
    data = {}
    for row in sorted(small_rows(plan)):
        columns = row["columns"]
        if row["chart_type"] not in builders or not set(columns) <= set(df.columns):
            continue
        if row["chart_type"] in ("histogram", "box", "heatmap") and not set(columns) <= numbers:
            continue
        data[row["title"]] = builders[row["chart_type"]](columns)
    return data
