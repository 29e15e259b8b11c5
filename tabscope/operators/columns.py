"""Column kinds: which physical types are numbers, and long (column, value) forms of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.bounded import column_ref

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = tuple(
    getattr(T, name) for name in ("DateType", "TimestampType", "TimestampNTZType", "TimeType") if hasattr(T, name)
)


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGRAL + FRACTIONAL)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_double(name: str) -> Column:
    return column_ref(name).cast("double")


def local_micros(col: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    seconds = (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("long")
    return (
        F.unix_date(col.cast("date")).cast("long") * 86_400_000_000
        + F.hour(col).cast("long") * 3_600_000_000
        + F.minute(col).cast("long") * 60_000_000
        + seconds
    )


def as_text(df: DataFrame, name: str) -> Column:
    """The display text of a value; nested values as JSON, which also makes them comparable."""
    kind = data_type(df, name)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(column_ref(name))
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column_ref(name))))
    return column_ref(name).cast("string")


def unpivot_groups(df: DataFrame, groups: Sequence[Sequence[str]], names: Sequence[str], number: str) -> DataFrame:
    """One row per group of columns: (number, names...), where ``number`` is the group's place.

    UNPIVOT becomes an Expand, which stays inside generated code; exploding an array of
    structs would not. The columns need plain names.
    """
    lists = ", ".join(f"({', '.join(group)}) AS `{i}`" for i, group in enumerate(groups))
    values = ", ".join(names)
    return df.sparkSession.sql(
        f"SELECT cast({number} AS int) AS {number}, {values} FROM {{wide}} "
        f"UNPIVOT INCLUDE NULLS (({values}) FOR {number} IN ({lists}))",
        wide=df,
    )


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., column, value double), nulls left out: one scan for all columns."""
    return long_cells(df, {c: as_double(c) for c in columns}, keep)


def long_cells(df: DataFrame, cells: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., column, value) of one named expression per column, nulls left out."""
    kept = [column_ref(k).alias(f"kept{i}_") for i, k in enumerate(keep)]
    wide = df.select(*kept, *[cell.alias(c) for c, cell in cells.items()])
    values = [column_ref(c) for c in cells]
    long = wide.unpivot([f"kept{i}_" for i in range(len(keep))], values, "column", "value")
    return long.where(F.col("value").isNotNull()).select(
        *[F.col(f"kept{i}_").alias(k) for i, k in enumerate(keep)], "column", "value"
    )


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_no, v_long, v_double, v_text): every value in the one slot of its kind.

    One grouping over this table counts the values of all columns without first turning
    numbers into text. ``column_no`` is the place of the column in ``columns``.
    """

    def value(i: int, name: str) -> Column:
        plain = INTEGRAL + FRACTIONAL + (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        return (column_ref(name) if isinstance(data_type(df, name), plain) else as_text(df, name)).alias(f"x{i}")

    def slots(i: int, name: str) -> list[Column]:
        kind, col = data_type(df, name), F.col(f"x{i}")
        number, real, text = (F.lit(None).cast(t) for t in ("long", "double", "string"))
        if isinstance(kind, INTEGRAL + (T.BooleanType,)):
            number = col.cast("long")
        elif isinstance(kind, T.DateType):
            number = F.unix_date(col).cast("long")
        elif isinstance(kind, T.TimestampType):
            number = F.unix_micros(col)
        elif isinstance(kind, T.TimestampNTZType):
            number = local_micros(col)
        elif isinstance(kind, FRACTIONAL):
            real = col.cast("double")
        else:
            text = col.cast("string")
        return [number.alias(f"l{i}"), real.alias(f"d{i}"), text.alias(f"t{i}")]

    # a projection of their own, so that derived values are computed once
    values = df.select(*[value(i, c) for i, c in enumerate(columns)])
    wide = values.select(*[slot for i, c in enumerate(columns) for slot in slots(i, c)])
    groups = [(f"l{i}", f"d{i}", f"t{i}") for i in range(len(columns))]
    return unpivot_groups(wide, groups, ("v_long", "v_double", "v_text"), "column_no")


def column_name(columns: Sequence[str]) -> Column:
    """The name behind a ``column_no``."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_no") + 1)


def rendered(df: DataFrame, columns: Sequence[str]) -> Column:
    """The display text of a cell of ``long_values``."""
    v_long, v_double, v_text = F.col("v_long"), F.col("v_double"), F.col("v_text")
    rendering = F.coalesce(v_text, v_double.cast("string"), v_long.cast("string"))
    seconds = (v_long.cast("decimal(20, 0)") / 1_000_000).cast("decimal(18, 6)")
    texts = (
        (T.BooleanType, v_long.cast("boolean").cast("string")),
        (T.DateType, F.date_from_unix_date(v_long.cast("int")).cast("string")),
        (T.TimestampType, F.timestamp_micros(v_long).cast("string")),
        (T.TimestampNTZType, (
            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
        ).cast("string")),
        (T.FloatType, v_double.cast("float").cast("string")),
    )
    for kind, text in texts:
        numbers = [i for i, c in enumerate(columns) if isinstance(data_type(df, c), kind)]
        if numbers:
            rendering = F.when(F.col("column_no").isin(numbers), text).otherwise(rendering)
    return rendering
