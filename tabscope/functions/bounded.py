"""Small results: one row per column, per pair of columns or per partition."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

PIN_LIMIT = 100_000


class TooLarge(ValueError):
    """A result that had to be small was not."""


def pin(df: DataFrame, limit: int = PIN_LIMIT) -> DataFrame:
    """Compute a small result once and return it as a local relation.

    The size is checked: more than ``limit`` rows is an error, never a truncation.
    """
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise TooLarge(f"expected at most {limit} rows")
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def small_rows(df: DataFrame, limit: int = PIN_LIMIT) -> list:
    """Collect a result that has one row per column or pair, after the same check."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"expected at most {limit} rows")
    return rows


def local_table(spark, rows: list, schema: str) -> DataFrame:
    """A driver-made table of a few rows, kept as a local relation."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    data = [dict(zip(names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(struct)), schema=struct)


def stacked_aggregates(df: DataFrame, per_column: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One pass of global aggregates, returned as one row per key.

    ``per_column`` maps a key to its named aggregates; all keys carry the same names. The
    aggregates are reduced inside every task, so the shuffle holds one row per task.
    """
    keys = list(per_column)
    names = list(next(iter(per_column.values())))
    aggregates = [
        per_column[key][name].alias(f"a{i}_{j}")
        for i, key in enumerate(keys)
        for j, name in enumerate(names)
    ]
    one_row = df.agg(*aggregates)
    structs = [
        F.struct(
            F.lit(key).alias("column"),
            F.lit(i).alias("position"),
            *[F.col(f"a{i}_{j}").alias(name) for j, name in enumerate(names)],
        )
        for i, key in enumerate(keys)
    ]
    return one_row.select(F.inline(F.array(*structs)))


def column_ref(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
