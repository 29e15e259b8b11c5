"""Writing result tables."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tabscope.operators.columns import as_text

NESTED = ("array", "map", "struct")


def write_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Write every result table to its own folder under ``folder``; returns the paths.

    CSV has no nested values, so there they are written as JSON text.
    """
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"Unsupported result format: {fmt}")
    paths = []
    for name, table in tables.items():
        path = os.path.join(folder, f"{name}.{fmt}")
        writer = table
        if fmt == "csv":
            writer = table.select(*[
                as_text(table, f.name).alias(f.name)
                if f.dataType.typeName() in NESTED else table[f"`{f.name}`"]
                for f in table.schema.fields
            ])
        options = {
            "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
        } if fmt == "csv" else {}
        writer.write.mode("overwrite").options(**options).format(fmt).save(path)
        paths.append(path)
    return paths


def results_as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, with values that JSON cannot hold turned to null."""
    from tabscope.functions.bounded import column_ref

    def plain(field):
        col = column_ref(field.name)
        if field.dataType.typeName() in ("float", "double"):
            bad = F.isnan(col) | col.isin(float("inf"), float("-inf"))
            return F.when(~bad, col).alias(field.name)
        return col

    fields = [plain(f) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
