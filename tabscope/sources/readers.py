"""Choosing a reader by file extension, and what is known about a file before analysis."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabscope.functions.bounded import column_ref

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def detect_file_type(path: str) -> str:
    """The extension in lower case, if a reader exists for it."""
    extension = PurePosixPath(path).suffix.lower()
    if extension not in FORMATS:
        raise ValueError(f"Unsupported file type: {extension}")
    return extension


def load(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    json_lines: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read a CSV, JSON or Parquet file, or a folder of them named with the extension."""
    extension = detect_file_type(path)
    try:
        if extension == ".csv":
            df = scan_csv(spark, path, encoding, schema, multi_line)
        elif extension == ".json":
            reader = spark.read.option("multiLine", not json_lines)
            df = (reader.schema(schema) if schema else reader).json(path)
        else:
            df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise
    return require_rows(df)


def scan_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header; quotes inside quoted text are doubled.

    Quoted text may hold line breaks. A file that has some can't be split between tasks, so it is found out
    (``needs_multi_line``) unless ``multi_line`` says so. Types are inferred unless a schema is given, and the encoding is
    found unless it is given. Each of these costs a pass over the file.
    """
    encoding = encoding or find_encoding(spark, path)
    if multi_line is None:
        # bytes of a quote may be parts of other characters elsewhere
        multi_line = encoding.upper() not in BYTE_ENCODINGS or needs_multi_line(spark, path)
    reader = spark.read.options(header=True, encoding=encoding, quote='"', escape='"', multiLine=multi_line)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


#: Encodings in which the byte of a quote is always a quote.
BYTE_ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252")


def find_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all bytes of the text are valid in it, else ISO-8859-1."""
    lines = spark.read.text(path)
    return "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def needs_multi_line(spark: SparkSession, path: str) -> bool:
    """Whether a line of a CSV is not surely a whole record.

    A line without quotes, but for whole quoted fields, ends in the state it begins in; if all lines are so, no quoted
    text goes on in the next line.
    """
    outside = F.regexp_replace(F.replace("value", F.lit('""'), F.lit("")), r'(^|,)"[^"]*+"(?=,|$)', "$1")
    return not spark.read.text(path).where(outside.contains('"')).isEmpty()


def require_rows(df: DataFrame) -> DataFrame:
    """The table itself, if it has a column and a row."""
    if not df.columns:
        raise ValueError("Dataset has no columns")
    if df.isEmpty():
        raise ValueError("Dataset is empty (0 rows)")
    return df


def dataset_metadata(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows, columns): one row per column of the table."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(df.schema.fields)
    ])
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.inline(fields), "rows", F.lit(len(df.columns)).alias("columns"))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_size_mb) of the files behind a path.

    Asks for file listings only: one metadata row per file, no file is opened.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("file_size_mb"),
    )


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order. Every task keeps ``n`` rows, none sorts everything."""
    return df.orderBy(*[column_ref(c) for c in order_by]).limit(n)


__all__ = [
    "dataset_metadata", "detect_file_type", "file_metadata", "find_encoding", "load", "needs_multi_line", "require_rows",
    "sample_rows", "scan_csv",
]
