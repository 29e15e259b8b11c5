"""SQL given as text: cleaning it, admitting only reads, and running it on a table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabscope.functions.text import WHITESPACE, strip


def cleaned_sql(text: Column) -> Column:
    """The statement without surrounding space, back-ticks and a leading ``sql`` tag."""
    bare = strip(F.btrim(strip(text), F.lit("`")))
    return F.when(F.lower(bare).startswith("sql"), strip(F.substring(bare, 4, 2**31 - 1))).otherwise(bare)


def clean_sql_text(df: DataFrame, text: str) -> DataFrame:
    """Add ``sql`` and ``accepted``: the cleaned statement and whether it is a SELECT."""
    return df.withColumn("sql", cleaned_sql(F.col(text))).withColumn(
        "accepted", F.coalesce(F.upper("sql").startswith("SELECT"), F.lit(False))
    )


FENCE = re.compile(r"```(?:\w*\s)?(.*)```", re.DOTALL)
LITERALS = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.DOTALL)


def clean_statement(sql: str) -> str:
    """The same cleaning for one statement held by the driver; only back-ticks around all of it go."""
    bare = sql.strip(WHITESPACE)
    if fenced := FENCE.fullmatch(bare):
        bare = fenced.group(1).strip(WHITESPACE)
    elif len(bare) > 1 and bare[0] == bare[-1] == "`" and "`" not in bare[1:-1]:
        bare = bare[1:-1].strip(WHITESPACE)
    return bare[3:].strip(WHITESPACE) if re.match(r"(?i)sql\b", bare) else bare


def is_read(statement: str) -> bool:
    """Whether a statement begins as a query and calls nothing outside of SQL.

    Texts in quotes and comments are not looked at.
    """
    code = LITERALS.sub("''", statement)
    begins = re.match(r"(?i)\s*(select|with)\b", code)
    outside = re.search(r"(?i)\b(java_method|reflect|try_reflect)`?\s*\(|\btransform\s*\([^)]*\)\s*using\b|\busing\s+''", code)
    return begins is not None and outside is None


def safe_select(
    df: DataFrame,
    sql: str,
    view: str = "data",
    limit: int | None = None,
    views: Mapping[str, DataFrame] | None = None,
) -> DataFrame | None:
    """The rows of a read-only statement over the table ``data``, None if it cannot run.

    More tables can be named in ``views``. The statement is planned as a subquery, where Spark
    admits nothing but a query: a write, a second statement or a missing column is refused. The
    names are those of common table expressions around the statement, so a view of the caller
    with such a name is neither read nor replaced. Files named by their path are refused.
    """
    statement = clean_statement(sql).rstrip(WHITESPACE + ";")
    if not is_read(statement):
        return None
    spark: SparkSession = df.sparkSession
    private = {name: f"tabscope_{uuid.uuid4().hex}" for name in {view: df, **(views or {})}}
    for name, table in {view: df, **(views or {})}.items():
        table.createOrReplaceTempView(private[name])
    tables = ", ".join(f"`{name}` AS (SELECT * FROM {own})" for name, own in private.items())
    on_files = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        result = spark.sql(f"WITH {tables} SELECT * FROM (\n{statement}\n)")
    except PySparkException:
        return None
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", on_files)
        for own in private.values():
            spark.catalog.dropTempView(own)
    return result if limit is None else result.limit(limit)


def newer_than(df: DataFrame, time_column: str, hours: int = 24) -> DataFrame:
    """The rows at most ``hours`` older than the newest one."""
    newest = df.agg(F.max(time_column)).first()[0]
    if newest is None:
        return df.where(F.lit(False))
    kind = df.schema[time_column].dataType
    return df.where(F.col(time_column) >= F.lit(newest).cast(kind) - F.make_interval(hours=F.lit(hours)))
