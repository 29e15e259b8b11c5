"""The list of registered queries and small helpers to state their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def per_column(template: str, columns: Sequence[str], **more: str) -> str:
    """One SELECT per column, joined by UNION ALL. {c} is the column, {i} its place."""
    return " UNION ALL ".join(
        "(" + template.format(c=c, i=i, **more) + ")" for i, c in enumerate(columns)
    )


# Inputs with gaps: the given tables have no nulls, so some queries derive them.

def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem whose quantity is missing on line 7 and whose flag is missing on line 5."""
    df = table(spark, folder, "lineitem")
    return df.withColumns({
        "l_quantity": F.when(F.col("l_linenumber") != 7, F.col("l_quantity")),
        "l_returnflag": F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")),
    })


GAPPY_LINEITEM = (
    "(SELECT * REPLACE (CASE WHEN l_linenumber <> 7 THEN l_quantity END AS l_quantity, "
    "CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag) FROM lineitem)"
)


def rated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents with their labels; a document without a label has nulls there."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


RATED_DOCUMENTS = (
    "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
)


def contact_customers(spark: SparkSession, folder: str) -> DataFrame:
    """customer with an e-mail and a phone column made from its name and key."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").withColumns({
        "email": F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@example.com")),
        "phone": F.concat(
            F.lit("("), (200 + key % 800).cast("string"), F.lit(") 555-"),
            (1000 + key % 9000).cast("string"),
        ),
    })


CONTACT_CUSTOMERS = (
    "(SELECT *, replace(c_name, '#', '.') || '@example.com' AS email, "
    "'(' || (200 + c_custkey % 800)::VARCHAR || ') 555-' || (1000 + c_custkey % 9000)::VARCHAR "
    "AS phone FROM customer)"
)
