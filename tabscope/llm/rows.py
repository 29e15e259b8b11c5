"""Per-document work in Arrow batches, and the shared folder for intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.session import scratch_path

#: Rows of an Arrow batch that are Python objects at the same time.
SLICE = 256
#: Rows that Spark sends to Python at a time. Spark's own default of 10,000 is meant for short rows.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most ``BATCH`` rows to Python at a time; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= BATCH:
        spark.conf.set(name, str(BATCH))


def map_rows(
    df: DataFrame, columns: Sequence[Column | str], schema: str, start: Callable[[], Callable[..., tuple | list]],
    many: bool = False,
) -> DataFrame:
    """Call a function on each row's ``columns``; it returns a row of ``schema``, or a list of rows with ``many``.

    ``start`` runs once per task and returns that function. Only ``SLICE`` rows are held as Python
    objects, so memory follows the longest texts and not the size of a partition.
    """
    target = to_arrow_schema(T.StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                values = zip(*(c.to_pylist() for c in batch.slice(first, SLICE).columns), strict=True)
                rows = [r for v in values for r in work(*v)] if many else [work(*v) for v in values]
                if rows:
                    yield record_batch(rows, target)

    chosen = [c if isinstance(c, Column) else F.col(c) for c in columns]
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(chosen))).mapInArrow(run, schema)  # names may repeat


def record_batch(rows: list[Any], target: pa.Schema) -> pa.RecordBatch:
    """Rows (tuples in the order of the schema) as one Arrow batch."""
    arrays = [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), target, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def free_name(wanted: str, taken: Sequence[str]) -> str:
    """A column name that is not taken (in any case of its letters)."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def octets(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column."""
    return F.col(name).cast("binary").alias(name)


#: Paths written by ``stored`` within the innermost ``scratch`` block.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: it is computed once, and lost executors cost nothing.

    Within a ``scratch`` block the table goes with the block; else it stays as long as the shared folder.
    """
    path = scratch_path(df.sparkSession, label)
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written, with the folder made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` inside are deleted at the end, also after an error. Nothing lazy may still need them."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get() or []
        _written.reset(token)
        for path in paths:
            removed(spark, path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that ``make`` returns, stored; all that it has stored on the way is deleted."""
    with scratch(spark):
        found = make()
        path = scratch_path(spark, label)
        found.write.parquet(path)
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    return spark.read.schema(found.schema).parquet(path)
