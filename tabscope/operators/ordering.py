"""Places in an order, without sorting a table in one task and without writing it.

Two things are ordered in this library: the values of each column, and the rows by their time.

*Values.* Literal split points of each column cut its values into buckets. One pass over the wide table counts the values
of all columns by bucket; the counts of the buckets give every bucket's offset, and only the distinct values are
shuffled. A value that fills a third of a column is one row.

*Rows.* What the operators need of the order (positions, products of neighbours) is computed while each range partition
streams by, relative to the partition; a partition leaves one row for each column, and these are put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import column_ref
from tabscope.operators.columns import as_double

#: Values of a column that are counted at a time.
COUNTED = 100_000


def split_points(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float] | None]:
    """Points that split the values of each column into buckets of about equally many; they only balance the work.

    There is a bucket for each shuffle partition. A job of its own: beside a sketch, plain aggregates lose generated code.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]

    def points(c: str) -> Column:
        return F.percentile_approx(F.when(~F.isnan(as_double(c)), as_double(c)), shares, 10 * max(100, buckets))

    row = df.agg(*[points(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row, strict=True))


def value_counts_in_buckets(df: DataFrame, splits: Mapping[str, Sequence[float] | None]) -> DataFrame:
    """(column, bucket, value, count): the distinct values of each column, nulls left out; NaN is the largest."""
    columns = list(splits)
    cuts = [np.unique(np.array(splits[c] or [], float)) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in columns]
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for i, parts in enumerate(held):
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                values = values + 0.0  # one zero
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(values), i, np.int32)), pa.array(np.searchsorted(cuts[i], values, "right").astype(np.int32)),
                    pa.array(values), pa.array(counts.astype(np.int64)),
                ], names=["place", "bucket", "value", "count"])

        for batch in batches:
            for parts, column in zip(held, batch.columns, strict=True):
                parts.append(column.drop_null().to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= COUNTED:
                yield from counted()
                held[:], size = [[] for _ in columns], 0
        if size:
            yield from counted()

    wide = df.select(*[as_double(c).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = wide.mapInArrow(run, "place int, bucket int, value double, count long")
    summed = cells.groupBy("place", "bucket", "value").agg(F.sum("count").alias("count"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1)
    return summed.select(name.alias("column"), "bucket", "value", "count")


def ranked_values(df: DataFrame, splits: Mapping[str, Sequence[float] | None]) -> DataFrame:
    """(column, value, count, before): each distinct value and how many values of its column lie below it."""
    counts = value_counts_in_buckets(df, splits)
    earlier = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("column", "bucket").agg(F.sum("count").alias("size")).select(
        "column", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("running", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return running.join(offsets, ["column", "bucket"]).select(
        "column", "value", "count", (F.col("offset") + F.col("running")).alias("before")
    )


class Neighbours:
    """What a partition's values of one column tell about their order: positions, and products at each lag.

    Values are deviations from the column's mean; NaN has a position and takes part in nothing else.
    """

    def __init__(self, lags: int) -> None:
        self.lags = lags
        self.n = self.known = 0
        self.place = self.spread = self.level = self.shared = 0.0  # mean and squares of positions, mean value, products
        self.totals, self.pairs = np.zeros(lags), np.zeros(lags, np.int64)
        self.head = self.tail = np.zeros(0)

    def add(self, values: np.ndarray) -> None:
        """Append values."""
        self._moments(self.n + np.flatnonzero(~np.isnan(values)), values[~np.isnan(values)])
        self.n += len(values)
        if self.lags:
            self._products(values)

    def _moments(self, places: np.ndarray, values: np.ndarray) -> None:
        if len(values):
            place, level = float(places.mean()), float(values.mean())
            self._merge(len(values), place, float(((places - place) ** 2).sum()), level, float((places - place) @ (values - level)))

    def _merge(self, known: int, place: float, spread: float, level: float, shared: float) -> None:
        total = self.known + known
        if not total:
            return
        weight = self.known * known / total
        self.spread += spread + (place - self.place) ** 2 * weight
        self.shared += shared + (place - self.place) * (level - self.level) * weight
        self.place += (place - self.place) * known / total
        self.level += (level - self.level) * known / total
        self.known = total

    def _products(self, values: np.ndarray) -> None:
        if len(self.head) < self.lags:
            self.head = np.concatenate((self.head, values[: self.lags - len(self.head)]))
        self._cross(self.tail, values)
        self.tail = np.concatenate((self.tail, values))[-self.lags :]

    def _cross(self, before: np.ndarray, values: np.ndarray, only_across: bool = False) -> None:
        """Add the pairs whose later value is one of ``values``; the earlier one is in ``before``, or in either of them."""
        row = np.concatenate((before, values))
        known = ~np.isnan(row)
        whole = bool(known.all())
        filled = row if whole else np.where(known, row, 0.0)
        for lag in range(1, self.lags + 1):
            start, stop = max(len(before), lag), len(row)
            if only_across:
                stop = min(stop, len(before) + lag)
            if start < stop:
                self.totals[lag - 1] += filled[start - lag : stop - lag] @ filled[start:stop]
                both = known[start - lag : stop - lag] & known[start:stop] if not whole else None
                self.pairs[lag - 1] += stop - start if whole else np.count_nonzero(both)

    def follow(self, other: Neighbours) -> None:
        """Append the values of a later partition, of which only the summary is known."""
        self._merge(other.known, self.n + other.place, other.spread, other.level, other.shared)
        self.n += other.n
        if self.lags:
            self.totals += other.totals
            self.pairs += other.pairs
            self._cross(self.tail, other.head, only_across=True)
            self.tail = np.concatenate((self.tail, other.tail))[-self.lags :]


_SUMMARY = (
    "column string, part int, n long, known long, place double, spread double, level double, shared double, "
    "totals array<double>, pairs array<long>, head array<double>, tail array<double>"
)
_FIELDS = ("n", "known", "place", "spread", "level", "shared", "totals", "pairs", "head", "tail")

#: What ``in_row_order`` returns.
IN_ORDER = "column string, slope double, totals array<double>, pairs array<long>"


def in_row_order(df: DataFrame, means: Mapping[str, float], order_by: Sequence[str], lags: int = 0) -> DataFrame:
    """(column, slope, totals, pairs) of columns in the order of ``order_by``, nulls left out; a row for each column.

    ``slope`` is that of the least-squares line over positions, ``totals`` the sums of products of deviations from the
    given ``means`` at lags 1 to ``lags``, and ``pairs`` how many products each has. Rows that tie are ordered by their
    values in the columns. The table is read twice (the first time for the bounds of the ranges), its rows are shuffled
    once, and a partition of any size streams by.
    """
    columns = list(means)
    centre = [means[c] for c in columns]
    order = [column_ref(c).alias(f"o{i}") for i, c in enumerate(order_by)]
    values = [f"v{i}" for i in range(len(columns))]
    keys = [*(f"o{i}" for i in range(len(order))), *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Neighbours(lags) for _ in columns]
        for batch in batches:
            for neighbours, mean, column in zip(found, centre, batch.columns, strict=True):
                neighbours.add(column.drop_null().to_numpy(zero_copy_only=False) - mean)
        part = TaskContext.get().partitionId()
        rows = [
            {"column": c, "part": part, **{f: getattr(x, f) for f in _FIELDS[:6]}, **{f: getattr(x, f).tolist() for f in _FIELDS[6:]}}
            for c, x in zip(columns, found, strict=True) if x.n
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_summary_schema())

    def put_together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole = Neighbours(lags)
        for r in rows:
            whole.follow(_from_row(r, lags))
        slope = whole.shared / whole.spread if whole.spread > 0 else None
        return pa.Table.from_pylist(
            [{"column": rows[0]["column"], "slope": slope, "totals": whole.totals.tolist(), "pairs": whole.pairs.tolist()}],
            schema=pa.schema([("column", pa.string()), ("slope", pa.float64()), ("totals", pa.list_(pa.float64())), ("pairs", pa.list_(pa.int64()))]),
        )

    wide = df.select(*order, *[as_double(c).alias(v) for c, v in zip(columns, values, strict=True)])
    ordered = wide.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*values)
    return ordered.mapInArrow(run, _SUMMARY).groupBy("column").applyInArrow(put_together, IN_ORDER)


def _summary_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(),
             "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in _SUMMARY.split(", "))])


def _from_row(row: dict, lags: int) -> Neighbours:
    found = Neighbours(lags)
    for field in _FIELDS[:6]:
        setattr(found, field, row[field])
    for field in _FIELDS[6:]:
        setattr(found, field, np.array(row[field], np.int64 if field == "pairs" else float))
    return found
