"""As-of join: for every left row the latest right row that is not later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import column_ref
from tabscope.session import materialize


ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


#: Rows of a range partition, about; fewer rows in all are left to Spark's number of partitions.
PART_ROWS = 100_000


def range_sorted(df: DataFrame, order_by: Sequence[str | Column]) -> tuple[DataFrame, int]:
    """The rows in order over range partitions, with the partition and the row number in it.

    Their number follows the rows, so that a partition does not grow with the table; it is returned, or 0 if left to Spark.

    All order columns take part in the range split, so rows that tie on the first column are
    still spread by the next one. The table is written to reliable storage: partition numbers
    are then data and cannot change between the passes that use them.
    """
    order = [c if isinstance(c, Column) else column_ref(c) for c in order_by]
    number = -(-df.count() // PART_ROWS)
    number = number if number > 1 else 0
    numbered = (
        (df.repartitionByRange(number, *order) if number else df.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .withColumn("row_", F.monotonically_increasing_id())
    )
    return materialize(numbered).withColumn("part_", F.shiftright("row_", ROW_BITS)), number


def by_part(rows: DataFrame, number: int) -> DataFrame:
    """Rows of ``range_sorted`` laid out for windows within ``part_`` and ``by_``, over as many tasks as there are partitions.

    Left to itself, Spark puts partitions together again by their compressed size.
    """
    return rows.repartition(number, "part_", "by_") if number else rows


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    right_columns: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Left columns plus ``right_columns`` of the latest right row with equal ``by``.

    Both sides are laid out in one order over range partitions, so a key that owns a third of
    the rows spans many partitions. Within a partition the latest right row is carried
    forward; what one partition hands to the next is a row per partition. If right rows tie
    in key and time, the one that is last by ``right_columns`` is taken.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of as-of join: {how}")
    payload = F.struct(*[column_ref(c) for c in right_columns]).alias("right_")
    left_row = F.struct(*[column_ref(c) for c in left.columns]).alias("left_")
    rights = right.where(column_ref(by).isNotNull() & column_ref(right_time).isNotNull()).select(
        column_ref(by).alias("by_"), column_ref(right_time).alias("time_"), F.lit(0).alias("side_"), payload
    )
    lefts = left.select(
        column_ref(by).alias("by_"), column_ref(left_time).alias("time_"), F.lit(1).alias("side_"), left_row
    )
    both = rights.unionByName(lefts, allowMissingColumns=True)
    # the rows themselves end the order, so rows that tie in key and time still spread
    rows, number = range_sorted(both, ["by_", "time_", "side_", "right_", "left_"])

    # the latest right row of the key that a partition ends with, handed to the partitions after it
    ends = rows.groupBy("part_").agg(
        F.max_by("by_", "row_").alias("by_"),
        F.max_by(F.struct("by_", "right_"), F.when(F.col("side_") == 0, F.col("row_"))).alias("latest_"),
    ).select("part_", "by_", F.when(F.col("latest_.by_") == F.col("by_"), F.col("latest_.right_")).alias("right_"))
    handed = Window.partitionBy("by_").orderBy("part_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = ends.select("part_", "by_", F.last("right_", ignorenulls=True).over(handed).alias("carried_"))
    # one row per partition, for the next partition that has rows
    follower = F.lead("part_").over(Window.orderBy("part_"))
    incoming = carried.select(follower.alias("part_"), "by_", "carried_").where(
        F.col("part_").isNotNull() & F.col("carried_").isNotNull()
    )
    inside = Window.partitionBy("part_", "by_").orderBy("row_").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    matched = by_part(rows, number).withColumn("own_", F.last("right_", ignorenulls=True).over(inside)).where("side_ = 1")
    joined = matched.join(F.broadcast(incoming), ["part_", "by_"], "left").withColumn(
        "match_", F.coalesce("own_", "carried_")
    )
    if how == "inner":
        joined = joined.where(F.col("match_").isNotNull())
    return joined.select(
        *[F.col("left_")[c].alias(c) for c in left.columns],
        *[F.col("match_")[c].alias(c) for c in right_columns],
    )
