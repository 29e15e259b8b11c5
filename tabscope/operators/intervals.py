"""Joining points with the intervals that hold them, by bins instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.bounded import column_ref, small_rows

#: Bins of a level are this many times as wide as those of the level below, as a power of two.
STEP = 2
#: Bin numbers up to this size are exact.
LARGEST_BIN = float(2**52)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Rows of ``points`` with each interval that has low <= point < high.

    Bins have levels: an interval is listed at the level whose bins are as long as itself or longer, so in two bins at
    most; a point is in one bin of each level that occurs (a few, as lengths of a kind share a level). Intervals with an
    infinite end, or too short for their distance from zero, are in one bin with all points; rows of that bin are dealt
    over all partitions. Null ends, NaN and points match nothing, nor do intervals that end where they start.
    """
    value, start, end = (column_ref(c).cast("double") for c in (point, low, high))
    length = end - start
    finite = (length > 0) & (length < float("inf"))
    level = F.when(finite, (F.ceil(F.log2(length) / STEP) * STEP).cast("int"))
    fits = (F.greatest(F.abs(start), F.abs(end)) / F.pow(F.lit(2.0), level.cast("double"))) < LARGEST_BIN
    usable = ~F.isnan(start) & ~F.isnan(end) & (start < end)
    listed = intervals.where(usable).withColumn("level_", F.when(fits, level))
    first, last = (_bin(x, F.col("level_")) for x in (start, end))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    listed = listed.withColumn("bin_", F.explode(F.when(F.col("level_").isNull(), everywhere).otherwise(F.array_distinct(F.array(first, last)))))
    # at most one row for each exponent of a double
    levels = [r["level_"] for r in small_rows(listed.select("level_").distinct())]
    own = [F.struct(F.lit(x).cast("int").alias("level_"), _bin(value, F.lit(x)).alias("bin_")) for x in levels if x is not None]
    if None in levels:
        dealt = F.pmod(F.xxhash64(*[column_ref(c) for c in points.columns]), F.lit(parts))
        own.append(F.struct(F.lit(None).cast("int").alias("level_"), dealt.alias("bin_")))
    places = F.array(*own) if own else F.expr("array_remove(array(named_struct('level_', 0, 'bin_', 0L)), named_struct('level_', 0, 'bin_', 0L))")
    placed = points.where(value.isNotNull() & ~F.isnan(value)).withColumn("place_", F.explode(places)).select(
        *[column_ref(c) for c in points.columns], F.coalesce("place_.level_", F.lit(ROOT)).alias("level_"), F.col("place_.bin_").alias("bin_")
    )
    listed = listed.withColumn("level_", F.coalesce("level_", F.lit(ROOT)))
    return placed.join(listed, ["level_", "bin_"]).where((value >= start) & (value < end)).drop("level_", "bin_")


#: The level of the bin that holds everything; no double has such an exponent.
ROOT = 1_000_000


def _bin(value: Column, level: Column) -> Column:
    """The number of a value's bin; a value too far out for the level is in the outermost one, where no interval is."""
    place = F.floor(value / F.pow(F.lit(2.0), level.cast("double")))
    return F.when(F.abs(value / F.pow(F.lit(2.0), level.cast("double"))) < 2 * LARGEST_BIN, place).otherwise(F.lit(int(4 * LARGEST_BIN))).cast("long")
