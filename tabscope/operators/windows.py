"""Window functions over keys of any size: states are carried over range partitions, so no key is ever in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import column_ref, pin, small_rows
from tabscope.operators.asof import ROW_BITS, by_part, range_sorted

RANKS = ("row_number", "rank", "dense_rank")
#: Aggregates of running and short frames: how a column is aggregated, and how two such results are put together.
AGGREGATES = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}
#: Over short frames also these.
FRAMES = {**{name: f for name, (f, _) in AGGREGATES.items()}, "avg": F.avg}


def windowed(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    descending: Sequence[str] = (),
    ranks: Mapping[str, str] | None = None,
    running: Mapping[str, tuple[str, str]] | None = None,
    frames: Mapping[str, tuple[str, str, int, int]] | None = None,
) -> DataFrame:
    """All columns, and a new one for each name in ``ranks``, ``running`` and ``frames``.

    ``ranks`` maps a name to ``row_number``, ``rank`` or ``dense_rank``; ``running`` to an aggregate (sum, count, min, max)
    and its column, over the rows of a key up to the current one; ``frames`` to an aggregate (also avg), its column, and
    the numbers of rows before and after the current one. Columns in ``descending`` are ordered so. Nulls make one key,
    and come first where the order ascends. Rows that tie are ordered by all their columns, so these must be orderable.

    The table is laid out once in the order of keys and rows, over range partitions. A partition leaves one row: the state of
    its last key, which is put together with those before it and handed to the next partition. Rows at the edges of a
    partition, as many as the longest frame, are copied to its neighbours.
    """
    ranks, running, frames = ranks or {}, running or {}, frames or {}
    _check(df, ranks, running, frames)
    order = F.struct(*[column_ref(c) for c in order_by])
    keyed = df.select(
        F.struct(*[column_ref(c) for c in by]).alias("by_"), order.alias("order_"),
        F.struct(*[column_ref(c) for c in df.columns]).alias("data_"),
    )
    places = [F.col("order_")[c] for c in order_by]
    rows, number = range_sorted(keyed, [
        "by_", *(p.desc() if c in descending else p.asc() for c, p in zip(order_by, places, strict=True)), "data_",
    ])
    states = {n: (kind, F.col("data_")[c]) for n, (kind, c) in running.items()}
    parts = pin(_parts(rows, states))  # a row for each partition
    starts = F.broadcast(parts.select("part_", "start_"))
    position = F.col("start_") + F.col("row_").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = rows.join(starts, "part_").select("part_", "by_", "order_", "data_", position.alias("g_"), F.lit(True).alias("own_"))
    if frames:
        before, after = (max(f[i] for f in frames.values()) for i in (2, 3))
        placed = placed.unionByName(_edges(placed, parts, before, after))

    inside = Window.partitionBy("part_", "by_")
    so_far = inside.orderBy("g_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = by_part(placed, number).join(F.broadcast(_handed(parts, states)), ["part_", "by_"], "left")
    columns: dict[str, Column] = {}
    if ranks:
        same = F.col("order_").eqNullSafe(F.col("carried_.order")) & F.col("carried_").isNotNull()
        tie = F.when(same, F.col("carried_.tie")).otherwise(F.min("g_").over(Window.partitionBy("part_", "by_", "order_")))
        joined = joined.withColumns({
            "tie_": tie, "first_": F.coalesce("carried_.first", F.min("g_").over(inside)),
        })
        fresh = F.sum(F.when(F.col("own_") & (F.col("g_") == F.col("tie_")), 1).otherwise(0)).over(so_far)
        found = {
            "row_number": F.col("g_") - F.col("first_") + 1, "rank": F.col("tie_") - F.col("first_") + 1,
            "dense_rank": F.coalesce("carried_.ties", F.lit(0)) + fresh,
        }
        columns |= {n: found[kind] for n, kind in ranks.items()}
    for n, (kind, value) in states.items():
        aggregate, together = AGGREGATES[kind]
        columns[n] = together(F.col("carried_.states")[n], aggregate(F.when(F.col("own_"), value)).over(so_far))
    for n, (kind, c, back, ahead) in frames.items():
        columns[n] = FRAMES[kind](F.col("data_")[c]).over(inside.orderBy("g_").rowsBetween(-back, ahead))
    result = joined.select("own_", "data_", *[c.alias(f"w{i}_") for i, c in enumerate(columns.values())])
    return result.where("own_").select(
        *[F.col("data_")[c].alias(c) for c in df.columns], *[F.col(f"w{i}_").alias(n) for i, n in enumerate(columns)]
    )


def _check(df: DataFrame, ranks: Mapping, running: Mapping, frames: Mapping) -> None:
    names = [*df.columns, *ranks, *running, *frames]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a new column has the name of another one")
    unknown = {*ranks.values()} - {*RANKS} | {r[0] for r in running.values()} - {*AGGREGATES} | {f[0] for f in frames.values()} - {*FRAMES}
    if unknown:
        raise ValueError(f"unknown window functions: {sorted(unknown)}")
    if any(f[2] < 0 or f[3] < 0 for f in frames.values()):
        raise ValueError("frames have numbers of rows from 0")


def _parts(rows: DataFrame, states: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(part_, start_, size_, last_): where a partition starts among all rows, its rows, and the state of its last key.

    The state has the key, its first and last place in the order, where the last tie starts, how many ties there are, and
    the running aggregates.
    """
    aggregates = [AGGREGATES[kind][0](value).alias(f"s{i}_") for i, (kind, value) in enumerate(states.values())]
    ties = rows.groupBy("part_", "by_", "order_").agg(
        F.min("row_").alias("begin_"), F.max("row_").alias("end_"), F.count("*").alias("n_"), *aggregates
    )
    merged = [
        (F.sum if kind in ("sum", "count") else AGGREGATES[kind][0])(f"s{i}_").alias(name)
        for i, (name, (kind, _)) in enumerate(states.items())
    ]
    keys = ties.groupBy("part_", "by_").agg(
        F.min("begin_").alias("begin"), F.max("end_").alias("end"), F.sum("n_").alias("n"), F.count("*").alias("ties"),
        F.min_by("order_", "begin_").alias("first_order"), F.max_by("order_", "begin_").alias("order"),
        F.max("begin_").alias("tie"), *[m.alias(f"s{i}_") for i, m in enumerate(merged)],
    )
    state = F.struct(
        "by_", "begin", "ties", "first_order", "order", "tie",
        F.struct(F.lit(0).alias("none_"), *[F.col(f"s{i}_").alias(n) for i, n in enumerate(states)]).alias("states"),
    )
    parts = keys.groupBy("part_").agg(F.sum("n").alias("size_"), F.max_by(state, "end").alias("last_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    return parts.withColumn("start_", F.coalesce(F.sum("size_").over(earlier), F.lit(0)))


def _handed(parts: DataFrame, states: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(part_, by_, carried_): what the partitions before one tell of its first key."""
    key = Window.partitionBy("by_").orderBy("part_")
    to_here = key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (1 << ROW_BITS) - 1
    known = parts.select("part_", "start_", "last_.*")
    goes_on = F.coalesce(F.lag("order").over(key).eqNullSafe(F.col("first_order")) & (F.row_number().over(key) > 1), F.lit(False))
    known = known.withColumn("goes_on", goes_on)
    tie = F.when((F.col("ties") > 1) | ~F.col("goes_on"), F.col("start_") + F.col("tie").bitwiseAND(F.lit(place)))
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    carried = F.struct(
        F.min(F.col("start_") + F.col("begin").bitwiseAND(F.lit(place))).over(to_here).alias("first"),
        F.last(tie, ignorenulls=True).over(to_here).alias("tie"), "order",
        F.sum(F.col("ties") - F.col("goes_on").cast("int")).over(to_here).alias("ties"),
        F.struct(F.lit(0).alias("none_"), *[merge[kind](F.col("states")[n]).over(to_here).alias(n) for n, (kind, _) in states.items()]).alias("states"),
    )
    follower = F.lead("part_").over(Window.orderBy("part_"))
    return known.select(follower.alias("part_"), "by_", carried.alias("carried_")).where("part_ IS NOT NULL")


def _edges(placed: DataFrame, parts: DataFrame, before: int, after: int) -> DataFrame:
    """Copies of the rows that frames of other partitions reach, under the partitions' numbers."""
    ranges = sorted((r["start_"], r["start_"] + r["size_"], r["part_"]) for r in small_rows(parts.select("part_", "start_", "size_")))
    reached = []
    for i, (start, end, part) in enumerate(ranges):
        targets = []
        for step in (1, -1):
            j = i + step
            while 0 <= j < len(ranges) and ranges[j][0] - before < end and ranges[j][1] + after > start:
                targets.append(ranges[j])
                j += step
        reached += [(part, target, low - before, high + after) for low, high, target in targets]
    table = placed.sparkSession.createDataFrame(reached, "part_ long, target_ long, low_ long, high_ long")
    near = placed.join(F.broadcast(table), "part_").where("g_ >= low_ AND g_ < high_")
    return near.select(F.col("target_").alias("part_"), "by_", "order_", "data_", "g_", F.lit(False).alias("own_"))
