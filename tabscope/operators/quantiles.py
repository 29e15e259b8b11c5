"""Exact quantiles by narrowing, without sorting a column.

A sketch gives, for every wanted rank, two values that should enclose it. One counting pass
then groups each column into what lies below, at and above these values, with the few values
in between counted one by one, and the ranks are read off the counts. The sketch only guides
the search: a rank found outside of its two values is sought on where it was found. For very
large columns the values in between are first narrowed by a second sketch.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import local_table, small_rows
from tabscope.operators.columns import as_double, unpivot_groups

INSIDE_LIMIT = 200_000
SKETCH_ACCURACY = 10_000
SKETCH_WIDTH = 6.0 / SKETCH_ACCURACY  # share of the rows between the two values, error included

BELOW, AT_LOW, INSIDE, AT_HIGH = range(4)


@dataclass
class _Gap:
    """An open interval of a column, with the ranks that are sought in it."""

    column: str
    ranks: list[int]
    below: int  # rows at or under ``low``
    size: int  # rows strictly between
    low: float | None = None
    high: float | None = None


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    inside_limit: int = INSIDE_LIMIT,
) -> dict[tuple[str, int], float]:
    """The values at the given 0-based ranks among the non-null values of each column."""
    found: dict[tuple[str, int], float] = {}
    gaps = [_Gap(c, sorted(set(r)), 0, counts[c]) for c, r in ranks.items() if r and counts[c]]
    while gaps:
        wide = [g for g in gaps if g.size > max(inside_limit, 1)]
        narrow = [g for g in gaps if g.size <= max(inside_limit, 1)]
        by_value = all(g.size * SKETCH_WIDTH <= max(inside_limit, SKETCH_ACCURACY) for g in wide)
        intervals: dict[str, list[_Gap]] = {}
        for g in narrow + _enclose(df, wide, found):
            intervals.setdefault(g.column, []).append(g)
        gaps = _locate(df, {c: _merged(i) for c, i in intervals.items()}, by_value, found) if intervals else []
    return found


def _enclose(df: DataFrame, gaps: list[_Gap], found: dict) -> list[_Gap]:
    """For every rank in the gaps, the two sketched values around it."""
    if not gaps:
        return []
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, g in enumerate(gaps):
        at = [(r - g.below + 0.5) / g.size for r in g.ranks]
        shares = [edge for p in at for edge in (max(0.0, p - margin), min(1.0, p + margin))]
        value, inside = as_double(g.column), F.lit(True)
        if g.low is not None:
            inside = inside & (value > g.low)
        if g.high is not None:
            inside = inside & (value < g.high)
        sketches.append(F.percentile_approx(F.when(inside, value), shares, SKETCH_ACCURACY).alias(f"e{i}"))
    sketched = df.agg(*sketches).first()
    enclosed = []
    for i, g in enumerate(gaps):
        for k, rank in enumerate(g.ranks):
            low, high = sketched[i][2 * k:2 * k + 2]
            if math.isnan(low):  # NaN sorts last: nothing lies above it
                found[g.column, rank] = low
            else:
                enclosed.append(_Gap(g.column, [rank], 0, 0, low, None if math.isnan(high) else high))
    return enclosed


def _merged(intervals: list[_Gap]) -> list[_Gap]:
    """Disjoint intervals in ascending order."""
    lowest, highest = -math.inf, math.inf
    result: list[_Gap] = []
    for g in sorted(intervals, key=lambda g: (lowest if g.low is None else g.low)):
        last = result[-1] if result else None
        if last is not None and (lowest if g.low is None else g.low) <= (highest if last.high is None else last.high):
            unbounded = last.high is None or g.high is None
            last.high = None if unbounded else max(last.high, g.high)
            last.ranks = sorted({*last.ranks, *g.ranks})
        else:
            result.append(_Gap(g.column, list(g.ranks), 0, 0, g.low, g.high))
    return result


def _region(value: Column, intervals: list[_Gap]) -> Column:
    """Where a value lies: 4j below interval j, 4j+1 at its low, 4j+2 inside, 4j+3 at its high."""
    region = F.when(value.isNull(), F.lit(None).cast("int"))
    for j, g in enumerate(intervals):
        if g.low is not None:
            region = region.when(value < g.low, 4 * j + BELOW).when(value == g.low, 4 * j + AT_LOW)
        if g.high is None:
            return region.otherwise(4 * j + INSIDE)
        region = region.when(value < g.high, 4 * j + INSIDE).when(value == g.high, 4 * j + AT_HIGH)
    return region.otherwise(4 * len(intervals))


def _locate(df: DataFrame, intervals: dict[str, list[_Gap]], by_value: bool, found: dict) -> list[_Gap]:
    """One counting pass: ranks that it settles go to ``found``, the others are returned."""
    columns = list(intervals)
    places = range(len(columns))
    # each step is a projection of its own, so that a value and its region are computed once
    values = df.select(*[as_double(c).alias(f"x{i}") for i, c in enumerate(columns)])
    regions = values.select("*", *[_region(F.col(f"x{i}"), intervals[c]).alias(f"r{i}") for i, c in enumerate(columns)])
    inside = [
        F.when(F.col(f"r{i}") % 4 == INSIDE, F.col(f"x{i}")) if by_value else F.lit(None).cast("double") for i in places
    ]
    cells = regions.select(*[f"r{i}" for i in places], *[cell.alias(f"v{i}") for i, cell in enumerate(inside)])
    counted = (
        unpivot_groups(cells, [(f"r{i}", f"v{i}") for i in places], ("region", "value"), "column_no")
        .where(F.col("region").isNotNull())
        .groupBy("column_no", "region", "value").count()
    )
    # a column arrives here as a few regions and the values counted inside the intervals
    upto = Window.partitionBy("column_no").orderBy("region", "value").rowsBetween(Window.unboundedPreceding, 0)
    sought = F.array(*[F.array(*[F.lit(r) for g in intervals[c] for r in g.ranks]) for c in columns])
    hits = counted.withColumn("last", F.sum("count").over(upto) - 1).select(
        "*", F.explode(F.element_at(sought, F.col("column_no") + 1)).alias("rank")
    ).where((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("count")))
    open_gaps: dict[tuple[str, int], _Gap] = {}
    for hit in small_rows(hits):
        column, rank = columns[hit["column_no"]], hit["rank"]
        j, place = divmod(hit["region"], 4)
        bounds = intervals[column]
        if place == AT_LOW:
            found[column, rank] = bounds[j].low
        elif place == AT_HIGH:
            found[column, rank] = bounds[j].high
        elif place == INSIDE and by_value:
            found[column, rank] = hit["value"]
        else:
            inside = place == INSIDE
            low = bounds[j].low if inside else (bounds[j - 1].high if j > 0 else None)
            high = bounds[j].high if inside else (bounds[j].low if j < len(bounds) else None)
            gap = open_gaps.setdefault((column, hit["region"]), _Gap(
                column, [], hit["last"] + 1 - hit["count"], hit["count"], low, high
            ))
            gap.ranks = sorted({*gap.ranks, rank})
    return list(open_gaps.values())


def ranks_for(n: int, probability: float, method: str) -> list[int]:
    """The 0-based ranks that a quantile of ``n`` values is made of."""
    if n == 0:
        return []
    if method == "nearest":
        return [math.floor((n - 1) * probability + 0.5)]
    if method == "linear":
        at = (n - 1) * probability
        return [math.floor(at), math.ceil(at)]
    raise ValueError(f"unknown quantile method: {method}")


def combine(values: Sequence[float], n: int, probability: float) -> float:
    """The quantile from the values at ``ranks_for``."""
    if len(values) == 1 or values[0] == values[-1]:
        return values[0]
    at = (n - 1) * probability
    return values[0] + (values[-1] - values[0]) * (at - math.floor(at))


def quantile_values(
    df: DataFrame,
    requests: Mapping[str, Sequence[tuple[float, str]]],
    counts: Mapping[str, int] | None = None,
    inside_limit: int = INSIDE_LIMIT,
) -> dict[tuple[str, float, str], float | None]:
    """Exact quantiles: (column, probability, method) to value, null for an empty column."""
    if counts is None:
        row = df.agg(*[F.count(as_double(c)).alias(f"n{i}") for i, c in enumerate(requests)]).first()
        counts = {c: row[i] for i, c in enumerate(requests)}
    ranks = {
        c: sorted({r for p, method in wanted for r in ranks_for(counts[c], p, method)})
        for c, wanted in requests.items()
    }
    found = order_statistics(df, ranks, counts, inside_limit)
    result: dict[tuple[str, float, str], float | None] = {}
    for c, wanted in requests.items():
        for p, method in wanted:
            at = ranks_for(counts[c], p, method)
            result[c, p, method] = combine([found[c, r] for r in at], counts[c], p) if at else None
    return result


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.75),
    method: str = "nearest",
    inside_limit: int = INSIDE_LIMIT,
) -> DataFrame:
    """(column, probability, value). ``approximate`` answers from sketches in one pass."""
    if method == "approximate":
        row = df.agg(*[
            F.percentile_approx(as_double(c), list(probabilities), SKETCH_ACCURACY).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]).first()
        rows = [
            (c, p, row[i][j] if row[i] else None)
            for i, c in enumerate(columns) for j, p in enumerate(probabilities)
        ]
    else:
        values = quantile_values(
            df, {c: [(p, method) for p in probabilities] for c in columns}, inside_limit=inside_limit
        )
        rows = [(c, p, value) for (c, p, _), value in values.items()]
    return local_table(df.sparkSession, rows, "column string, probability double, value double")
