"""Exact nearest neighbours of many questions by pivots.

Vectors of length one have a Euclidean distance d with d * d / 2 = 1 - cosine, so the triangle inequality holds for what
is ranked. Rows are put into blocks around their nearest pivot; a block keeps the least and the largest distance of its
rows to every pivot, which bounds their distance to a question from below. Blocks that can't hold one of the ``k`` nearest
are not compared. Where vectors have no clusters (independent draws in many dimensions), few blocks can be left out.

Blocks are dealt into parts and questions into chunks of a bounded size. Spark brings each part and chunk together; a task
bounds and compares them as matrices and keeps ``k`` rows a question, so that pairs are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.functions.bounded import column_ref, small_rows
from tabscope.operators.vectors import NEIGHBOURS, cosine_distance

#: Pivots, rows drawn by hash from which they are chosen, rows of a block, and the width of a ring around a pivot.
PIVOTS, DRAWN, BLOCK_ROWS, RING = 16, 1024, 4096, 0.1
#: More than the rounding of a distance: a block this close to the bound is compared.
SLACK = 1e-6
#: More than the rounding of a matrix product: rows this close to the k-th are measured exactly.
ROUNDING = 1e-11
#: Numbers in the vectors of a part or chunk, questions compared at a time, and pairs measured exactly at a time.
NUMBERS, ASKED, MEASURED = 1 << 19, 256, 1 << 15
#: Stand for distances that are NaN and null; all others are 2 at most, up to rounding.
IS_NAN, IS_NULL = 3.0, 4.0

BLOCK = ["cell", "ring", "portion"]


def _unit(vectors: Sequence) -> np.ndarray:
    """Vectors of length one; null and zero vectors are NaN."""
    width = next((len(v) for v in vectors if v is not None), 0)
    rows = np.array([np.full(width, np.nan) if v is None else v for v in vectors], np.float64).reshape(len(vectors), width)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, np.nan)


def choose_pivots(store: DataFrame, key: str = "id", embedding: str = "embedding", pivots: int = PIVOTS) -> np.ndarray:
    """Pivots far from each other among at most ``DRAWN`` rows drawn by a hash of the key. Results don't depend on them."""
    drawn = store.orderBy(F.xxhash64(column_ref(key)), column_ref(key)).limit(DRAWN).select(column_ref(embedding))
    unit = _unit([r[0] for r in small_rows(drawn)])
    unit = unit[~np.isnan(unit).any(axis=1)] if unit.size else unit
    chosen: list[int] = []
    nearest = np.full(len(unit), np.inf)
    while len(chosen) < min(pivots, len(unit)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, 1 - unit @ unit[chosen[-1]])
    return unit[chosen]


def _distances(pivots: np.ndarray, vector: Column) -> Column:
    """Distances to all pivots; null for a vector without direction."""

    def measure(vectors: pd.Series) -> pd.Series:
        unit = _unit(vectors.tolist())
        if not pivots.size or not unit.size:
            return pd.Series([None] * len(vectors))
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * unit @ pivots.T))
        return pd.Series([None if np.isnan(row[0]) else row for row in away])

    return F.pandas_udf(measure, "array<double>")(vector)


def pivot_blocks(
    store: DataFrame, pivots: np.ndarray, on: Sequence[str] = (), key: str = "id", embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The store's ``on``, key and vector columns with their block: ``cell, ring, portion`` and the distances ``away``.

    Cell and ring follow from the row's nearest pivot and its distance; what is larger than ``block_rows`` is cut into
    portions by a hash of the key, so a hot cell is many blocks. May be written and used for many calls.
    """
    placed = store.select(*[column_ref(c) for c in (*on, key, embedding)], _distances(pivots, column_ref(embedding)).alias("away"))
    closest = F.array_min("away")
    placed = placed.withColumns({
        # rows without direction are the cell -1
        "cell": F.coalesce(F.array_position("away", closest).cast("int") - 1, F.lit(-1)),
        "ring": F.coalesce(F.floor(closest / RING).cast("int"), F.lit(0)),
    })
    groups = [*on, "cell", "ring"]
    sizes = placed.groupBy(*[column_ref(c) for c in groups]).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts_"))
    same = [column_ref(c).eqNullSafe(F.col(f"s_{i}")) for i, c in enumerate(groups)]
    sizes = sizes.select(*[column_ref(c).alias(f"s_{i}") for i, c in enumerate(groups)], "parts_")
    return placed.join(sizes, reduce(lambda a, b: a & b, same)).select(
        *placed.columns, F.pmod(F.xxhash64(column_ref(key)), F.col("parts_")).cast("int").alias("portion")
    )


def _bounds(asked: np.ndarray, low: np.ndarray, high: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """What the distances of questions (rows) to the rows of blocks (columns) are at least; infinite without direction."""
    lower = np.zeros((len(asked), len(cell)))
    for j in range(asked.shape[1]):
        away = asked[:, j, None]
        np.maximum(lower, away - high[:, j], out=lower)
        np.maximum(lower, low[:, j] - away, out=lower)
    lower[:, cell < 0] = np.inf
    lower[np.isnan(asked).any(axis=1) | (not asked.shape[1])] = np.inf
    return lower


def _matrix(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles, and which of them are null (as those with a null or another length are)."""
    whole = vectors.combine_chunks()
    usable = pc.fill_null(pc.equal(pc.list_value_length(whole), width), False).to_numpy(zero_copy_only=False)
    if whole.flatten().null_count:
        usable &= np.array([v.is_valid and not v.values.null_count for v in whole], bool)
    rows = np.full((len(whole), width), np.nan)
    if width and usable.any():
        rows[usable] = whole.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return rows, ~usable


def _in_sequence(products: np.ndarray) -> np.ndarray:
    """Sums from left to right, to the last bit those of ``cosine_distance``."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _first_blocks(blocks: pa.Table, asked: pa.Table, pivots: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, block, bound) numbers of the closest blocks of each question that hold ``k`` rows together."""
    order = np.lexsort([blocks[c].to_numpy() for c in reversed(BLOCK)])
    blocks = blocks.take(order)
    (low, _), (high, _), (away, _) = (_matrix(t[c], pivots) for t, c in ((blocks, "low_"), (blocks, "high_"), (asked, "asked_")))
    cell, n = blocks["cell"].to_numpy(), blocks["n"].to_numpy()
    found = []
    for first in range(0, len(away), ASKED):
        lower = _bounds(away[first : first + ASKED], low, high, cell)
        nearest = np.argsort(lower, axis=1, kind="stable")[:, :k]  # every block has a row, so k blocks are enough
        before = np.cumsum(n[nearest], axis=1) - n[nearest]
        ask, place = np.nonzero(before < k)
        block = nearest[ask, place]
        found.append((ask + first, order[block], lower[ask, block]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _nearest_rows(rows: pa.Table, asked: pa.Table, pivots: int, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Questions against the blocks of a part within their reach.

    Keys, question numbers and distances of the ``k`` nearest rows of each question, and how many rows each was compared with.
    """
    rows = rows.take(np.lexsort([rows[c].to_numpy() for c in ("row_", *reversed(BLOCK))]))
    blocks = np.column_stack([rows[c].to_numpy() for c in BLOCK])
    begins = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[begins, len(blocks)])
    away, _ = _matrix(rows["away"], pivots)
    low, high = (f.reduceat(away, begins, axis=0) for f in (np.minimum, np.maximum))
    block_of, place = np.repeat(np.arange(len(begins)), sizes), rows["row_"].to_numpy()

    width = next((len(v) for t, c in ((rows, "vector_"), (asked, "question_vector")) for v in t[c] if v.is_valid), 0)
    x, x_null = _matrix(rows["vector_"], width)
    q, q_null = _matrix(asked["question_vector"], width)
    # of equal vectors only the first k by key can be in a result
    _, same = np.unique(np.ascontiguousarray(np.column_stack([x, x_null])).view(f"V{8 * (width + 1)}").ravel(), return_inverse=True)
    by_key = np.lexsort((place, same))
    starts = np.r_[0, np.cumsum(np.bincount(same))[:-1]]
    kept = np.sort(by_key[np.arange(len(same)) - starts[same[by_key]] < k])
    x, x_null, place, block_of = x[kept], x_null[kept], place[kept], block_of[kept]
    edges = np.searchsorted(block_of, np.arange(len(begins) + 1))

    x_length, q_length = (np.sqrt(_in_sequence(m * m)) for m in (x, q))
    x_unit, q_unit = (m / np.where(n > 0, n, np.nan)[:, None] for m, n in ((x, x_length), (q, q_length)))
    asked_away, _ = _matrix(asked["asked_"], pivots)
    reach, far = asked["reach_"].to_numpy(), asked["far_"].to_numpy()
    compared, found = np.zeros(len(q), np.int64), []
    for first in range(0, len(q), ASKED):
        some = slice(first, first + ASKED)
        needed = _bounds(asked_away[some], low, high, blocks[begins, 0]) <= reach[some, None]
        compared[some] = needed @ sizes
        about = np.full((len(needed), len(x)), np.inf)
        for b in np.flatnonzero(needed.any(axis=0)):
            ask, cut = np.flatnonzero(needed[:, b]), slice(edges[b], edges[b + 1])
            about[ask, cut] = 1.0 - q_unit[some][ask] @ x_unit[cut].T
        without = np.isnan(about)
        if without.any():
            ask, row = np.nonzero(without)
            null = q_null[some][ask] | x_null[row] | (q_length[some][ask] * x_length[row] == 0)
            about[ask, row] = np.where(null, IS_NULL, IS_NAN)
        last = np.partition(about, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(needed), IS_NULL)
        last = np.minimum(np.minimum(last, far[some]), IS_NULL)
        near = about <= last[:, None] + ROUNDING
        for i in np.flatnonzero(last >= IS_NAN):  # many rows may have no distance: of those the first by key
            tied = np.flatnonzero(near[i] & (about[i] >= last[i]))
            near[i, tied[np.argsort(place[tied], kind="stable")[k:]]] = False
        ask, row = np.nonzero(near)
        value = about[ask, row]
        measured = np.flatnonzero(value < IS_NAN)
        for at in range(0, len(measured), MEASURED):
            m = measured[at : at + MEASURED]
            a, b = ask[m] + first, row[m]
            value[m] = 1.0 - _in_sequence(x[b] * q[a]) / (q_length[a] * x_length[b])
        order = np.lexsort((place[row], value, ask))
        ask, row, value = ask[order], row[order], value[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        best = rank < k
        found.append((ask[best] + first, kept[row[best]], value[best]))
    ask, row, value = (np.concatenate(c) for c in zip(*found, strict=True))
    return rows["key_"].take(pa.array(row)), ask, value, compared


def _together(
    rows: DataFrame, asked: DataFrame, all_asked: DataFrame, on: Sequence[str], held: int, order_by: Sequence[str],
    work: Callable[[pa.Table, pa.Table], dict], schema: T.StructType,
) -> DataFrame:
    """Call a function on each part of the rows with each chunk of the questions of their group, both of about ``held`` rows.

    A block is in one part; ``row_`` is a row's place in its part in the order of ``order_by``. ``all_asked`` is counted for the
    chunks: ``asked`` may come from it by long work.
    """
    names, target = [column_ref(c) for c in on], to_arrow_schema(schema)

    def renewed(table: DataFrame, columns: Sequence[str]) -> DataFrame:
        return table.select(*[column_ref(c).alias(c) for c in columns])  # both sides come from the same tables

    many = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / held)).cast("int")
    parts, chunks = rows.groupBy(*names).agg(many.alias("parts_")), all_asked.groupBy(*names).agg(many.alias("chunks_"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(renewed(right, right.columns), list(on)) if on else left.crossJoin(renewed(right, right.columns))

    grid = joined(parts, chunks)
    dealt = joined(rows, grid).withColumn("part_", F.pmod(F.xxhash64(*BLOCK), F.col("parts_")).cast("int"))
    if order_by:
        place = Window.partitionBy(*names, "part_").orderBy(*order_by)
        dealt = dealt.withColumn("row_", F.row_number().over(place))
    dealt = dealt.withColumn("chunk_", F.explode(F.sequence(F.lit(0), F.col("chunks_") - 1)))
    heard = joined(asked, grid).withColumns({
        "chunk_": F.pmod(F.xxhash64("asked_key_"), F.col("chunks_")).cast("int"),
        "part_": F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)),
    })

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        found = work(left, right)
        return pa.table([found[f.name] for f in target], names=target.names).cast(target)

    groups = [*names, F.col("part_"), F.col("chunk_")]
    dealt = renewed(dealt, [c for c in dealt.columns if c not in ("parts_", "chunks_")])
    heard = renewed(heard, [c for c in heard.columns if c not in ("parts_", "chunks_")])
    return dealt.groupBy(*groups).cogroup(heard.groupBy(*groups)).applyInArrow(run, schema)


def nearest_by_pivots(
    blocked: DataFrame, pivots: np.ndarray, questions: DataFrame, on: Sequence[str], question_key: str,
    k: int = NEIGHBOURS, key: str = "id", embedding: str = "embedding",
) -> DataFrame:
    """(question_key, rank, key, distance, n_compared): the same rows as ``nearest_each``, with fewer comparisons.

    ``blocked`` comes from ``pivot_blocks`` with the same pivots. A question (question_key, question_vector, the ``on``
    columns) is first compared with its closest blocks that hold ``k`` rows; their k-th distance decides which other
    blocks are compared. ``n_compared`` counts the rows that were. Null distances come last, ties go to the smaller key.
    """
    numbers = len(pivots)
    held = max(1, NUMBERS // (pivots.shape[1] if pivots.size else 1024))
    groups = [column_ref(c) for c in on]
    rows = blocked.select(*groups, *BLOCK, column_ref(key).alias("key_"), column_ref(embedding).alias("vector_"), "away")
    asked = questions.select(
        *groups, column_ref(question_key).alias("asked_key_"), "question_vector",
        _distances(pivots, F.col("question_vector")).alias("asked_"),
    ).where("asked_key_ IS NOT NULL")
    blocks = rows.groupBy(*groups, *BLOCK).agg(
        F.count(F.lit(1)).alias("n"), *[
            F.array(*[f(F.col("away")[j]) for j in range(numbers)]).cast("array<double>").alias(name)
            for name, f in (("low_", F.min), ("high_", F.max))
        ],
    )

    def closest(table: pa.Table, heard: pa.Table) -> dict:
        ask, block, lower = _first_blocks(table, heard, numbers, k)
        ask, block = pa.array(ask), pa.array(block)
        return {
            **{c: heard[c].take(ask) for c in (*on, "asked_key_", "question_vector")},
            **{c: table[c].take(block) for c in (*BLOCK, "n")}, "lower_": pa.array(lower),
        }

    def nearest(table: pa.Table, heard: pa.Table) -> dict:
        keys, ask, distance, compared = _nearest_rows(table, heard, numbers, k)
        known = pa.array(np.where(distance == IS_NAN, np.nan, distance), mask=distance == IS_NULL)
        asks, none = pa.array(np.r_[ask, np.arange(len(compared))]), len(compared)
        return {  # the rows, and what was compared: a row for each question
            "asked_key_": heard["asked_key_"].take(asks), "outside_": heard["outside_"].take(asks),
            "key_": pa.chunked_array([*keys.chunks, pa.nulls(none, keys.type)]),
            "distance": pa.chunked_array([known, pa.nulls(none, pa.float64())]),
            "n_": pa.chunked_array([pa.nulls(len(ask), pa.int64()), pa.array(compared)]),
        }

    first = _together(blocks, asked, asked, on, held, [], closest, T.StructType(
        [T.StructField(c, asked.schema[c].dataType) for c in (*on, "asked_key_", "question_vector")]
        + T.StructType.fromDDL("cell int, ring int, portion int, n long, lower_ double").fields
    ))
    own = Window.partitionBy("asked_key_")
    nearer = own.orderBy("lower_", *BLOCK)
    earlier = nearer.rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("place_", F.row_number().over(nearer)).where(F.col("place_") <= k)
    first = first.withColumn("before_", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before_") < k)
    first = first.withColumn("first_", F.collect_list(F.struct("lower_", "n")).over(own))
    pairs = first.drop("n").join(rows, [*on, *BLOCK])
    measured = pairs.select("asked_key_", "first_", "key_", cosine_distance(F.col("vector_"), F.col("question_vector")).alias("distance"))
    by_distance = [F.col("distance").asc_nulls_last(), F.col("key_")]
    best = measured.withColumn("rank", F.row_number().over(own.orderBy(*by_distance))).where(F.col("rank") <= k)
    bound = best.groupBy("asked_key_").agg(
        F.count("distance").alias("found_"), F.max("distance").alias("far_"), F.first("first_").alias("first_"),
    )
    whole = (F.col("found_") == k) & ~F.isnan("far_")
    reach = F.when(whole, F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("far_"))) + SLACK).otherwise(float("inf"))
    bound = bound.select(
        "asked_key_", reach.alias("reach_"), F.when(whole, F.col("far_")).otherwise(float("inf")).alias("far_"), "first_"
    ).withColumn("outside_", F.aggregate(
        F.filter("first_", lambda b: b["lower_"] > F.col("reach_")), F.lit(0).cast("long"), lambda n, b: n + b["n"],
    ))
    found = _together(rows, asked.join(bound.drop("first_"), "asked_key_"), asked, on, held, ["key_"], nearest, T.StructType(
        [T.StructField("asked_key_", asked.schema["asked_key_"].dataType), T.StructField("key_", rows.schema["key_"].dataType)]
        + T.StructType.fromDDL("outside_ long, distance double, n_ long").fields
    ))
    ranked = found.withColumns({
        "rank": F.row_number().over(own.orderBy(F.col("n_").isNotNull(), *by_distance)),
        "n_compared": F.sum("n_").over(own) + F.max("outside_").over(own),
    })
    return ranked.where(F.col("n_").isNull() & (F.col("rank") <= k)).select(
        F.col("asked_key_").alias(question_key), "rank", F.col("key_").alias(key), "distance", "n_compared"
    )
