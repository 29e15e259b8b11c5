"""A store of described vectors: upsert, delete and exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import column_ref

NEIGHBOURS = 5
PARTS = 32


def upsert(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The store with the new rows added; a row with a known key replaces the stored one.

    If the new rows repeat a key, any one of the repeats is kept.
    """
    fresh = new.dropDuplicates([key])
    return store.join(fresh.select(column_ref(key)), key, "left_anti").unionByName(fresh)


def delete_where(store: DataFrame, condition: Column) -> DataFrame:
    """The store without the rows that satisfy the condition; unknown is not satisfied."""
    return store.where(~F.coalesce(condition, F.lit(False)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two vectors, computed in doubles within the row.

    Null if either vector has length zero: it has no direction to compare.
    """

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(
    store: DataFrame,
    vector: Sequence[float],
    where: Column | None = None,
    k: int = NEIGHBOURS,
    key: str = "id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` stored rows nearest to one vector, with their ``distance``; ties by key, null distances last.

    Every task keeps its own ``k`` best, so no sort of the store takes place.
    """
    candidates = store if where is None else store.where(where)
    question = F.array(*[F.lit(float(v)) for v in vector])
    scored = candidates.withColumn("distance", cosine_distance(column_ref(embedding), question))
    return scored.orderBy(F.col("distance").asc_nulls_last(), column_ref(key)).limit(k)


def nearest_each(
    store: DataFrame,
    questions: DataFrame,
    on: Sequence[str],
    question_key: str,
    k: int = NEIGHBOURS,
    key: str = "id",
    embedding: str = "embedding",
) -> DataFrame:
    """(question_key, rank, key, distance): nearest rows for many questions at once.

    A question (question_key, question_vector, the ``on`` columns) is compared with the rows
    that equal it in ``on``, as the metadata filter of one question would. The store's rows are
    dealt into parts by their key and each question goes to all parts, so rows that share one
    value of ``on`` are spread over tasks. Every task ranks its own rows first, so ``k`` rows per
    question and task reach the last sort. Null distances (a zero vector) come last.
    """
    part = F.pmod(F.xxhash64(column_ref(key)), F.lit(PARTS)).cast("int")
    asked = questions.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    scored = store.withColumn("part_", part).join(asked, [*on, "part_"]).select(
        column_ref(question_key), column_ref(key),
        cosine_distance(column_ref(embedding), F.col("question_vector")).alias("distance"),
    )
    order = Window.partitionBy(question_key).orderBy(F.col("distance").asc_nulls_last(), key)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(column_ref(question_key), "rank", column_ref(key), "distance")
