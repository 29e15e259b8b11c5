"""Packing by optimal length buckets: boundaries that minimise padding, then batches of a token budget.

The histogram of lengths is global and small; dynamic programming over it chooses the boundaries. Documents of a
bucket are padded to its boundary, so a batch holds as many as fit the budget, and a document's batch follows from its
number within the bucket. Numbers are counted in parts, so no bucket is ever in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.llm.rows import map_rows, octets, stored
from tabscope.llm.textbytes import byte_array, words

#: Tokens of a batch, padding included, and number of buckets.
BUDGET, BUCKETS = 16_384, 16
#: With ``rounded``, lengths above this are rounded up, by less than a part in ``FINE``.
EXACT, FINE = 8192, 512
#: Documents numbered in one part of a bucket, about.
PART = 250_000


def word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens``: the number of words ``[^\\x20\\x09-\\x0D]+`` of each text; 0 for null."""
    return map_rows(
        docs, ["doc_id", octets()], "doc_id bigint, n_tokens bigint",
        lambda: lambda doc_id, text: (doc_id, len(words(byte_array(text or b""))[0])),
    )


def rounded_length(length: Column) -> Column:
    """The length a document counts as: itself, or the next of the steps above ``EXACT``."""
    step = F.greatest(F.lit(1), F.pow(2.0, F.floor(F.log2(length.cast("double"))) - int(np.log2(FINE)))).cast("bigint")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step) * step).cast("bigint")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (ascending, the last is the largest length) with the least padding in all.

    The cost of one more bucket has a best split that moves only to the right as lengths grow, so each row of the
    table is filled by divide and conquer.
    """
    size = len(lengths)
    if size <= buckets:
        return [int(x) for x in lengths]
    documents = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))

    def padding(begin: np.ndarray | int, end: int) -> np.ndarray:
        """Padding of lengths begin .. end-1 in one bucket."""
        return lengths[end - 1] * (documents[end] - documents[begin]) - (tokens[end] - tokens[begin])

    best = np.array([0.0, *(padding(0, e) for e in range(1, size + 1))])
    cuts = []
    for k in range(2, buckets + 1):
        row, cut = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        stack = [(k, size, k - 1, size - 1)]
        while stack:
            low, high, left, right = stack.pop()
            if low > high:
                continue
            end = (low + high) // 2
            begins = np.arange(left, min(right, end - 1) + 1)
            costs = best[begins] + padding(begins, end)
            at = int(np.argmin(costs))
            row[end], cut[end] = costs[at], begins[at]
            stack += [(low, end - 1, left, int(begins[at])), (end + 1, high, int(begins[at]), right)]
        best = row
        cuts.append(cut)
    ends = [size]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    return [int(lengths[e - 1]) for e in reversed(ends)]


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, rounded: bool = False) -> DataFrame:
    """A batch and a slot for each document.

    ``doc_id, n_tokens, bucket_length, batch_id, slot``. The padded size of a batch (documents times bucket length) is
    at most ``budget``, except for a document longer than it, which is a batch alone. A null, empty or blank text has
    no tokens and no batch (nulls). Within a bucket, the order is by hash; repeated rows and rows without an id each get
    a slot, spread like all others. Only ids and lengths are shuffled. Other columns are ignored; of an empty table the
    result is empty.

    The driver gets the histogram of distinct lengths. There are fewer than the root of twice all tokens, since ``d``
    different lengths add up to at least d * d / 2. ``rounded`` makes them fewer still, at the cost of padding.
    """
    length = rounded_length(F.col("n_tokens")) if rounded else F.col("n_tokens")
    row = F.monotonically_increasing_id()
    sizes = stored(word_counts(docs).withColumn("length", length).withColumn("row", row), "lengths")  # read four times
    histogram = sizes.where("length > 0").groupBy("length").agg(F.count("*").alias("documents")).orderBy("length")
    found = histogram.toPandas()
    lengths, counts = found["length"].to_numpy(np.int64), found["documents"].to_numpy(np.int64)
    bounds = optimal_boundaries(lengths, counts, buckets) if len(lengths) else []
    bucket = F.coalesce(*(F.when(F.col("length") <= b, F.lit(b)) for b in bounds)) if bounds else F.lit(None)
    parts = max(8, -(-int(counts.sum()) // PART))
    draw = F.xxhash64("doc_id", "row")
    placed = sizes.select(
        "doc_id", "n_tokens", F.when(F.col("length") > 0, bucket).cast("bigint").alias("bucket_length"),
        "row", draw.alias("draw"), F.pmod(draw, F.lit(parts)).alias("part"),
    )
    totals = placed.where("bucket_length is not null").groupBy("bucket_length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket_length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_length", "part").orderBy("draw", "row")
    numbered = placed.where("bucket_length is not null").withColumn("number", F.row_number().over(inside) - 1).join(
        offsets, ["bucket_length", "part"]
    ).withColumn("number", F.col("number") + F.col("offset"))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("bigint")
    order = F.coalesce(*(F.when(F.col("bucket_length") == b, F.lit(i)) for i, b in enumerate(bounds))) if bounds else F.lit(0)
    packed = numbered.select(
        "doc_id", "n_tokens", "bucket_length",
        (F.shiftleft(order.cast("bigint"), 48) + F.floor(F.col("number") / capacity)).alias("batch_id"),
        (F.col("number") % capacity).alias("slot"),
    )
    none = placed.where("bucket_length is null").select(
        "doc_id", "n_tokens", "bucket_length", F.lit(None).cast("bigint").alias("batch_id"),
        F.lit(None).cast("bigint").alias("slot"),
    )
    return packed.union(none)
