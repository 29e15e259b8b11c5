"""Filter interaction audit: what each filter removes, in every order of the filters, from one weighted decision diagram.

A document's failures are a mask of one bit a filter. Spark counts the masks of each part (at most 2**filters rows a part).
On them stands an ordered decision diagram: a node tests one filter, its edges lead to the documents that pass and to
those that fail, leaves are counts (all, good, toxic documents), and equal subdiagrams are one node. Swapping neighbouring
levels gives the diagram of the next order, and a chain of such swaps visits all orders. In each of them the path on
which all filters pass gives the steps: the fail edge of its k-th node holds what the k-th filter removes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.llm.rows import map_rows, octets, record_batch

#: The filters, in the order of their bits: few words, repeated words, capitals, symbols, copy of a smaller id's text.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")

_CAPITALS = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#$%&*|"
_INSIDE_CHARACTERS = bytes(range(0x80, 0xC0))

Counts = tuple[int, int, int]
NONE: Counts = (0, 0, 0)


def plus(a: Counts, b: Counts) -> Counts:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def text_failures(data: bytes) -> int:
    """Mask of the filters that a text (as UTF-8) fails by itself."""
    words = data.split()  # bytes split at the white space of ASCII
    few = len(words) < 100
    repeated = 100 * len(set(words)) < 80 * len(words)
    characters = len(data.translate(None, _INSIDE_CHARACTERS))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    symbols = len(data.translate(None, _SYMBOLS)) < len(data)
    return few | repeated << 1 | (100 * capitals > 10 * characters) << 2 | symbols << 3


class Diagram:
    """Levels of nodes (pass child, fail child); children are numbers of nodes on the next level, or of leaves.

    Every level is present on every path, so the weight of a node is the sum of its children's.
    """

    def __init__(self, counts: dict[int, Counts], order: str = FILTERS) -> None:
        self.order = list(order)
        self.leaves: list[Counts] = []
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in order]
        self.unique: list[dict] = [{} for _ in range(len(order) + 1)]
        self.bit = {f: 1 << i for i, f in enumerate(order)}
        self._build(0, 0, counts)
        self.weights: list[list[Counts]] = [[] for _ in order] + [self.leaves]
        for level in reversed(range(len(order))):
            self._weigh(level)

    def _build(self, level: int, mask: int, counts: dict[int, Counts]) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, NONE))
        low = self._build(level + 1, mask, counts)
        return self._node(level, low, self._build(level + 1, mask | self.bit[self.order[level]], counts))

    def _leaf(self, counts: Counts) -> int:
        found = self.unique[-1].setdefault(counts, len(self.leaves))
        if found == len(self.leaves):
            self.leaves.append(counts)
        return found

    def _node(self, level: int, low: int, high: int) -> int:
        found = self.unique[level].setdefault((low, high), len(self.nodes[level]))
        if found == len(self.nodes[level]):
            self.nodes[level].append((low, high))
        return found

    def _weigh(self, level: int) -> None:
        below = self.weights[level + 1]
        self.weights[level] = [plus(below[low], below[high]) for low, high in self.nodes[level]]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next. Only these two levels change; all above keep their nodes."""
        upper, lower = self.nodes[level], self.nodes[level + 1]
        self.nodes[level + 1], self.unique[level + 1] = [], {}
        swapped = []
        for low, high in upper:
            (passes, fails), (passes_high, fails_high) = lower[low], lower[high]
            swapped.append((self._node(level + 1, passes, passes_high), self._node(level + 1, fails, fails_high)))
        self.nodes[level] = swapped
        self.unique[level] = {node: i for i, node in enumerate(swapped)}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self._weigh(level + 1)  # the weights of the upper level are sums over the same leaves

    def steps(self) -> list[tuple[Counts, Counts]]:
        """For each filter in order: what is left after it and what it removes, along the path on which all pass."""
        node, found = 0, []
        for level, below in enumerate(self.weights[1:]):
            low, high = self.nodes[level][node]
            found.append((below[low], below[high]))
            node = low
        return found


def adjacent_swaps(n: int) -> list[int]:
    """Levels to swap with the next one, one after another, to visit all orders of ``n`` filters once."""
    if n < 2:
        return []
    inner, swaps, down = adjacent_swaps(n - 1), [], True
    for i in range(factorial(n - 1)):
        swaps += range(n - 2, -1, -1) if down else range(n - 1)
        if i < len(inner):
            swaps.append(inner[i] + down)
        down = not down
    return swaps


def part_rows(counts: dict[int, Counts], filters: str = FILTERS) -> list[tuple]:
    """The audit of one part: (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    fails = {f: sum(c[0] for mask, c in counts.items() if mask & bit[f]) for f in filters}
    alone = {f: counts.get(bit[f], NONE)[0] for f in filters}
    diagram = Diagram(counts, filters)
    found = [("".join(diagram.order), diagram.steps())]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        found.append(("".join(diagram.order), diagram.steps()))
    removed = dict.fromkeys(filters, 0)
    for order, steps in found:
        for f, (_, lost) in zip(order, steps, strict=True):
            removed[f] += lost[0]
    return [
        (order, i + 1, kept[0], lost[0], fails[f] - lost[0], alone[f], lost[1], lost[2], removed[f])
        for order, steps in found for i, (f, (kept, lost)) in enumerate(zip(order, steps, strict=True))
    ]


def _sums(prefix: str = "", name: str = "") -> list[Column]:
    return [F.sum(f"{prefix}{c}").alias(f"{name}{c}") for c in ("n", "good", "toxic")]


def facts(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every document; the mask lacks what other documents decide."""

    def start():
        def work(doc_id: int | None, data: bytes | None, part: str) -> tuple:
            data = data or b""
            return doc_id, part, hashlib.sha256(data).digest(), text_failures(data)

        return work

    columns = ["doc_id", octets(), F.coalesce("lang", F.lit(""))]
    return map_rows(docs, columns, "doc_id bigint, part string, digest binary, mask int", start)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of the failure masks of each part: ``part, mask, n, good, toxic``.

    One pass over the texts leaves a digest and four bits a document. A text's rows are then counted by digest before they
    are dealt by it, together with those of its smallest id, which are the ones that are no copies.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("bigint").alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("bigint").alias("is_toxic"),
    )
    keys = ["digest", "part", "mask"]
    # documents without an id are never copies nor originals, and don't meet under one key
    none = F.lit(0).cast("bigint")
    without = facts(docs.where("doc_id IS NULL")).groupBy("part", "mask").agg(F.count("*").alias("n"), none.alias("good"), none.alias("toxic"))
    by_id = facts(docs.where("doc_id IS NOT NULL")).groupBy("doc_id", *keys).agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    for name in ("good", "toxic"):
        by_id = by_id.withColumn(name, F.col("n") * F.coalesce(f"is_{name}", F.lit(0)))
    by_text = by_id.groupBy(*keys).agg(*_sums(), F.min(F.struct("doc_id", "n", "good", "toxic")).alias("first"))
    lowest = by_text.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    placed = by_text.join(lowest, "digest").withColumn("original", F.col("first.doc_id") == F.col("lowest"))
    own = [F.when(F.col("original"), F.col(f"first.{c}")).otherwise(0).alias(c) for c in ("n", "good", "toxic")]
    copies = [(F.col(c) - F.when(F.col("original"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")]
    both = F.array(F.struct(F.col("mask").alias("mask"), *own), F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), *copies))
    split = placed.select("part", F.explode(both).alias("e")).select("part", "e.*")
    return split.unionByName(without).groupBy("part", "mask").agg(*_sums())


AUDIT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``doc_id, text, lang`` with ``labels`` (doc_id, quality, toxic): a row for each part, order and step.

    A part is a value of ``lang``; null is the empty string. A null text is empty. Several label rows of one document count
    as good (toxic) if any of them says so. Rows that repeat an id are counted each; of equal texts, those of the smallest id
    are no copies. Rows without an id are no copies and have none, and no labels. Texts are whole, whatever their length.
    Other columns are ignored, whatever they are called; an empty table has no parts and gives no row.
    """
    target = to_arrow_schema(T.StructType.fromDDL(AUDIT))
    counts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = part_rows({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in r["masks"]})
                yield record_batch([(r["part"], *row) for row in rows], target)

    return counts.mapInArrow(run, AUDIT)
