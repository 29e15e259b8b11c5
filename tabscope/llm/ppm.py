"""Language-model scores by prediction by partial matching (PPM) on bytes, beside a smoothed word model.

The corpus is counted in one pass: words, and byte contexts of order 3 with the byte that follows. Lower orders are
sums of it. Escape probabilities follow method C, with symbol exclusion: a context that has seen ``d`` symbols in
``n`` events escapes with ``d / (n + d)``, and a lower order then shares that among the symbols not yet excluded.
Since the trie is fixed while texts are scored, each context's whole distribution is computed once, as a row of a
table, and a text's code length is a sum of table entries. Every counted context is used: frequent ones and all of
order 2 are looked up in a shared table, all others are rows of a distributed one, joined to the events that need them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.language import held_out
from tabscope.llm.rows import SLICE, map_rows, octets, small_batches, stored
from tabscope.llm.textbytes import LOWER, Rolling, byte_array, words

#: The end of a text as a symbol: a byte that UTF-8 never has.
END = 0xFF
#: Contexts of order 3 that every task gets: those with at least this part of all events. All others are joined.
FREQUENT_CONTEXTS = 1 << 15
#: Words whose counts every task gets: those with at least this part of all words. All others are joined.
FREQUENT_WORDS = 1 << 17
#: Events and words a task gathers before it counts them.
GATHERED = 4_000_000

#: The end token's place among the hashed words.
END_TOKEN = 0
#: Smoothing of the word model.
SMOOTHING = 0.1


def word_hashes(lowered: bytes) -> np.ndarray:
    raw = byte_array(lowered)
    return Rolling(raw).spans(*words(raw)).view(np.int64)


def events(lowered: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (three bytes as a number; zero bytes before the text) and the symbols that follow, with the end."""
    padded = np.zeros(len(lowered) + 3, np.uint32)
    padded[3:] = byte_array(lowered)
    symbols = np.full(len(lowered) + 1, END, np.uint32)
    symbols[:-1] = padded[3:]
    contexts = np.zeros(len(lowered) + 1, np.uint32)
    for shift, at in ((16, 0), (8, 1), (0, 2)):
        contexts |= padded[at : at + len(contexts)] << np.uint32(shift)
    return contexts, symbols


class Counter:
    """Counts of integers, summed whenever enough are gathered."""

    def __init__(self) -> None:
        self.pieces: list[np.ndarray] = []
        self.size = 0
        self.keys = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.pieces.append(values)
        self.size += len(values)
        if self.size >= GATHERED:
            self.settle()

    def settle(self) -> None:
        if not self.pieces:
            return
        keys, counts = np.unique(np.concatenate(self.pieces), return_counts=True)
        self.pieces, self.size = [], 0
        both = np.concatenate((self.keys, keys.astype(np.int64)))
        self.keys, place = np.unique(both, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate((self.counts, counts)), len(self.keys)).astype(np.int64)

    def drain(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        for first in range(0, len(self.keys), 65536):
            keys, counts = self.keys[first : first + 65536], self.counts[first : first + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)],
                ["kind", "key", "occurrences"],
            )
        self.__init__()


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``kind, key, occurrences`` over all texts: kind 0 are hashed words, kind 1 contexts with their symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counter(), Counter()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(first, SLICE).to_pylist():
                    lowered = (text or b"").translate(LOWER)
                    counters[0].add(np.append(word_hashes(lowered), END_TOKEN))
                    contexts, symbols = events(lowered)
                    counters[1].add(contexts << np.uint32(8) | symbols)
            if len(counters[0].keys) > GATHERED:  # a large partition: pass on what is there
                yield from counters[0].drain(0)
        for kind in (0, 1):
            yield from counters[kind].drain(kind)

    small_batches(docs.sparkSession)
    found = docs.select(octets()).mapInArrow(run, "kind int, key bigint, occurrences bigint")
    return found.groupBy("kind", "key").agg(F.sum("occurrences").alias("occurrences"))


class Counts(NamedTuple):
    """Counts of the symbols after contexts of one order: contexts ascending, each with a range of the other two."""

    contexts: np.ndarray
    starts: np.ndarray
    symbols: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, numbers: np.ndarray) -> Counts:
        """From grams (context and symbol as one number) in any order."""
        order = np.argsort(grams)
        contexts, starts = np.unique(grams[order] >> 8, return_index=True)
        return cls(contexts, np.append(starts, len(grams)), (grams[order] & 255).astype(np.uint8), numbers[order].astype(np.float64))

    def rows(self, contexts: np.ndarray) -> np.ndarray:
        """Counts of the 256 symbols, a row for each context; none after one that was never seen."""
        found = np.zeros((len(contexts), 256))
        if not len(self.contexts):
            return found
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        sizes = np.where(self.contexts[at] == contexts, self.starts[at + 1] - self.starts[at], 0)
        cells = np.arange(sizes.sum()) + np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes)
        found[np.repeat(np.arange(len(contexts)), sizes), self.symbols[cells]] = self.numbers[cells]
        return found


class Trie(NamedTuple):
    """The shared part: frequent contexts of order 3, all of order 2, and the logarithm (base 10) of each symbol's
    probability: a row for each of them, then for the 256 contexts of order 1.
    """

    contexts_3: np.ndarray
    contexts_2: np.ndarray
    table: np.ndarray

    def index(self) -> np.ndarray:
        """The row of each three-byte context: of its longest suffix in the trie."""
        three, two = len(self.contexts_3), len(self.contexts_2)
        rows = np.tile(np.arange(256, dtype=np.uint32) + np.uint32(three + two), 256)
        rows[self.contexts_2] = np.arange(three, three + two)
        rows = np.tile(rows, 256)
        rows[self.contexts_3] = np.arange(three)
        return rows


def excluded_share(counts: np.ndarray, excluded: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One order of PPM for many contexts (rows) at once.

    Gives the probability of each symbol seen here and not yet excluded, the symbols excluded from now on, and the
    mass that escapes to the next order.
    """
    own = np.where(excluded, 0, counts)
    total, kinds = own.sum(axis=1), (own > 0).sum(axis=1)
    part = mass / np.maximum(total + kinds, 1)
    return own * part[:, None], excluded | (counts > 0), np.where(kinds > 0, kinds * part, mass)


def distributions(orders: list[np.ndarray]) -> np.ndarray:
    """Log10 probabilities of the 256 symbols for rows of contexts, given the counts of each order, longest first."""
    rows = len(orders[0])
    chances, mass = np.zeros((rows, 256)), np.ones(rows)
    excluded = np.zeros((rows, 256), bool)
    for counts in orders:
        share, following, escaped = excluded_share(counts, excluded, mass)
        chances += share
        excluded, mass = following, escaped
    unseen = 256 - excluded.sum(axis=1)
    chances += np.where(excluded, 0, (mass / np.maximum(unseen, 1))[:, None])
    # where nothing is left to escape to, the escape mass goes back to what was seen
    chances /= chances.sum(axis=1, keepdims=True)
    return np.log10(chances).astype(np.float32)


def gram_counts(counts: DataFrame, order: int) -> DataFrame:
    """``gram, n`` of one order: sums of the grams of order 3 (kind 1 of ``corpus_counts``)."""
    gram = F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
    return counts.where("kind = 1").groupBy(gram.alias("gram")).agg(F.sum("occurrences").alias("n"))


def lower_orders(counts: DataFrame) -> list[Counts]:
    """Counts of orders 2, 1 and 0. Their size is bounded by the bytes: 65,536 contexts of at most 256 symbols."""
    rows = gram_counts(counts, 2).toPandas()
    grams, numbers = rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    found = [Counts.of(grams, numbers)]
    for mask in (0xFFFF, 0xFF):
        names, place = np.unique(grams & mask, return_inverse=True)
        found.append(Counts.of(names, np.bincount(place, numbers, len(names))))
    return found


def all_orders(lower: list[Counts], contexts: np.ndarray) -> list[np.ndarray]:
    """Counts of the symbols after the suffixes of contexts: the last two bytes, the last byte, none."""
    return [c.rows(contexts & mask) for c, mask in zip(lower, (0xFFFF, 0xFF, 0), strict=True)]


def by_context(counts: DataFrame) -> DataFrame:
    """``context, seen array<struct<symbol, n>>, frequent`` of each context of order 3; at most 256 symbols each."""
    total = counts.where("kind = 1").agg(F.sum("occurrences")).first()[0] or 0
    symbol = F.struct(F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), F.col("occurrences").alias("n"))
    grams = counts.where("kind = 1").select(F.shiftright("key", 8).alias("context"), symbol.alias("s"))
    return grams.groupBy("context").agg(
        (F.sum("s.n") >= total / FREQUENT_CONTEXTS).alias("frequent"), F.collect_list("s").alias("seen")
    )


def build_trie(counts: DataFrame, lower: list[Counts] | None = None) -> Trie:
    """The shared trie of ``corpus_counts``. Of order 3 it has contexts with their part of all events, so that what comes
    to the driver is bounded whatever the corpus; ``rare_distributions`` has all others.
    """
    lower = lower or lower_orders(counts)
    rows = by_context(counts).where("frequent").select("context", F.inline("seen")).toPandas()
    names = rows["context"].to_numpy(np.int64)
    three = Counts.of(names << 8 | rows["symbol"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    two = lower[0].contexts
    parts = []
    for first in range(0, len(three.contexts), 2048):
        some = three.contexts[first : first + 2048]
        parts.append(distributions([three.rows(some), *all_orders(lower, some)]))
    for first in range(0, len(two), 2048):
        parts.append(distributions(all_orders(lower, two[first : first + 2048])))
    parts.append(distributions(all_orders(lower, np.arange(256))[1:]))
    return Trie(three.contexts, two, np.vstack(parts))


def rare_distributions(counts: DataFrame, lower: list[Counts]) -> DataFrame:
    """``context, logs``: the 256 logarithms for each context of order 3 that the trie hasn't."""
    shared = counts.sparkSession.sparkContext.broadcast(lower)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, seen = batch.column(0).to_numpy(), batch.column(1)
            cells = seen.flatten()
            owner = np.repeat(np.arange(len(names)), seen.value_lengths().to_numpy())
            own = np.zeros((len(names), 256))
            own[owner, cells.field(0).to_numpy()] = cells.field(1).to_numpy()
            logs = distributions([own, *all_orders(shared.value, names)])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, 256, dtype=np.int32)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["context", "logs"])

    small_batches(counts.sparkSession)
    return by_context(counts).where("NOT frequent").select("context", "seen").mapInArrow(run, "context bigint, logs array<float>")


def code_length(lowered: bytes, table: np.ndarray, index: np.ndarray, shared: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log10 probability of the events of a text and its end whose context is among the ``shared`` of order 3.

    Of all others, the distinct grams, how often each is there, and its logarithm if the context was never counted.
    """
    contexts, symbols = events(lowered)
    rows = index[contexts]
    logs = table[rows, symbols]
    joined = rows >= shared
    grams, first, times = np.unique(
        contexts[joined].astype(np.int64) << 8 | symbols[joined], return_index=True, return_counts=True
    )
    return float(logs[~joined].sum(dtype=np.float64)), grams, times, logs[joined][first]


def score(docs: DataFrame, parts: int = 10) -> DataFrame:
    """Score every text by models learned from those whose id is not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null or empty text is one end token.
    Repeated rows are scored each; with no rows to learn from all words are unknown and bytes are equally likely.
    Other columns are ignored. Words and contexts of all texts are counted and used; frequent ones are looked up in a
    bounded table, all others by a join on the word or the context.
    """
    training = docs.where(~held_out("doc_id", parts))
    counts = stored(corpus_counts(training), "corpus-counts")
    lower = lower_orders(counts)
    trie = build_trie(counts, lower)
    vocabulary = counts.where("kind = 0").select(F.col("key").alias("token"), "occurrences")
    sizes = vocabulary.agg(F.sum("occurrences").alias("n"), F.count("*").alias("v")).first()
    total, kinds = sizes.n or 0, sizes.v
    frequent = vocabulary.where(F.col("occurrences") >= total / FREQUENT_WORDS).toPandas().sort_values("token")
    shared = docs.sparkSession.sparkContext.broadcast(
        (trie, frequent["token"].to_numpy(np.int64), frequent["occurrences"].to_numpy(np.int64))
    )

    def start():
        model, tokens, numbers = shared.value
        index = model.index()
        logs = np.log10(np.append(numbers, 0) + SMOOTHING)
        tokens = np.append(tokens, np.iinfo(np.int64).max)

        def work(doc_id: int | None, held: bool, text: bytes | None) -> tuple:
            lowered = (text or b"").translate(LOWER)
            own = np.append(word_hashes(lowered), END_TOKEN)
            at = np.searchsorted(tokens, own)
            known = (tokens[at] == own) & (at < len(numbers))
            rare, times = np.unique(own[~known], return_counts=True)
            shared_score, grams, seen, otherwise = code_length(lowered, model.table, index, len(model.contexts_3))
            return (
                doc_id, held, len(own), int(known.sum()), float(logs[at[known]].sum()), shared_score,
                [{"token": t, "times": n} for t, n in zip(rare.tolist(), times.tolist(), strict=True)],
                [{"gram": g, "times": n, "otherwise": x} for g, n, x in zip(grams.tolist(), seen.tolist(), otherwise.tolist(), strict=True)],
            )

        return work

    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_frequent bigint, frequent_sum double, shared_score double, "
        "rare array<struct<token: bigint, times: bigint>>, grams array<struct<gram: bigint, times: int, otherwise: float>>"
    )
    scored = map_rows(docs, ["doc_id", held_out("doc_id", parts).alias("held_out"), octets()], schema, start)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    chance = F.log10(F.coalesce("occurrences", F.lit(0)) + SMOOTHING)
    rare = (
        scored.select("row", F.inline("rare")).join(vocabulary, "token", "left")
        .groupBy("row").agg(
            F.sum(F.col("times") * chance).alias("rare_sum"),
            F.sum(F.when(F.col("occurrences").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
        )
    )
    log = F.coalesce(F.get("logs", F.col("gram").bitwiseAND(F.lit(255)).cast("int")), F.col("otherwise"))
    joined = (
        scored.select("row", F.inline("grams")).withColumn("context", F.shiftright("gram", 8))
        .join(rare_distributions(counts, lower), "context", "left")
        .groupBy("row").agg(F.sum(F.col("times") * log.cast("double")).alias("joined_score"))
    )
    norm = float(np.log10(total + SMOOTHING * (kinds + 1)))
    return scored.drop("rare", "grams").join(rare, "row", "left").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("frequent_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("shared_score") + F.coalesce("joined_score", F.lit(0.0))).alias("score"),
    )
