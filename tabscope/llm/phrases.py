"""Phrase collocations by stripes: each word keys an associative counter of what follows it.

A stripe belongs to a part and a word. Its entries are the continuations of the word within a piece of text (the next word,
the next two, ...) with their counts, so it holds the next-word counters of all prefixes that begin with the word. Tasks
count windows of words with sorted codes and emit one stripe a word and window; equal stripes meet and are merged entry by
entry. From the merged stripes come the extensions of a prefix (its entries), its total (the entry that is the prefix) and
the largest count of a longer phrase around it.

The stripes of frequent words are cut into slices by a hash of the entry. How many slices a word has follows from its
share of all words, which the stripe of the empty prefix (the word counts) gives: a table of a bounded number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.rows import octets, small_batches, stored
from tabscope.llm.textbytes import mixed

#: Words of a candidate at most, and how often it must occur at least.
MAX_WORDS, MIN_COUNT = 3, 10
#: A candidate goes if a longer one around it has at least this percentage of its occurrences.
SUBSUMED_PERCENT = 50
#: Results for each part.
TOP = 2000
SCORE_UNIT = 1_000_000
#: Words that a task counts at a time, and bytes of a text that are split into words at a time.
WINDOW, BLOCK = 1_500_000, 4_000_000
#: Entries of a row at most; the rest of a stripe follows in more rows.
STRIPE_ENTRIES = 4096
#: Entries of stripes that are merged at a time (more where one slice alone has more).
MERGED = 2_000_000
#: Longer words are looked up by their digest.
SHORT_WORD = 64

#: A-Z in lower case, all ends of pieces as a line feed, tabs as spaces.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x0A if 0x0A <= b <= 0x0D or b in b".,;:!?" else 0x20 if b == 0x09 else b for b in range(256)
)
#: Stands for the end of a piece; no word is a full stop.
_END = b"."


def blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text and ``.`` for each end of a piece, some at a time; words are never cut."""
    data = data.translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            if cut < 0:
                found = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
                cut = min(found, default=len(data))
            end = cut + 1
        yield data[at:end].replace(b"\n", b" . ").split()
        at = end


class Vocabulary(dict):
    """Numbers of words as they are met; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Windows:
    """Words of the documents of a task by part, handed on in windows of a bounded number of words."""

    def __init__(self, carried: int) -> None:
        self.carried = carried
        self._clear({})

    def _clear(self, kept: dict[str, tuple[list[bytes], int]]) -> None:
        self.vocabulary = Vocabulary()
        self.numbers = {part: [self.vocabulary[w] for w in words] for part, (words, _) in kept.items()}
        self.counted = {part: counted for part, (_, counted) in kept.items()}
        self.size = 0

    def add(self, part: str, words: list[bytes]) -> None:
        self.numbers.setdefault(part, []).extend(map(self.vocabulary.__getitem__, words))
        self.size += len(words)

    def end(self, part: str) -> None:
        """A document ends."""
        self.numbers.setdefault(part, []).append(0)

    def flush(self, part_open: str | None) -> Iterator[tuple[str, np.ndarray, int, pa.Array]]:
        """For each part its numbers, how many of them were counted in the last window, and the words.

        Of the part whose text goes on, the last words are carried over, so that phrases across windows are counted.
        """
        words = pa.array(self.vocabulary, pa.binary())
        kept = {}
        for part, numbers in self.numbers.items():
            if len(numbers) > self.counted.get(part, 0):
                yield part, np.array(numbers, np.int64), self.counted.get(part, 0), words
            if part == part_open and self.carried:
                tail = numbers[-self.carried :]
                kept[part] = [words[i].as_py() for i in tail], len(tail)
        self._clear(kept)


def windows(batches: Iterator[pa.RecordBatch], carried: int, window: int = WINDOW) -> Iterator[tuple[str, np.ndarray, int, pa.Array]]:
    """Windows over Arrow batches of (text, part)."""
    held = Windows(carried)
    for batch in batches:
        for data, part in zip(batch.column(0), batch.column(1), strict=True):
            data, part = data.as_py(), part.as_py()
            for words in blocks(data or b""):
                held.add(part, words)
                if held.size >= window:
                    yield from held.flush(part)
            held.end(part)
    yield from held.flush(None)


WORD_COUNTS = "part string, word binary, count bigint"


def word_counts(docs: DataFrame) -> DataFrame:
    """The stripe of the empty prefix of each part: ``part, word, count``. Combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers, _, words in windows(batches, 0):
            counts = np.bincount(numbers, minlength=len(words))
            counts[0] = 0
            for at in _slices(np.flatnonzero(counts)):
                columns = [pa.array([part] * len(at), pa.string()), words.take(pa.array(at)), pa.array(counts[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "word", "count"])

    return _texts(docs).mapInArrow(run, WORD_COUNTS).groupBy("part", "word").agg(F.sum("count").alias("count"))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(octets(), F.coalesce("lang", F.lit("und")).alias("part"))


def _slices(values: np.ndarray, size: int = 50_000) -> Iterator[np.ndarray]:
    for first in range(0, len(values), size):
        yield values[first : first + size]


def short(word: bytes) -> bytes:
    """A word, or the digest of a long one."""
    return word if len(word) <= SHORT_WORD else hashlib.sha256(word).digest()


def slice_table(counts: DataFrame) -> dict[tuple[str, bytes], int]:
    """Slices of the stripes of frequent words: one for each 1/(4 x shuffle partitions) of all words.

    At most 4 x shuffle partitions words are in the table, and each is at most ``SHORT_WORD`` bytes long.
    """
    least = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    word = F.when(F.octet_length("word") <= SHORT_WORD, F.col("word")).otherwise(F.unhex(F.sha2("word", 256)))
    often = counts.where(F.col("count") > F.lit(total / least)).select("part", word.alias("word"), "count")
    return {(r["part"], bytes(r["word"])): -(-r["count"] * least // total) for r in often.collect()}


#: ``rest`` has the entries, separated by line feeds; ``count`` their counts as 32-bit numbers.
STRIPES = "part string, first binary, slice int, rest binary, count binary"


def window_stripes(
    part: str, numbers: np.ndarray, counted: int, words: pa.Array, slices: dict[tuple[str, bytes], int], max_words: int,
) -> Iterator[pa.RecordBatch]:
    """The stripes of one window, as rows of ``STRIPES``."""
    hashes = mixed(np.array([crc32(w) for w in words.to_pylist()], np.uint64) + np.uint64(1))
    # grams of one word are numbered like the words
    gram, first, rest, rest_hash = numbers, np.arange(len(words)), None, None
    starts = np.flatnonzero(numbers > 0)
    levels = []
    for size in range(2, max_words + 1):
        starts = starts[starts + size - 1 < len(numbers)]
        last = numbers[starts + size - 1]
        starts, last = starts[last > 0], last[last > 0]
        codes = gram[starts] << 32 | last
        distinct, inverse = np.unique(codes, return_inverse=True)
        before, word = distinct >> 32, distinct & 0xFFFFFFFF
        if rest is None:
            rest, rest_hash = words.take(pa.array(word)), hashes[word]
        else:
            rest = pc.binary_join_element_wise(rest.take(pa.array(before)), words.take(pa.array(word)), b" ")
            rest_hash = mixed(rest_hash[before] * np.uint64(31) + hashes[word])
        first = first[before]
        gram = np.zeros(len(numbers), np.int64)
        gram[starts] = inverse
        new = starts + size - 1 >= counted
        counts = np.bincount(inverse[new], minlength=len(distinct))
        at = np.flatnonzero(counts)
        levels.append((first[at], rest.take(pa.array(at)), counts[at], rest_hash[at]))
    if not sum(len(level[0]) for level in levels):
        return
    first = np.concatenate([level[0] for level in levels])
    counts = np.concatenate([level[2] for level in levels])
    rest = pa.concat_arrays([level[1] for level in levels])
    cut = np.ones(len(words), np.int64)
    if slices:
        used = np.unique(first)
        cut[used] = [slices.get((part, short(w)), 1) for w in words.take(pa.array(used)).to_pylist()]
    place = (np.concatenate([level[3] for level in levels]) % cut[first].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((place, first))
    first, place = first[order], place[order]
    new = np.r_[True, (np.diff(first) != 0) | (np.diff(place) != 0)]
    begins = np.flatnonzero(new)
    inside = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    bounds = np.r_[np.flatnonzero(inside % STRIPE_ENTRIES == 0), len(order)]
    for at in _slices(np.arange(len(bounds) - 1), 5000):
        low, high = bounds[at[0]], bounds[at[-1] + 1]
        offsets = bounds[at[0] : at[-1] + 2] - low
        entries = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest.take(pa.array(order[low:high])))
        packed = pa.py_buffer(counts[order[low:high]].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([
            pa.array([part] * len(at), pa.string()), words.take(pa.array(first[bounds[at]])), pa.array(place[bounds[at]], pa.int32()),
            pc.binary_join(entries, b"\n"), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), packed]),
        ], names=["part", "first", "slice", "rest", "count"])


def stripes(docs: DataFrame, slices: dict[tuple[str, bytes], int], max_words: int = MAX_WORDS, window: int = WINDOW) -> DataFrame:
    """The stripes of all windows of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers, counted, words in windows(batches, max_words - 1, window):
            yield from window_stripes(part, numbers, counted, words, slices, max_words)

    return _texts(docs).mapInArrow(run, STRIPES)


PHRASES = "part string, first binary, rest binary, count bigint"


def merge(found: DataFrame, min_count: int = MIN_COUNT, merged: int = MERGED) -> DataFrame:
    """Merge equal stripes entry by entry; return entries of at least ``min_count``: ``part, first, rest, count``.

    Stripes arrive sorted, so a task holds about ``merged`` entries, or the different entries of one slice.
    """
    names = ["part", "first", "slice"]

    def summed(pieces: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(pieces).group_by([*names, "rest"], use_threads=False).aggregate([("count", "sum")]).rename_columns([*names, "rest", "count"])

    def often(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.filter(pc.greater_equal(table["count"], min_count)).drop_columns(["slice"])
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(4)).to_numpy() // 4
            for low, high in _cuts(lengths, merged):
                part = batch.slice(low, high - low)
                rows = pa.array(np.repeat(np.arange(high - low), lengths[low:high]))
                entries = pc.split_pattern(part.column(3), b"\n").flatten()
                counts = pa.array(np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).astype(np.int64))
                held.append(pa.Table.from_arrays([*(part.column(i).take(rows) for i in range(3)), entries, counts], names=[*names, "rest", "count"]))
                size += len(rows)
                if size < merged:
                    continue
                table = summed(held)
                # the last stripe may go on in the next batch
                last = pc.and_(pc.equal(table["first"], part.column(1)[-1]), pc.equal(table["slice"], part.column(2)[-1]))
                last = pc.and_(last, pc.equal(table["part"], part.column(0)[-1]))
                yield from often(table.filter(pc.invert(last)))
                held, size = [table.filter(last)], 0  # counts from the next entry on: a large slice is not summed at each step
        if held:
            yield from often(summed(held))

    small = found.select("part", "first", "slice", "rest", "count").repartition("part", "first", "slice")
    return small.sortWithinPartitions("part", "first", "slice").mapInArrow(run, PHRASES)


def _cuts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` entries together."""
    low, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= most:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(lengths):
        yield low, len(lengths)


def score_of(a: str, left: str, right: str) -> Column:
    """``floor(SCORE_UNIT a a / (left right))``, exactly, for products of up to 38 digits."""
    a, left, right = (f"CAST({c} AS DECIMAL(16, 0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * {SCORE_UNIT}) div ({left} * {right})")


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, subsumed_percent: int = SUBSUMED_PERCENT, top: int = TOP,
) -> DataFrame:
    """The first ``top`` phrases of each part: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z count as lower case, pieces end at ``. , ; : ! ?`` and line ends, words are what spaces and tabs separate. A
    candidate has 2 to ``max_words`` words and ``a`` >= ``min_count`` occurrences. Its score is the lowest of its cuts into two
    parts with ``l`` and ``r`` occurrences: ``floor(1000000 a a / (l r))``; of equal cuts the first counts. A candidate goes if a
    longer one around it has at least ``subsumed_percent`` of its occurrences. Order: score and ``a`` descending, phrase.

    A null ``lang`` is ``und``, a null or empty text has no words. Repeated rows count each. Texts are whole, whatever their
    length. Other columns are ignored, whatever they are called; an empty table gives no row. Products are exact up to 38 digits.
    """
    counts = stored(word_counts(docs), "words")
    totals = counts.groupBy("part").agg(F.sum("count").alias("n"))
    merged = merge(stripes(docs, slice_table(counts), max_words), min_count)
    text = F.concat_ws(" ", F.col("first").cast("string"), F.col("rest").cast("string"))
    longer = merged.select("part", text.alias("phrase"), "count")
    single = counts.where(F.col("count") >= min_count).select("part", F.col("word").cast("string").alias("phrase"), "count")
    phrases = stored(longer.withColumn("words", F.split("phrase", " ")).unionByName(single.withColumn("words", F.array("phrase"))), "phrases")

    size = F.size("words")
    table = phrases.select("part", "phrase", "count")
    candidates = phrases.where(size > 1)
    # each candidate asks for the counts of the parts of each of its cuts
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"left": _cut_left(), "right": _cut_right()})
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(table.select("part", F.col("phrase").alias(side), F.col("count").alias(name)), ["part", side])
    best = cut.withColumn("score", score_of("count", "l", "r")).groupBy("part", "phrase").agg(
        F.first("count").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    # what a longer candidate holds: its runs of fewer words
    inner = candidates.where(size > 2).select("part", "count", F.explode(_inner_phrases()).alias("phrase"))
    around = inner.groupBy("part", "phrase").agg(F.max("count").alias("around"))
    left = best.join(around, ["part", "phrase"], "left").where(
        F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(subsumed_percent) * F.col("a"))
    )
    by_rank = Window.partitionBy("part").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= top)
    return ranked.join(totals, "part").select(
        F.col("part").alias("lang"), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").cast("bigint").alias("score"),
    )


def _cut_left() -> Column:
    return F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")


def _cut_right() -> Column:
    return F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ")


def _inner_phrases() -> Column:
    """The distinct runs of 2 to one fewer words of a phrase."""
    size = F.size("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    return F.array_distinct(runs)
