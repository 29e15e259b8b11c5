"""I-Match fingerprints: terms of a chosen inverse-document-frequency band, hashed by randomised sub-lexicons.

The lexicon are the terms whose document frequency lies in a band. A text keeps its distinct lexicon terms; for each
of many random subsets of the lexicon, the terms in that subset are hashed. Subsets of several densities make the
fingerprints of short and of long texts comparable: an edit changes only the subsets that hold a changed term.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.llm.rows import SLICE, record_batch, small_batches, stored
from tabscope.llm.textbytes import LOWER, Rolling, byte_array, mixed, words

#: The band: a term is in at least one of ``RARE`` distinct texts and in at most one of ``COMMON``. The lexicon thus has at
#: most ``RARE`` times as many terms as a document has on average.
RARE, COMMON = 8192, 20
#: Random subsets of each density. A term is in a subset with chance 2**-scale; scales go from ``DENSEST`` in steps of
#: ``STEP`` to one at which even the whole lexicon leaves about a term a subset, so that no text is too long for all.
SUBSETS, DENSEST, STEP = 24, 3, 2
#: Densities are compared until this many subsets with terms have been seen.
ENOUGH = 16
#: Most bits of the filter that marks texts which may be repeated, and bits a row in small tables.
FILTER, FILTER_ROW = 1 << 26, 16
#: Documents in a block of consecutive ids, and most blocks.
BLOCK, BLOCKS = 1000, 100_000

_SEEDS = mixed(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LOWEST = -(1 << 63)


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words, A-Z lower-cased."""
    raw = byte_array(text.encode().translate(LOWER))
    return np.unique(Rolling(raw).spans(*words(raw)))


def whole_text() -> Column:
    """The text of a row; a null one is empty."""
    return F.coalesce("text", F.lit(""))


def filter_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter for each hash."""
    return tuple((mixed(hashes.view(np.uint64) + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in (1, 2))


def repeated_filter(docs: DataFrame, count: int) -> np.ndarray:
    """A bit filter of the hashes that several texts have. It may let others through, but misses none.

    Only hashes are shuffled; what comes to the driver is bounded by ``FILTER``.
    """
    bits = 64
    while bits < min(FILTER, FILTER_ROW * count):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(filter_places(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 3), pa.array(1 << (places & 7))], ["at", "bits"])

    several = docs.groupBy(F.xxhash64(whole_text()).alias("hash")).count().where("count > 1").select("hash")
    found = several.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return out


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> tuple[np.ndarray, int]:
    """Sorted term hashes of the band, and the number of rows. Frequencies cover all distinct texts, each once.

    Texts that surely stand alone are counted where they are; of all others, one row a task is shuffled by digest.
    """
    small_batches(docs.sparkSession)
    count = docs.count()
    shared = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, count))

    def counted(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Terms and in how many texts they are; the number of texts as the term null."""
        found, times = np.unique(np.concatenate(pieces), return_counts=True)
        for first in range(0, len(found), 65536):
            part = slice(first, first + 65536)
            yield counts(found[part].view(np.int64), times[part].astype(np.int64))
        yield counts([None], [len(pieces)])
        pieces.clear()

    def counts(found: np.ndarray | list, times: np.ndarray | list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(times, pa.int64())], ["term", "documents"])

    def summed(sets: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pieces: list[np.ndarray] = []
        size = 0
        for own in sets:
            pieces.append(own)
            size += len(own)
            if size > 4_000_000:
                yield from counted(pieces)
                size = 0
        if pieces:
            yield from counted(pieces)

    def texts(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[list[str]]:
        """The texts that may be repeated, or all others, in slices."""
        several = shared.value
        for batch in batches:
            a, b = filter_places(batch.column(1).to_numpy(), 8 * len(several))
            bits = several[a >> 3] >> (a & 7).astype(np.uint8) & several[b >> 3] >> (b & 7).astype(np.uint8) & 1
            chosen = batch.column(0).filter(pa.array(bits.astype(bool) == marked))
            for first in range(0, len(chosen), SLICE):
                yield chosen.slice(first, SLICE).to_pylist()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(terms(text) for part in texts(batches, False) for text in part)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in texts(batches, True):
            new = {hashlib.blake2b(t.encode(), digest_size=16).digest(): t for t in part}
            rows = [(digest, terms(text).tobytes()) for digest, text in new.items() if digest not in seen]
            seen.update(new)
            if rows:
                yield record_batch(rows, target)
            if len(seen) > 200_000:  # what is sent again is counted once all the same
                seen.clear()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed(np.frombuffer(own, np.uint64) for batch in batches for own in batch.column(0).to_pylist())

    target = to_arrow_schema(T.StructType.fromDDL("digest binary, terms binary"))
    schema = "term bigint, documents bigint"
    rows = docs.select(whole_text().alias("text"), F.xxhash64(whole_text()).alias("hash"))
    once = rows.mapInArrow(repeated, "digest binary, terms binary").dropDuplicates(["digest"]).select("terms")
    frequencies = rows.mapInArrow(alone, schema).union(once.mapInArrow(together, schema)).groupBy("term").agg(
        F.sum("documents").alias("documents")
    )
    frequencies = stored(frequencies, "frequencies")
    distinct = frequencies.where("term is null").select("documents").first()
    distinct = distinct[0] if distinct else 0
    band = frequencies.where("term is not null").where(
        F.col("documents").between(distinct / rare, max(1.0, distinct / common))
    )
    found = band.select("term").toPandas()["term"].to_numpy(np.int64)  # bounded, see RARE
    return np.sort(found.view(np.uint64)), count


class Fingerprint(NamedTuple):
    """Hash of all terms, then 16 bits for each subset (0: it has no term), a row for each density, dense ones first.

    Densities from the first at which no subset has a term are left out: a longer text has more rows.
    """

    whole: str
    subsets: np.ndarray

    def __str__(self) -> str:
        return self.whole + self.subsets.astype(">u2").tobytes().hex()


def fingerprint(text: str, band: np.ndarray) -> Fingerprint:
    """The fingerprint of a text. The whole-text hash covers all terms, so texts without lexicon terms have one too."""
    own = terms(text)
    whole = hashlib.blake2b(own.tobytes(), digest_size=8).hexdigest()
    if len(band):
        own = own[band[np.minimum(np.searchsorted(band, own), len(band) - 1)] == own]
    else:
        own = own[:0]
    draws = mixed(own[:, None] ^ _SEEDS[None, :])
    at, subset = np.nonzero(draws < np.uint64(1 << 64 - DENSEST))
    draws, values = draws[at, subset], mixed(own + np.uint64(0x5851F42D4C957F2D))[at]
    parts: list[np.ndarray] = []
    for scale in scales(len(band)):  # sparser subsets are parts of the denser ones
        member = draws < np.uint64(1 << 64 - scale)
        draws, values, subset = draws[member], values[member], subset[member]
        if not len(draws):
            break
        sums = np.zeros(SUBSETS, np.uint64)
        np.add.at(sums, subset, values)
        digest = np.maximum(mixed(sums) >> np.uint64(48), np.uint64(1))
        parts.append(np.where(np.bincount(subset, minlength=SUBSETS) > 0, digest, np.uint64(0)))
    return Fingerprint(whole, np.array(parts, np.uint64).astype(np.uint16).reshape(-1, SUBSETS))


def scales(size: int) -> range:
    """The densities for a lexicon of that size, dense ones first."""
    return range(DENSEST, max(DENSEST, (size - 1).bit_length()) + STEP, STEP)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of equal subset hashes among the sparsest subsets that have terms; 1 for equal fingerprints.

    Texts without lexicon terms are alike only if all their terms are the same.
    """
    if a.whole == b.whole:
        return 1.0
    same = used = 0
    empty = np.zeros(SUBSETS, np.uint16)
    for i in reversed(range(max(len(a.subsets), len(b.subsets)))):
        own, other = (f.subsets[i] if i < len(f.subsets) else empty for f in (a, b))
        filled = (own > 0) | (other > 0)
        used += int(filled.sum())
        same += int((own[filled] == other[filled]).sum())
        if used >= ENOUGH:
            break
    return same / used if used else 0.0


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many characters from the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_next(docs: DataFrame, count: int, block: int = BLOCK) -> DataFrame:
    """Documents in blocks of consecutive ids, each block followed by the first row of the next one.

    ``block, borrowed, place, doc_id, text``, each partition sorted so that the next row of a block is the next document by
    descending id (null ids last; ties by a hash of the text); the last document is followed by the first. Texts are
    shuffled once; only one row of a block is there twice.
    """
    place = F.coalesce("doc_id", F.lit(_LOWEST))
    rows = docs.select("doc_id", "text", place.alias("place"))
    blocks = max(1, min(BLOCKS, count // block))
    cuts = rows.approxQuantile("place", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    cuts = np.unique(np.array(cuts, np.float64))

    def block_of(places: pd.Series) -> np.ndarray:
        return np.searchsorted(cuts, places.to_numpy(np.int64).astype(np.float64), side="left")

    number = F.pandas_udf(lambda p: pd.Series(block_of(p)), T.LongType())
    firsts = rows.groupBy(number("place").alias("block")).agg(F.max("place").alias("first")).collect()  # a row a block
    order = sorted((r.block, r.first) for r in firsts)
    #: id of a block's first document to the block before it, which borrows it; the highest goes to the lowest
    lenders = {first: order[(i + 1) % len(order)][0] for i, (_, first) in enumerate(order)}
    targets = F.pandas_udf(
        lambda p: pd.Series([[b, lenders[x]] if x in lenders else [b] for b, x in zip(block_of(p), p, strict=True)]),
        T.ArrayType(T.LongType()),
    )
    spread = rows.select(F.posexplode(targets("place")).alias("borrowed", "block"), "place", "doc_id", "text")
    return (
        spread.repartition("block")
        .sortWithinPartitions("block", "borrowed", F.desc("place"), F.xxhash64("text"))
    )


def fingerprint_edits(docs: DataFrame, rare: int = RARE, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness to it and to the next text.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next document is by
    descending id; a null text is empty; equal texts have equal fingerprints. A table of one row is its own next.
    """
    band, count = lexicon(docs, rare, common)
    shared = docs.sparkSession.sparkContext.broadcast(band)
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = shared.value
        before: tuple | None = None
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                out = []
                columns = [c.to_pylist() for c in batch.slice(first, SLICE).columns]
                for borrowed, number, _, doc_id, text in zip(*columns, strict=True):
                    text = text or ""
                    own = fingerprint(text, lexical)
                    if before is not None and before[0] == number:
                        _, earlier_id, earlier, mark = before
                        changed = edited(earlier, text)
                        print_ = fingerprint(changed, lexical)
                        out.append((
                            earlier_id, len(earlier), hashlib.sha256(changed.encode()).hexdigest(), str(mark),
                            str(print_), likeness(mark, print_), likeness(mark, own),
                        ))
                    before = None if borrowed else (number, doc_id, text, own)
                if out:
                    yield record_batch(out, target)

    return with_next(docs, count, block).mapInArrow(run, schema)
