"""Exact substring dedup by a distributed sort of suffixes at sampled positions.

A byte goes if it is covered by a string of ``match`` bytes that also starts in a document with a smaller id. Sorting
the suffixes of all positions would move many times the input, so only anchors are sorted: of all grams in a window of
``match`` bytes, the one with the smallest hash (leftmost if equal). Equal windows have equal anchors, and neighbouring
windows mostly share theirs. An anchor's span is what all windows with this anchor cover together.

1. Splitters sampled from the anchors' keys (leading bytes, then the gram's hash) range-partition all anchors.
   Equal grams have equal keys and so are never on two sides of a splitter: every comparison across a boundary is one of
   different grams. Each bucket is sorted by gram, span and document, refining ties only, and neighbours are compared.
   A span that a smaller document has goes with all its windows.
2. Where a gram occurs in several documents but in different spans (the edges of a repeated passage), the anchor's
   windows are compared one by one in a second exchange of the same kind.

Before each exchange a task keeps one record of equal ones, of its smallest document, so a passage of a third of all
documents is one record a task. A gram with very many different spans goes to the second exchange directly.
Only keys are exchanged. Texts are dealt into slots by id, and each slot meets what was found for its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.llm.rows import SLICE, free_name, map_rows, record_batch, small_batches
from tabscope.llm.textbytes import Rolling, byte_array, mixed, runs

#: Bytes of a repeated string, and of the grams that anchors are chosen from.
MATCH, GRAM = 50, 24
#: Records of a bucket, on average, and records a task sorts at a time.
BUCKET, BLOCK = 500_000, 1_000_000
#: Different spans of one gram in a block from which on they skip the first exchange.
MANY_SPANS = 1000
#: Documents whose anchors give the splitters.
SPLITTER_DOCUMENTS = 20_000
#: Bytes of the exchanged keys: what groups records (beside the bucket), and what tells them apart.
GROUP, ITEM = 4, 5
#: Bytes of text in a slot, on average, and those worked on at a time.
SLOT, PORTION = 8_000_000, 500_000

_U = np.uint64
_LAST = (1 << 63) - 1


class Anchors:
    """Windows of some texts with the same anchor: their text, first and last window, keys.

    Places are those in all texts side by side; no window reaches over the end of its text.
    """

    def __init__(self, texts: list[bytes], match: int) -> None:
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = self.ends - [len(t) for t in texts]
        self.raw = byte_array(b"".join(texts))
        inside = np.ones(max(0, len(self.raw) - match + 1), bool)
        for begin, end in zip(self.begins.tolist(), self.ends.tolist(), strict=True):
            inside[max(begin, end - match + 1) : end] = False
        windows = np.flatnonzero(inside)
        if not len(windows):
            self.text = self.first = self.last = np.zeros(0, np.int64)
            self.gram = self.span = self.lead = np.zeros(0, _U)
            return
        self.rolling = Rolling(self.raw)
        grams = self.rolling.plain_grams(GRAM)
        low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
        size, width = 1, match - GRAM + 1
        while size < width:  # minimum of ever wider windows
            step = min(size, width - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        low = low[windows]
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        self.first = windows[np.concatenate(([0], cuts))]
        self.last = windows[np.concatenate((cuts, [len(low)])) - 1]
        anchor = (low[np.concatenate(([0], cuts))] & _U(0xFFFFFFFF)).astype(np.int64)
        self.text = np.searchsorted(self.ends, self.first, side="right")
        self.gram = mixed(grams[anchor])
        span = self.rolling.spans(self.first, self.last + match)
        self.span = mixed(span + (anchor - self.first).astype(_U)) >> _U(64 - 8 * ITEM)
        self.lead = leading(self.raw, anchor)

    @property
    def key(self) -> np.ndarray:
        return order_key(self.lead, self.gram)

    @property
    def group(self) -> np.ndarray:
        return self.gram & _U((1 << 8 * GROUP) - 1)


def leading(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The five bytes from each place on, as numbers in byte order."""
    total = np.zeros(len(at), _U)
    for k in range(5):
        total = total << _U(8) | raw[at + k].astype(_U)
    return total


def order_key(lead: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Leading bytes, then bits of the hash of what follows; fits a signed number."""
    return lead << _U(23) | gram >> _U(41)


class Windows:
    """Single windows of some texts: the hash of a window, and one of its halves' hashes."""

    def __init__(self, own: Anchors, starts: np.ndarray, match: int) -> None:
        self.starts = starts
        self.text = np.searchsorted(own.ends, starts, side="right")
        if not len(starts):
            self.key = self.group = self.item = np.zeros(0, _U)
            return
        middle, end = starts + match // 2, starts + match
        one = own.rolling.spans(starts, end)
        two = mixed(own.rolling.spans(starts, middle) * _U(0xC2B2AE3D27D4EB4F) ^ own.rolling.spans(middle, end))
        self.key = order_key(leading(own.raw, starts), one)
        self.group = one & _U((1 << 8 * GROUP) - 1)
        self.item = two >> _U(64 - 8 * ITEM)


def covered(firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """All windows from each first to its last."""
    lengths = lasts - firsts + 1
    return np.repeat(lasts - np.cumsum(lengths) + 1, lengths) + np.arange(lengths.sum())


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of numbers, all highest ones first: sorted numbers compress well this way."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    cells = np.zeros((len(data) // width, 8), np.uint8)
    cells[:, 8 - width :] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return cells.view(">u8").ravel().astype(_U)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key; runs of equal values are ordered by the next ones, and only they are touched again."""
    order = np.argsort(keys[0])
    if len(keys) > 1:
        values = keys[0][order]
        same = values[1:] == values[:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if len(at):
            part = order[at]
            order[at] = part[np.lexsort([k[part] for k in reversed(keys)])]
    return order


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted record differs from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def sorted_records(
    group: np.ndarray, item: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of records; and, in that order: first of its item, whether a smaller owner has the item, number of
    different items of its group (0 if one owner has them all).
    """
    order = multikey_order([group, item, owner])
    group, item, owner = group[order], item[order], owner[order]
    first, new = changes(group, item), changes(group)
    runs_of_items = np.flatnonzero(first)
    lowest = np.repeat(owner[runs_of_items], np.diff(np.append(runs_of_items, len(owner))))
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(owner)))
    if not len(begins):
        return order, first, first, sizes
    items = np.add.reduceat(first.astype(np.int64), begins)
    several = np.minimum.reduceat(owner, begins) < np.maximum.reduceat(owner, begins)
    return order, first, owner > lowest, np.repeat(np.where(several, items, 0), sizes)


EXCHANGED = "bucket int, kind int, documents binary, owners binary, groups binary, items binary"
#: Items of some documents: for each kind, how many each of them has, and all of them in order.
FOUND = "slot bigint, places binary, wholes binary, whole binary, parts binary, part binary"
RECORDS, WHOLE, PART = range(3)
_PRIME, _FACTOR = 2_147_483_647, 48_271


def slot_of(place: Column, slots: int) -> Column:
    """The slot of a document; ids in steps are dealt evenly, too."""
    return F.pmod(F.pmod(F.pmod(place, F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)), F.lit(slots)).cast("bigint")


def slots_of(places: np.ndarray, slots: int) -> np.ndarray:
    return places % _PRIME * _FACTOR % _PRIME % slots


class Block:
    """Records of one task, combined and cut by the splitters before they are exchanged."""

    def __init__(self, splitters: np.ndarray, edges: bool) -> None:
        self.splitters, self.edges, self.number = splitters, edges, 0
        self._clear()

    def _clear(self) -> None:
        self.places: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, places: list[int], text: np.ndarray, key: np.ndarray, group: np.ndarray, item: np.ndarray) -> None:
        """Records of some texts; ``text`` is each record's number in ``places``."""
        if len(key):
            self.parts.append((key, group, item, text + len(self.places)))
            self.places += places
            self.size += len(key)

    def rows(self) -> Iterator[tuple]:
        """Rows of ``EXCHANGED``; empties the block."""
        if not self.size:
            return
        key, group, item, owner = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        places = np.array(self.places, np.int64)
        self._clear()
        self.number += 1
        owner = places[owner]
        order, first, later, items = sorted_records(group, item, owner)
        key, group, item, owner = key[order], group[order], item[order], owner[order]
        aside = self.number % (len(self.splitters) + 1)
        if later.any():
            yield aside, WHOLE, *packed(owner[later], None, item[later])
        if self.edges:
            many = items >= MANY_SPANS
            if (many & first).any():
                yield aside, PART, *packed(owner[many & first], None, item[many & first])
            first &= ~many | changes(group)  # one record stays, so that others of the gram know
        key, group, item, owner = key[first], group[first], item[first], owner[first]
        bucket = np.searchsorted(self.splitters, key.astype(np.int64), side="right")
        order = np.argsort(bucket, kind="stable")  # keeps groups in order
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), RECORDS, *packed(owner[part], group[part], item[part])


def packed(owner: np.ndarray, group: np.ndarray | None, item: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    places, at = np.unique(owner, return_inverse=True)
    width = 2 if len(places) <= 1 << 16 else 4
    return (places.tobytes(), bytes((width,)) + planes(at, width), planes(group, GROUP) if group is not None else b"",
            planes(item, ITEM))


def unpacked(places: bytes, owners: bytes, groups: bytes, items: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = from_planes(owners[1:], owners[0]).astype(np.int64)
    return np.frombuffer(places, np.int64)[at], from_planes(groups, GROUP), from_planes(items, ITEM)


def by_slot(whole: tuple[np.ndarray, np.ndarray], part: tuple[np.ndarray, np.ndarray], slots: int) -> list[dict]:
    """Rows of ``FOUND`` from (document, item) pairs of both kinds."""
    places = np.unique(np.concatenate((whole[0], part[0])))
    places = places[np.argsort(slots_of(places, slots), kind="stable")]
    numbers = slots_of(places, slots)
    cuts = np.flatnonzero(np.diff(numbers)) + 1
    rows = [{"slot": int(numbers[i[0]]), "places": places[i].tobytes()} for i in np.split(np.arange(len(places)), cuts) if len(i)]
    rank = np.argsort(places)  # place in order of slots, by document
    for names, (owner, item) in ((("wholes", "whole"), whole), (("parts", "part"), part)):
        at = rank[np.searchsorted(places[rank], owner)]
        counts = np.bincount(at, minlength=len(places)).astype(np.int32)
        cells = little(item[np.argsort(at, kind="stable")])
        ends = np.concatenate(([0], np.cumsum(counts)))
        bounds = [0, *cuts, len(places)]
        for row, a, b in zip(rows, bounds, bounds[1:], strict=False):
            row |= {names[0]: counts[a:b].tobytes(), names[1]: cells[ends[a] : ends[b]].tobytes()}
    return rows


def little(items: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ITEM])


def from_little(data: bytes) -> np.ndarray:
    cells = np.zeros((len(data) // ITEM, 8), np.uint8)
    cells[:, :ITEM] = np.frombuffer(data, np.uint8).reshape(-1, ITEM)
    return cells.view("<u8").ravel().astype(_U)


class Items:
    """Items by document, from the rows of one slot."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]], places: np.ndarray) -> None:
        """``places`` are the slot's documents, sorted."""
        owners = [np.repeat(np.frombuffer(p, np.int64), np.frombuffer(c, np.int32)) for p, c, _ in rows]
        owner = np.searchsorted(places, np.concatenate([np.zeros(0, np.int64), *owners]))
        item = np.concatenate([np.zeros(0, _U), *(from_little(i) for *_, i in rows)])
        self.keys = np.sort(owner.astype(_U) << _U(8 * ITEM) | item)

    def have(self, rank: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which (document number, item) pairs are there."""
        return among(rank.astype(_U) << _U(8 * ITEM) | item, self.keys)


def among(values: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(items):
        return np.zeros(len(values), bool)
    return items[np.minimum(np.searchsorted(items, values), len(items) - 1)] == values


def exchanged(records: DataFrame, edges: bool, slots: int) -> DataFrame:
    """Bring the records of each bucket together and deal what is found by the documents' slots.

    ``whole`` are items that a smaller document has; ``part`` (with ``edges``) those whose group has other items.
    """
    target = to_arrow_schema(T.StructType.fromDDL(FOUND))

    def bucket(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blobs = list(zip(*(table.column(c).to_pylist() for c in ("documents", "owners", "groups", "items")), strict=True))
        sides: dict[int, list] = {RECORDS: [], WHOLE: [], PART: []}
        for kind, blob in zip(kinds, blobs, strict=True):
            sides[kind].append(unpacked(*blob))
        nothing = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
        owner, group, item = (np.concatenate(c) for c in zip(nothing, *sides[RECORDS], strict=True))
        order, first, later, items = sorted_records(group, item, owner)
        owner, item = owner[order], item[order]
        found = {WHOLE: [(owner[later], item[later])], PART: []}
        if edges:
            edge = first & (items > 1)
            found[PART].append((owner[edge], item[edge]))
        for kind in (WHOLE, PART):
            found[kind] += [(o, i) for o, _, i in sides[kind]] + [(nothing[0], nothing[1])]
        whole, part = (tuple(np.concatenate(c) for c in zip(*found[kind], strict=True)) for kind in (WHOLE, PART))
        return pa.Table.from_pylist(by_slot(whole, part, slots), schema=target)

    return records.groupBy("bucket").applyInArrow(bucket, FOUND)


EXCHANGED_SCHEMA = pa.schema([
    ("bucket", pa.int32()), ("kind", pa.int32()),
    *((name, pa.binary()) for name in ("documents", "owners", "groups", "items")),
])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(EXCHANGED_SCHEMA.names, r, strict=True)) for r in rows], schema=EXCHANGED_SCHEMA)


def portions(texts: list[bytes | None]) -> Iterator[slice]:
    """Slices of neighbouring texts of about ``PORTION`` bytes; a longer text is alone."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or b"") > PORTION:
            yield slice(first, i)
            first, size = i, 0
        size += len(text or b"")
    if first < len(texts):
        yield slice(first, len(texts))


def anchor_records(texts: DataFrame, splitters: list[int], match: int) -> DataFrame:
    """The anchors of all texts as rows of ``EXCHANGED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(np.array(splitters, np.int64), True)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                places, texts = (c.to_pylist() for c in batch.slice(start, SLICE).columns)
                for part in portions(texts):
                    own = Anchors([t or b"" for t in texts[part]], match)
                    block.add(places[part], own.text, own.key, own.group, own.span)
                    if block.size >= BLOCK:
                        yield from (as_batch([r]) for r in block.rows())
        yield from (as_batch([r]) for r in block.rows())

    small_batches(texts.sparkSession)
    return texts.select("place", "text").mapInArrow(run, EXCHANGED)


def find_splitters(texts: DataFrame, match: int) -> tuple[list[int], int]:
    """Keys that cut the anchors into buckets, from the anchors of documents drawn by a hash of the id; and the slots."""
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    slots = (size.bytes or 0) // SLOT + 1
    buckets = int((size.bytes or 0) * 2 / (match - GRAM + 2) / BUCKET) + 1
    if buckets == 1:
        return [], slots
    draw = F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SPLITTER_DOCUMENTS / size.n)))
    keys = map_rows(
        texts.where(draw), ["text"], "key bigint",
        lambda: lambda text: [(k,) for k in Anchors([text or b""], match).key[::8].tolist()], many=True,
    )
    cuts = keys.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
    return sorted(set(cuts or ())), slots


def edge_windows(own: Anchors, whole: np.ndarray, part: np.ndarray, match: int) -> Windows:
    """Windows of the anchors whose span is not found whole, but whose gram is found elsewhere."""
    edge = part & ~whole
    return Windows(own, covered(own.first[edge], own.last[edge]), match)


def dedup(
    docs: DataFrame, finish: Callable[..., tuple], schema: str, keep: list[str], match: int = MATCH
) -> DataFrame:
    """Find the repeated bytes of each document and pass them to ``finish(*keep, text, gone)``, which returns a row.

    ``text`` are the UTF-8 bytes (none for a null), ``gone`` is true for each byte that is covered by a string of
    ``match`` bytes that also starts in a document with a smaller ``doc_id``. Texts under ``match`` bytes lose nothing.
    Documents of the same id, and those without one (which come after all others), are not smaller than one another;
    repeated rows come out each.
    """
    place = F.coalesce("doc_id", F.lit(_LAST)).alias("place")
    rest = F.struct(*(F.col(f"`{k}`") for k in keep)).alias("rest")
    texts = docs.select(place, F.col("text").cast("binary").alias("text"), rest)
    splitters, slots = find_splitters(texts, match)
    texts = texts.withColumn("slot", slot_of(F.col("place"), slots))
    spans = exchanged(anchor_records(texts, splitters, match), True, slots).withColumn("kind", F.lit(RECORDS))
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def items(found: pa.Table, kind: int, counts: str, name: str, places: np.ndarray) -> Items:
        columns = zip(*(found.column(c).to_pylist() for c in ("kind", "places", counts, name)), strict=True)
        return Items([(p, c, i) for k, p, c, i in columns if k == kind], places)

    def slot_parts(own_texts: pa.Table, found: pa.Table) -> Iterator[tuple]:
        """Portions of a slot's texts: which, their ids, numbers, bytes, anchors; spans found whole and in part."""
        every = own_texts.column("place").to_numpy()
        ranks = np.unique(every)
        whole = items(found, RECORDS, "wholes", "whole", ranks)
        part = items(found, RECORDS, "parts", "part", ranks)
        for first in range(0, len(every), SLICE):
            texts = own_texts.column("text").slice(first, SLICE).to_pylist()
            for at in portions(texts):
                chosen = [t or b"" for t in texts[at]]
                places = every[first + at.start : first + at.stop]
                rank = np.searchsorted(ranks, places)
                own = Anchors(chosen, match)
                copied = whole.have(rank[own.text], own.span)
                yield first + at.start, places, rank, chosen, own, copied, part.have(rank[own.text], own.span)

    def questions(own_texts: pa.Table, found: pa.Table) -> pa.Table:
        block, rows = Block(np.array(splitters, np.int64), False), []
        for _, places, _, _, own, copied, shared in slot_parts(own_texts, found):
            windows = edge_windows(own, copied, shared, match)
            block.add(places.tolist(), windows.text, windows.key, windows.group, windows.item)
            if block.size >= BLOCK:
                rows += block.rows()
        rows += block.rows()
        return pa.Table.from_batches([as_batch(rows)] if rows else [], schema=EXCHANGED_SCHEMA)

    # both joins read the same slots, so texts are shuffled once
    windows = texts.groupBy("slot").cogroup(spans.groupBy("slot")).applyInArrow(questions, EXCHANGED)
    single = exchanged(windows, False, slots).withColumn("kind", F.lit(WHOLE))

    def answers(own_texts: pa.Table, found: pa.Table) -> pa.Table:
        alone = items(found, WHOLE, "wholes", "whole", np.unique(own_texts.column("place").to_numpy()))
        out = []
        for first, places, rank, chosen, own, copied, shared in slot_parts(own_texts, found):
            edge = edge_windows(own, copied, shared, match)
            starts = edge.starts[alone.have(rank[edge.text], edge.item)]
            begins = np.concatenate((own.first[copied], starts))
            ends = np.concatenate((own.last[copied], starts)) + match
            size = len(own.raw) + 1
            gone = np.cumsum(np.bincount(begins, minlength=size) - np.bincount(ends, minlength=size))[:-1] > 0
            kept = own_texts.column("rest").slice(first, len(places)).to_pylist()
            for row, text, a, b in zip(kept, chosen, own.begins, own.ends, strict=True):
                out.append(finish(*(row[k] for k in keep), text, gone[a:b]))
        return pa.Table.from_batches([record_batch(out, target)] if out else [], schema=target)

    return texts.groupBy("slot").cogroup(spans.unionByName(single).groupBy("slot")).applyInArrow(answers, schema)


def digests(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` of the remaining bytes."""

    def finish(doc_id: int | None, text: bytes, gone: np.ndarray) -> tuple:
        kept = byte_array(text)[~gone].tobytes()
        return doc_id, len(text), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest()

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return dedup(docs, finish, schema, ["doc_id"], match)


def without_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; all other columns as they are.

    A character goes only with all its bytes, so what is left is a valid text. A null text stays null.
    """
    names = [c for c in docs.columns if c != "text"]

    def finish(*values: Any) -> tuple:
        *kept, is_null, text, gone = values
        raw = byte_array(text)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        if len(heads):
            whole = np.minimum.reduceat(gone.astype(np.int8), heads)
            gone = np.repeat(whole, np.diff(np.append(heads, len(raw)))).astype(bool)
        return *kept, None if is_null else raw[~gone].tobytes().decode("utf-8", "replace")

    null = free_name("null_text", docs.columns)
    marked = docs.withColumn(null, F.col("text").isNull())
    fields = [*(docs.schema[c] for c in names), T.StructField("text", T.StringType())]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return dedup(marked, finish, schema, [*names, null], match).select(*(F.col(f"`{c}`") for c in docs.columns))
