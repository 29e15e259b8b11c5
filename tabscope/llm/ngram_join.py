"""Near copies by the Jaccard similarity of word shingles: a prefix-filter join with adaptive multi-match prefixes.

Shingles have one global order, rare ones first. A document of ``n`` shingles needs at least ``t`` in common with any
partner. Two partners share at least ``m`` of the first ``n - t + m`` shingles of each, for every ``m`` up to ``t``. So
each document may choose its ``m``: a longer prefix reads longer lists, but asks for more shared shingles before a pair
is verified. The choice minimises the estimated cost; a pair needs the smaller of its two choices.

Equal sets are one class from the beginning. Candidate pairs are found in two rounds: in the first, each list of a shingle
is compared with one member of it (the one most likely to be central), which joins large groups without all their
pairs; the second compares what is still in different components, and so loses no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.rows import SLICE, map_rows, octets, small_batches, stored
from tabscope.llm.textbytes import LOWER, Rolling, byte_array, shingles, words

#: Most shared prefix shingles that a document may ask for.
MATCHES = 4
#: Shingles in one of so many documents, or in more, come last in the global order, by frequency; all others come by
#: their hash. There are at most ``FREQUENT`` times as many of them as a document has shingles on average.
FREQUENT = 20_000
#: Cost of verifying one candidate, in list entries read.
VERIFY_COST = 8.0
#: Bits of a set's parity bitmap, which bounds the overlap of two sets from above; and those that list entries carry.
BITMAP = 1024
PARITY = ("parity0", "parity1", "parity2", "parity3")


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased. Fewer words than ``size`` are one shingle."""
    raw = byte_array(text.translate(LOWER))
    return np.unique(shingles(Rolling(raw).spans(*words(raw)), size))


def frequent_shingles(docs: DataFrame, size: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least one in ``frequent`` documents, sorted, and their place by frequency.

    Documents are counted in blocks; a shingle that is frequent in all is frequent in at least one block, and only
    such are summed. Any order of the shingles gives the same links, so a count that misses some blocks does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[np.ndarray] = []
        held = rows = 0

        def block() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(pieces), return_counts=True)
            heavy = times >= max(2, -(-rows // frequent))
            return pa.RecordBatch.from_arrays(
                [pa.array(found[heavy].view(np.int64)), pa.array(times[heavy].astype(np.int64))], ["shingle", "documents"]
            )

        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                for text in batch.column(0).slice(first, SLICE).to_pylist():
                    pieces.append(shingle_set(text or b"", size))
                    held += len(pieces[-1])
                    rows += 1
                if held > 2_000_000:
                    yield block()
                    pieces, held, rows = [], 0, 0
        if pieces:
            yield block()

    small_batches(docs.sparkSession)
    least = max(4.0, docs.count() / frequent)
    sums = docs.select(octets()).mapInArrow(run, "shingle bigint, documents bigint").groupBy("shingle").agg(
        F.sum("documents").alias("documents")
    )
    heavy = sums.where(F.col("documents") >= least).toPandas()  # bounded, see FREQUENT
    heavy["shingle"] = heavy["shingle"].to_numpy(np.int64).view(np.uint64)
    heavy = heavy.sort_values(["documents", "shingle"], ignore_index=True).reset_index().sort_values("shingle")
    return heavy["shingle"].to_numpy(np.uint64), heavy["index"].to_numpy(np.int64)


def ordered(own: np.ndarray, heavy: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    if not len(heavy):
        return own
    at = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
    last = heavy[at] == own
    return np.concatenate((own[~last], own[last][np.argsort(places[at[last]])]))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def bitmap(own: np.ndarray, bits: int = BITMAP) -> bytes:
    """Parity of the number of elements that fall on each bit."""
    counts = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).tobytes()


def required(n: Column, percent: int) -> Column:
    """Least overlap of a set of ``n`` with a partner."""
    return F.ceil(n * percent / 100)


def document_sets(docs: DataFrame, size: int, percent: int, id_column: str) -> DataFrame:
    """``id, n, digest, bitmap, prefix`` of each document; the prefix is long enough for all choices."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))

    def start():
        heavy, places = shared.value

        def work(doc_id: int | None, text: bytes | None) -> tuple:
            own = shingle_set(text or b"", size)
            least = -(-len(own) * percent // 100)
            prefix = ordered(own, heavy, places)[: len(own) - least + MATCHES]
            parity = np.frombuffer(bitmap(own, 64 * len(PARITY)), np.int64).tolist()
            return doc_id, len(own), digest(own), bitmap(own), prefix.view(np.int64), *parity

        return work

    schema = "id bigint, n bigint, digest binary, bitmap binary, prefix array<bigint>, " + ", ".join(
        f"{p} bigint" for p in PARITY
    )
    return map_rows(docs, [F.col(id_column).alias("id"), octets()], schema, start)


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """``shingle, class, n, place, live, level, matches`` and the parities: entries of lists with two classes or
    more, up to each class's choice. ``live`` counts the class's entries in such lists before this one.
    """
    n = F.col("n")
    free = n - required(n, percent)  # shingles that a partner may miss
    entries = classes.select("class", "n", F.posexplode("prefix").alias("place", "shingle")).select(
        "shingle", "class", "n", "place", F.greatest(F.lit(1), F.col("place") - free + 1).alias("level")
    ).where(F.col("level") <= F.least(F.lit(MATCHES), required(n, percent)))
    entries = entries.repartition("shingle")
    lists = entries.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")
    # read(m): entries met by a prefix for m matches; candidates are at most read(m) / m
    read = [F.sum(F.when(F.col("level") <= m, F.col("classes") - 1).otherwise(0)) for m in range(1, MATCHES + 1)]
    costs = [r * (1.0 + VERIFY_COST / m) for m, r in enumerate(read, 1)]
    allowed = F.least(F.lit(MATCHES), required(F.max("n"), percent))
    choice = F.array_min(F.array(*(
        F.when(allowed >= m, F.struct(c.alias("cost"), F.lit(m).alias("matches"))) for m, c in enumerate(costs, 1)
    )))
    own = F.array_sort(F.collect_list(F.struct("place", "shingle", "level")))  # as long as a prefix at most
    chosen = entries.join(lists, "shingle").groupBy("class").agg(
        F.first("n").alias("n"), choice.getField("matches").alias("matches"), own.alias("own")
    ).join(classes.select("class", *PARITY), "class")
    return chosen.select("class", "n", "matches", *PARITY, F.posexplode("own").alias("live", "entry")).select(
        "entry.shingle", "class", "n", "entry.place", "live", "entry.level", "matches", *PARITY
    ).where(F.col("level") <= F.col("matches"))


def may_link(a: str, b: str, percent: int) -> Column:
    """What sizes, parities and the places of a shared shingle allow.

    Two sets differ in at least as many elements as their parities in bits. Before the shared shingle, only shingles
    that stand in the other's prefix too can be shared, and such are in lists of two or more; from it on, at most the
    fewer that are left.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
    most = F.least(F.col(f"{a}.live"), F.col(f"{b}.live")) + rest
    apart = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY), F.lit(0))
    return (
        (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (most * (100 + percent) >= (na + nb) * percent)
        & ((na + nb - apart) * (100 + percent) >= (na + nb) * 2 * percent)
    )


def counted_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` that share as many prefix shingles as the smaller choice of the two.

    A list entry beyond the smaller choice doesn't count.
    """
    matches = F.least("x.matches", "y.matches")
    pairs = pairs.where((F.col("x.level") <= matches) & (F.col("y.level") <= matches)).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"), matches.alias("matches")
    )
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("matches").alias("matches")).where(
        "shared >= matches"
    ).select("a", "b")


def both(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs with the columns of each side's row in ``table``, as ``a_...`` and ``b_...``."""
    for side in ("a", "b"):
        own = table.select(*(F.col(c).alias(side if c == "class" else f"{side}_{c}") for c in table.columns))
        pairs = pairs.join(own, side)
    return pairs


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps allow the overlap: two sets differ in at least as many elements as their bitmaps in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "a_n", "b_n"))
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITMAP // 8)
                    for c in ("a_bitmap", "b_bitmap")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            kept = (na + nb - apart) // 2 * (100 + percent) >= (na + nb) * percent
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    found = both(pairs, classes.select("class", "n", "bitmap")).select("a", "b", "a_n", "b_n", "a_bitmap", "b_bitmap")
    return found.mapInArrow(run, "a bigint, b bigint")


def verified(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, id_column: str
) -> DataFrame:
    """Pairs whose whole sets are similar enough. Sets are made anew from the texts of the classes in question.

    Texts are found by the id of a class; those without an id may belong to a class that has none.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(
        classes.select("class", "digest", F.col("first_id")), "class"
    )
    named = docs.select(F.col(id_column).alias("id"), octets())
    texts = named.join(wanted.select(F.col("first_id").alias("id")).distinct(), "id", "left_semi")
    texts = texts.unionByName(named.where("id IS NULL"))
    sets = map_rows(
        texts, ["text"], "digest binary, elements binary",
        lambda: lambda text: (lambda own: (digest(own), own.tobytes()))(shingle_set(text or b"", size)),
    )
    sets = sets.join(wanted.select("class", "digest"), "digest").groupBy("class").agg(F.first("elements").alias("elements"))

    def start():
        def work(a: int, b: int, left: bytes, right: bytes) -> tuple:
            own, other = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            same = len(np.intersect1d(own, other, assume_unique=True))
            return a, b, 100 * same >= percent * (len(own) + len(other) - same)

        return work

    checked = map_rows(both(pairs, stored(sets, "sets")), ["a", "b", "a_elements", "b_elements"],
                       "a bigint, b bigint, linked boolean", start)
    return checked.where("linked").select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """``class, root``: the smallest class reachable from each class that has a link.

    Alternating stars: every node's larger neighbours, then all its smaller ones, are linked to its smallest neighbour,
    until all components are stars. Each step sums up neighbours by key; no component is ever in one place.
    """

    def star(links: DataFrame, larger: bool) -> DataFrame:
        if larger:
            ends = links.union(links.select("b", "a"))
        else:
            ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        joined = ends.join(smallest, "a")
        if larger:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).union(smallest.select("a", "root"))
        return moved.where("a <> b").distinct()

    def unfinished(links: DataFrame) -> bool:
        """Whether some node has two links, or one up and one down."""
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            links.select("b", F.lit(0), F.lit(1))
        )
        counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not counts.where("up > 1 or (up > 0 and down > 0)").isEmpty()

    links = stored(star(star(links, True), False), "links")
    while unfinished(links):
        links = stored(star(star(links, True), False), "links")
    return links.select(F.col("a").alias("class"), F.col("b").alias("root"))


def with_roots(frame: DataFrame, roots: DataFrame) -> DataFrame:
    return frame.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))


def components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id"
) -> DataFrame:
    """``id_column, n_shingles, component_id`` of each document.

    Documents whose shingle sets (``size`` words each) have a Jaccard similarity of ``percent`` or more are linked;
    ``component_id`` is the smallest id reachable by links. A null or empty text has no shingles and links with
    nothing. Repeated rows and ties come out each; a null id gets a component only through others. Other columns
    are ignored.
    """
    return members(docs, size, percent, id_column).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id"
    )


def set_digests(docs: DataFrame, size: int, columns: list[str], name: str = "digest") -> DataFrame:
    """``columns`` of documents and the digest of their shingle sets, as ``members`` has it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in columns)).schema)

    def start():
        return lambda text, *kept: (*kept, digest(shingle_set(text or b"", size)))

    return map_rows(docs, [octets(), *(F.col(f"`{c}`") for c in columns)], f"{schema}, `{name}` binary", start)


def members(docs: DataFrame, size: int, percent: int, id_column: str) -> DataFrame:
    """``id, n, digest, component_id`` of each document: as ``components``, with the digest of the shingle set."""
    sets = stored(document_sets(docs, size, percent, id_column), "sets")
    classes = sets.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"),
        F.first("prefix").alias("prefix"), *(F.first(p).alias(p) for p in PARITY),
    )
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    lists = stored(postings(classes, percent), "lists")

    def links(pairs: DataFrame) -> DataFrame:
        near = stored(plausible(pairs, classes, percent), "plausible")
        return verified(near, docs, classes, size, percent, id_column)

    # first round: each list against its member whose set begins nearest to the shingle
    hub = F.min(F.struct("place", "class", "n", "live", "level", "matches", *PARITY))
    hubs = lists.groupBy("shingle").agg(hub.alias("hub")).select("shingle", "hub.*")
    x, y = lists.alias("x"), hubs.alias("y")
    near_hub = x.join(y, "shingle").where((F.col("x.class") != F.col("y.class")) & may_link("x", "y", percent))
    first = stored(links(counted_pairs(near_hub)), "hub-links")
    roots = connected(first)

    # second round: pairs between components; a list's largest component is not compared with itself
    labelled = stored(with_roots(lists, roots), "labelled")
    sizes = labelled.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("shingle").agg(
        F.max(F.struct("size", "root")).getField("root").alias("main"), F.count("*").alias("roots")
    ).where("roots > 1").drop("roots")
    mixed_lists = labelled.join(largest, "shingle")
    x, y = mixed_lists.where("root <> main").alias("x"), mixed_lists.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (
        (F.col("y.root") == F.col("y.main")) | (F.col("x.class") < F.col("y.class"))
    )
    more = counted_pairs(x.join(y, "shingle").where(apart & may_link("x", "y", percent)))
    second = stored(links(more), "more-links")
    roots = connected(first.union(second))

    named = with_roots(classes.select("class", "digest", "first_id"), roots)
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("digest", "component_id")
    return sets.select("id", "n", "digest").join(named, "digest", "left").select(
        "id", "n", "digest", F.coalesce("component_id", "id").alias("component_id")
    )
