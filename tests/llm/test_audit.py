import itertools
import random

import pytest
from helpers import SCHEMA, words_of
from pyspark.sql import functions as F

from tabscope.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Apply every order of the filters to every document."""
    smallest = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    facts = {}
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = words_of(text, lower=False)
        failed = "".join(f for f, is_failed in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), doc_id is not None and smallest[text] < doc_id,
        ), strict=True) if is_failed)
        facts.setdefault(lang or "", []).append((failed, doc_id in good, doc_id in toxic))
    found, shares = {}, {}
    for part, docs in facts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order):
                lost = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fails = sum(f in d[0] for d in docs)
                found[part, order, step + 1] = (
                    len(left), len(lost), fails - len(lost), sum(d[0] == f for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost),
                )
                shares[part, f] = shares.get((part, f), 0) + len(lost)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


@pytest.fixture(scope="module")
def case(rows):
    source = random.Random(6)
    rows = [(r[0], r[1], source.choice(["en", "de", None, ""]), *r[3:]) for r in rows]
    rows += [(500 + i, "COPY #1 " * 40, "en", "s", 1) for i in range(30)]  # a hot group of copies, over two parts
    rows += [(490 + i, "COPY #1 " * 40, "de", "s", 1) for i in range(20)]
    rows += [(None, "COPY #1 " * 40, "de", "s", 1), (None, None, None, None, None), (401, "", "fr", "s", 0)]
    rows += [(700, "one", "en", "s", 3), (700, "two", "en", "s", 3), (700, "one", "de", "s", 3), (701, "one", "de", "s", 3)]
    labels = [(r[0], source.choice([0, 1, None]), source.choice([0, 1, None])) for r in rows if source.random() < 0.6]
    labels += [(700, 0, 1), (700, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_all_orders_against_brute_force(spark, case):
    rows, labels = case
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs = docs.withColumns({c: F.lit(7) for c in ("part", "mask", "n", "good", "toxic", "digest", "first", "lowest", "original", "quality")})
    marked = spark.createDataFrame(labels, LABELS).withColumns({c: F.lit(1) for c in ("n", "good", "text", "lang")})
    found = {(r[0], r[1], r[2]): tuple(r)[3:] for r in audit.audit(docs, marked).collect()}
    assert found == brute(rows, labels)


def test_empty_tables(spark, nothing, docs):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(nothing, none).count() == 0
    assert audit.audit(docs, none).where("good_lost + toxic_lost > 0").count() == 0


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), [tuple(range(n))]
        for level in audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == audit.factorial(n)


def test_equal_subdiagrams_are_shared_and_swaps_are_undone():
    source = random.Random(3)
    counts = {mask: (source.randrange(3), 0, 0) for mask in range(32)}
    diagram = audit.Diagram(counts)
    before, steps = [len(level) for level in diagram.nodes], diagram.steps()
    assert before[4] <= 9 and len(diagram.leaves) == 3
    for level in (0, 2, 3, 3, 2, 0):
        diagram.swap(level)
    assert [len(level) for level in diagram.nodes] == before and diagram.steps() == steps and "".join(diagram.order) == "ABCDE"
    assert [len(level) for level in audit.Diagram({0: (9, 1, 2)}).nodes] == [1, 2, 2, 2, 2]
