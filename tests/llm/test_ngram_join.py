import random

import pytest
from helpers import SCHEMA, prose, row, words_of

from tabscope.llm import ngram_join


def shingles(text, size):
    words = words_of(text)
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [(r[0], shingles(r[1], size)) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(sets):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(s), smallest[root(i)]) for i, (doc_id, s) in enumerate(sets))


def found(df, **options):
    return sorted(map(tuple, ngram_join.components(df, **options).collect()))


@pytest.mark.parametrize(("size", "percent", "frequent"), [(4, 85, 20_000), (5, 80, 10), (2, 60, 4)])
def test_same_components_as_all_pairs(docs, rows, monkeypatch, size, percent, frequent):
    monkeypatch.setattr(ngram_join.frequent_shingles, "__defaults__", (frequent,))
    assert found(docs, size=size, percent=percent) == brute(rows, size, percent)


def test_group_of_near_copies(spark):
    # edits of one base: some link to it, some only to one another, some to nothing
    source = random.Random(8)
    base = prose(source, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(source.randrange(6)):
            words[source.randrange(len(words))] = f"new{source.randrange(40)}"
        rows.append(row(1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, size=3, percent=85) == brute(rows, 3, 85)


def test_nothing_and_repeated_rows(spark, nothing):
    assert found(nothing) == []
    rows = [row(5, "one two three four five six"), row(5, "one two three four five six"), row(2, None), row(3, "ONE two three four five SIX")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(2, 0, 2), (3, 2, 3), (5, 2, 3), (5, 2, 3)]
    lost = spark.createDataFrame([row(None, "a b c d e f"), row(9, "a b c d e f"), row(None, "z")], SCHEMA)
    result = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.components(lost).collect()}
    assert result == {(None, 2, 9), (9, 2, 9), (None, 1, None)}


def test_documents_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(60)]
    changed = [*words[:30], "other", *words[31:]]
    far = [*changed[:10], "another", *changed[11:]]
    rows = [row(None, " ".join(words)), row(9, " ".join(changed)), row(7, "something else entirely different here"), row(None, " ".join(words))]
    result = {(r["doc_id"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()}
    assert result == {(None, 9), (9, 9), (7, 7)}
    # two ids that only a row without one connects
    bridge = [row(2, " ".join(words)), row(None, " ".join(changed)), row(1, " ".join(far))]
    sets = [shingles(r[1], 4) for r in bridge]
    assert 100 * len(sets[0] & sets[2]) < 82 * len(sets[0] | sets[2])
    assert all(100 * len(sets[1] & sets[i]) >= 82 * len(sets[1] | sets[i]) for i in (0, 2))
    result = {(r["doc_id"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(bridge, SCHEMA), 4, 82).collect()}
    assert result == {(2, 1), (None, 1), (1, 1)}
