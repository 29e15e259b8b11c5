import hashlib

import pytest
from helpers import SCHEMA, row

from tabscope.llm import suffix_dedup


def brute(rows, match=50):
    """(id, bytes, removed, runs, digest of the rest), from the definition."""
    holders = {}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for i in range(len(data) - match + 1):
            key = data[i : i + match]
            holders[key] = min(holders.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - match + 1):
            if holders[data[i : i + match]] < doc_id:
                gone[i : i + match] = [True] * match
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("bucket", "block", "many"), [(1_000_000, 2_000_000, 1000), (300, 400, 3)])
def test_same_bytes_as_brute_force(docs, rows, monkeypatch, bucket, block, many):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "MANY_SPANS", many)
    found = suffix_dedup.digests(docs).collect()
    assert sorted(map(tuple, found)) == brute(rows)
    assert any(r["n_removed"] for r in found)


def test_nothing_repeated_rows_and_missing_ids(spark, nothing):
    assert suffix_dedup.digests(nothing).count() == 0
    text = "a passage that is certainly longer than fifty bytes in all"
    rows = [row(1, text), row(1, text), row(2, text + "!"), row(None, text), row(None, None)]
    found = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(text)
    assert found == {(1, n, 0), (2, n + 1, n), (None, n, n), (None, 0, 0)}


def test_only_whole_characters_go(spark):
    text = "é" * 40  # 80 bytes
    rows = [row(1, "x" + text), row(2, text + "y"), row(3, None), row(4, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert kept == {1: "x" + text, 2: "y", 3: None, 4: ""}
    assert suffix_dedup.without_repeats(df).columns == df.columns
