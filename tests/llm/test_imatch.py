import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, prose, row

from tabscope.llm import imatch


@pytest.mark.parametrize("block", [1000, 7])
def test_edits_and_neighbours(docs, rows, block):
    found = {r["doc_id"]: r for r in imatch.fingerprint_edits(docs, rare=100, common=3, block=block).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    marks = {}
    for i, (doc_id, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        r = found[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert marks.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if changed == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        if following == text:
            assert r["near_next"] == 1
    prose = [found[i] for i in range(40) if found[i]["n_chars"] > 200]
    assert sum(r["near_edited"] for r in prose) > 5 * sum(r["near_next"] for r in prose)


def test_few_rows(spark, nothing):
    assert imatch.fingerprint_edits(nothing).count() == 0
    (alone,) = imatch.fingerprint_edits(spark.createDataFrame([row(3, "one two three")], SCHEMA)).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"one two tone ").hexdigest() and alone["near_next"] == 1
    rows = [row(3, "abc"), row(3, "abc"), row(None, "xyz"), row(1, None)]
    found = imatch.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["n_chars"] for r in found) == [0, 3, 3, 3]
    last = next(r for r in found if r["doc_id"] is None)  # missing ids come last, followed by the first
    assert last["edited_sha256"] == hashlib.sha256(b"xya").hexdigest()


def test_a_large_group_of_copies_keeps_its_terms(spark):
    source = random.Random(5)
    text = " ".join("copied%d" % i for i in range(90))
    rows = [row(i, text if i % 3 == 0 else prose(source, 60) + " own%d" % i) for i in range(300)]
    rows += [row(300, text.replace("copied80", "changed")), row(301, None), row(302, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    distinct = {r[1] or "" for r in rows}
    times = Counter(t for own in distinct for t in imatch.terms(own).tolist())
    band, count = imatch.lexicon(df)
    assert count == len(rows)
    assert band.tolist() == sorted(t for t, n in times.items() if len(distinct) / 8192 <= n <= len(distinct) / 20)
    assert np.isin(imatch.terms(text), band).all()
    found = {r["doc_id"]: r for r in imatch.fingerprint_edits(df).collect()}
    copies = [found[i] for i in range(3, 300, 3)]  # each followed by another text
    assert sum(r["near_edited"] for r in copies) / len(copies) > 0.2
    assert found[300]["near_next"] < 1 and imatch.likeness(
        imatch.fingerprint(text, band), imatch.fingerprint(text.replace("copied80", "changed"), band)
    ) > 0.7


@pytest.mark.parametrize("size", [300, 3_000, 30_000, 300_000])
def test_likeness_does_not_depend_on_length(size):
    lexical = np.sort(np.concatenate([imatch.terms(" ".join(f"{k}w{i}" for i in range(size))) for k in "abc"]))
    own, following, other = (" ".join(f"{k}w{i}" for i in range(size)) for k in "abc")
    text = imatch.fingerprint(own, lexical)
    near = imatch.likeness(text, imatch.fingerprint(imatch.edited(own, following), lexical))
    one = imatch.likeness(text, imatch.fingerprint(own.replace("aw7 ", "cw7 "), lexical))
    assert near > 0.15 and one > 0.7
    assert imatch.likeness(text, imatch.fingerprint(other, lexical)) < 0.05


def test_texts_of_more_than_32_000_characters(spark):
    source = random.Random(11)
    rows = [row(i, " ".join("t%d" % source.randrange(9_000) for _ in range(9_000 if i < 6 else 60))) for i in range(60)]
    found = {r["doc_id"]: r for r in imatch.fingerprint_edits(spark.createDataFrame(rows, SCHEMA), common=2).collect()}
    assert all(found[i]["n_chars"] > 32_000 for i in range(6))
    near = [found[i]["near_edited"] for i in range(1, 6)]
    assert sum(near) / len(near) > 0.2
