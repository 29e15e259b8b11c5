import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import prose, words_of

from tabscope.llm import ppm


@pytest.fixture(scope="module")
def scores(docs):
    return {r["doc_id"]: r for r in ppm.score(docs).collect()}


def training(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 != 0


def test_word_model(scores, rows):
    tokens = {r[0]: [*words_of(r[1]), None] for r in rows}
    counts = Counter(t for doc_id, own in tokens.items() if training(doc_id) for t in own)
    total, kinds = sum(counts.values()), len(counts)
    for doc_id, own in tokens.items():
        r = scores[doc_id]
        want = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9, abs_tol=1e-9) and r["held_out"] != training(doc_id)


def brute_ppm(texts, text):
    """PPM of order 3 with method C and exclusion, symbol by symbol."""
    seen = [Counter() for _ in range(4)]
    padded = lambda t: b"\0\0\0" + t.encode().translate(ppm.LOWER) + bytes((ppm.END,))
    for t in texts:
        data = padded(t)
        for i in range(3, len(data)):
            for k in range(4):
                seen[k][data[i - k : i], data[i]] += 1
    total, data = 0.0, padded(text)
    for i in range(3, len(data)):
        chances, mass, excluded = np.zeros(256), 1.0, set()
        for k in (3, 2, 1, 0):
            every = {s: n for s in range(256) if (n := seen[k][data[i - k : i], s])}
            own = {s: n for s, n in every.items() if s not in excluded}
            if own:
                whole = sum(own.values()) + len(own)
                for s, n in own.items():
                    chances[s] += mass * n / whole
                mass *= len(own) / whole
            excluded |= set(every)
        rest = [s for s in range(256) if s not in excluded]
        chances[rest] += mass / max(1, len(rest))
        total += math.log10(chances[data[i]] / chances.sum())
    return total


def test_ppm_of_short_texts(spark, rows):
    short = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) < 120][:14]
    df = spark.createDataFrame(short, "doc_id long, text string")
    texts = [t for i, t in short if training(i)]
    for r in ppm.score(df).collect():
        assert math.isclose(r["score"], brute_ppm(texts, dict(short)[r["doc_id"]]), rel_tol=1e-5), r


def test_joined_contexts(spark, rows, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT_CONTEXTS", 20)
    short = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) < 120][:14]
    df = spark.createDataFrame(short, "doc_id long, text string")
    texts = [t for i, t in short if training(i)]
    assert ppm.rare_distributions(ppm.corpus_counts(df), ppm.lower_orders(ppm.corpus_counts(df))).count() > 50
    for r in ppm.score(df).collect():
        assert math.isclose(r["score"], brute_ppm(texts, dict(short)[r["doc_id"]]), rel_tol=1e-5), r


def test_minority_language(spark):
    source = random.Random(4)
    rows = [(i, prose(source, 600)) for i in range(70)]
    rows += [(100 + i, " ".join("".join(source.choice("äöüßqxyzjkvw") for _ in range(5)) for _ in range(40))) for i in range(20)]
    rows += [(200 + i, t) for i, t in enumerate(r[1] for r in rows[70:75])]  # repeated texts under other ids
    texts = [t for i, t in rows if training(i)]
    assert sum(len(t.encode()) + 1 for t in texts) > 100_000
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS score", "3 AS context")
    counts = ppm.corpus_counts(df.where(~ppm.held_out("doc_id", 10)))
    assert ppm.rare_distributions(counts, ppm.lower_orders(counts)).count() > 100
    scores = {r["doc_id"]: r["score"] for r in ppm.score(df).collect()}
    assert len(scores) == len(rows)
    for doc_id in (0, 101, next(i for i, _ in rows if i >= 100 and not training(i))):
        assert math.isclose(scores[doc_id], brute_ppm(texts, dict(rows)[doc_id]), rel_tol=1e-5)


def test_distributions_sum_to_one(docs):
    trie = ppm.build_trie(ppm.corpus_counts(docs))
    assert np.allclose((10.0 ** trie.table.astype(float)).sum(axis=1), 1.0, atol=1e-4)


def test_learned_texts_are_likelier(scores):
    assert scores[408]["score"] / scores[408]["n_tokens"] > 3 * scores[409]["score"] / scores[409]["n_tokens"]


def test_nothing_to_learn_from(spark, nothing):
    assert ppm.score(nothing).count() == 0
    held = next(i for i in range(100) if not training(i))
    (r,) = ppm.score(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert math.isclose(r["score"], -5 * math.log10(256), rel_tol=1e-5)
