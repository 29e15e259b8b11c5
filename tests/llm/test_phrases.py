import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, SCHEMA
from pyspark.sql import functions as F

from tabscope.llm import phrases

PIECES = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def brute(rows, max_words=3, min_count=10, top=2000):
    counts = {}
    for _, text, lang, *_ in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in PIECES.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            for size in range(1, max_words + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = set()
    for lang, own in counts.items():
        n = sum(c for phrase, c in own.items() if len(phrase) == 1)
        candidates = {p: c for p, c in own.items() if len(p) > 1 and c >= min_count}
        dropped = {
            p[i : i + size] for p, c in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
            if 100 * c >= 50 * candidates[p[i : i + size]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return found


@pytest.fixture(scope="module")
def corpus(rows):
    source = random.Random(8)
    words = ["the", "The", "of", "New", "York", "city", "é", "日本", "a\x1cb", "x\xa0y", "nul\x00", "don't", "-"]
    rows = [(*r[:2], source.choice(["en", "de", None, ""]), *r[3:]) for r in rows]
    ends = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b", " \r\n "]
    rows += [(1000 + i, "".join(source.choice(words) + source.choice(ends[:4] if i % 3 else ends) for _ in range(120)), source.choice(["en", "de", None]), "s", 1) for i in range(60)]
    rows += [(2000 + i, "the only one phrase. the only one", "en", "s", 1) for i in range(25)]
    rows += [(1000, "the of the of", "xx", "s", 1)] * 6
    return rows


@pytest.fixture(scope="module")
def table(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit(3) for c in ("part", "word", "count", "first", "rest", "slice", "phrase", "k", "l", "r", "a")})


def test_against_brute_force(corpus, table):
    found = {tuple(r) for r in phrases.collocations(table).collect()}
    assert found == brute(corpus) and len(found) > 100


def test_longer_phrases_and_a_short_list(corpus, table):
    found = {tuple(r) for r in phrases.collocations(table, max_words=5, min_count=4, top=30).collect()}
    assert found == brute(corpus, 5, 4, 30)


def test_small_windows_blocks_slices_and_merges(spark, corpus, table, monkeypatch):
    monkeypatch.setattr(phrases, "STRIPE_ENTRIES", 3)
    few = table.coalesce(1)
    plain = sorted(map(tuple, phrases.merge(phrases.stripes(few, {}), 10).collect()))
    sliced = phrases.stripes(few, {("en", b"the"): 5, ("en", b"same"): 3}, window=50)
    assert sorted(map(tuple, phrases.merge(sliced, 10, merged=40).collect())) == plain
    assert sliced.where("slice > 0").count() > 0


def test_windows_carry_words_of_a_text_that_goes_on():
    data = b" ".join(b"w%d" % (i % 7) for i in range(400))
    assert [w for b in phrases.blocks(data, 11) for w in b] == data.split()
    held, seen = phrases.Windows(2), Counter()
    for words in phrases.blocks(data, 40):
        held.add("p", words)
        for _, numbers, counted, names in held.flush("p"):
            names = names.to_pylist()
            for size in (2, 3):
                seen.update(tuple(names[n] for n in numbers[i : i + size]) for i in range(len(numbers) - size + 1) if i + size - 1 >= counted)
    words = data.split()
    assert seen == Counter(tuple(words[i : i + size]) for size in (2, 3) for i in range(len(words) - size + 1))


def test_products_beyond_64_bits_are_exact(spark):
    values = [(10**12 + 7, 10**13 + 9, 10**13 + 11), (3, 3, 3), (2**40 + 1, 2**41 + 3, 2**42 + 5), (999_999_999_999_999, 10**15, 10**15)]
    df = spark.createDataFrame(values, "count long, l long, r long")
    assert [r[0] for r in df.select(phrases.score_of("count", "l", "r")).collect()] == [10**6 * a * a // (l * r) for a, l, r in values]


def test_empty_table_and_texts(spark, nothing):
    assert phrases.collocations(nothing).count() == 0
    df = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " .,", "de", "s", 3)], SCHEMA)
    assert phrases.collocations(df).count() == 0
    assert np.array_equal(next(phrases.blocks(b"A.b"))[1:2], [b"."])
