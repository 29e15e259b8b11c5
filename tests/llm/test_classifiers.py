import random

import numpy as np
import pytest
from helpers import SCHEMA, row, words_of
from pyspark.sql import functions as F

from tabscope.llm import language, linear, quality

SAMPLES = {
    "en": "the and of that with this from have which would there their been when will",
    "de": "der und die das nicht mit sich auch auf für werden einer über nach schon",
    "fr": "les des une dans pour que qui est pas sur avec plus par cette être",
    "es": "los las una para que con por como más pero sus esta entre cuando muy",
}


def sentences(language_, source, words=40):
    return " ".join(source.choice(SAMPLES[language_].split()) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    source = random.Random(4)
    rows = [row(i, sentences(lang, source), lang) for i in range(160) for lang in [list(SAMPLES)[i % 4]]]
    rows += [row(900, None, "en"), row(901, "12 .. 34", "de"), row(902, sentences("fr", source), None), row(903, "", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_languages_of_held_out_rows(spoken):
    found = language.identify(spoken, language.train(spoken), ["doc_id", "lang"]).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert all(r["lang_pred"] == r["lang"] for r in found if r["doc_id"] < 900)
    assert all(0 < r["score"] <= 1 for r in found if r["doc_id"] < 900)
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "fr", "und"]


def test_held_out_rows_are_not_learned_from(spoken):
    swapped = spoken.withColumn("lang", F.when(language.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    found = language.identify(swapped, language.train(swapped)).select("lang_pred").distinct().collect()
    assert {r[0] for r in found} == {"en", "de", "fr", "es", "und"}


def test_language_of_few_rows(spark, nothing):
    assert language.train(nothing) is None
    assert language.identify(nothing, None).count() == 0
    one = spark.createDataFrame([row(1, "hello there", "en"), row(2, "salut", None)], SCHEMA)
    assert {r["lang_pred"] for r in language.identify(one, language.train(one)).collect()} == {"en"}
    unlearned = language.identify(one, None).first()
    assert (unlearned["lang_pred"], unlearned["score"]) == ("und", 0.0)
    assert language.family_of("pt-BR") == language.family_of("fr") != language.family_of("sv")


def test_sample_is_bounded(spoken):
    drawn = language.training_sample(spoken, 5, 100).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in drawn} == dict.fromkeys(SAMPLES, 5)


def brute_counts(text):
    words = words_of(text, lower=False)
    lines = [x for x in (text or "").split("\n") if words_of(x, lower=False)]
    seen, twice = {}, set()
    for i in range(len(words) - 7):
        window = tuple(words[i : i + 8])
        if window in seen:
            twice |= set(range(i, i + 8)) | set(range(seen[window], seen[window] + 8))
        seen.setdefault(window, i)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice))


def test_plain_counts(docs, rows):
    found = {r["doc_id"]: r for r in quality.score(docs, None).collect()}
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        counts = brute_counts(text)
        assert tuple(r)[1:6] == counts, doc_id
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and r["kept"] != r["base_failed"]
    lines = "a b\n a b\na b\n\n\na b\n"
    assert quality.count(lines.encode()).n_dup_lines == brute_counts(lines)[3] == 2


def test_learned_verdict(spark, nothing):
    source = random.Random(6)
    good = [(i, sentences("en", source), 1) for i in range(60)]
    bad = [(100 + i, " ".join(w + "***" for w in sentences("en", source).split()), 0) for i in range(60)]
    df = spark.createDataFrame([row(i, t) for i, t, _ in good + bad], SCHEMA)
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad if i % 2], "doc_id long, quality int")
    found = quality.score(df, quality.train(df, labels)).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in found)
    assert quality.train(df, labels.where("quality = 1")) is None
    assert quality.train(nothing, labels) is None and quality.score(nothing, None).count() == 0


def test_calibration_is_monotone_and_fits():
    source = np.random.default_rng(1)
    margins = source.normal(size=2000)
    signs = np.where(source.random(2000) < linear.sigmoid(3 * margins + 0.5), 1.0, -1.0)
    slope, offset = linear.calibrate(margins, signs)
    assert abs(slope - 3) < 0.5 and abs(offset - 0.5) < 0.25
