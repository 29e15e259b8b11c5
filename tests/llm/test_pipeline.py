"""Each stage on troubled documents, and the whole pipeline."""

import os

import corpus_pipeline
import numpy as np
import pytest
from helpers import SCHEMA, row
from pyspark.sql import functions as F
from test_ngram_join import brute

from tabscope.llm import language
from tabscope.llm.rows import scratch, stored, stored_alone
from tabscope.session import shared_folder


def test_stages_keep_the_columns(spark, docs, nothing):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeats", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, "")
        assert result.columns == docs.columns and dict(result.dtypes) == dict(docs.dtypes)
        assert stage(spark, nothing, "").count() == 0


def test_language_stage_drops_what_has_no_language(spark, docs, rows):
    kept = {r[0] for r in corpus_pipeline.by_language(spark, docs, "").select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {400, 401, 402, 411}


def test_language_stage_keeps_letters_without_a_model(spark):
    rows = [row(1, "some words", None), row(2, "12 .. 34", None), row(3, None, None), row(4, "été", None)]
    kept = corpus_pipeline.by_language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_language_stage_keeps_even_decisions(spark, monkeypatch):
    texts = {"en": "the house and the water", "de": "das Haus und das Wasser", "fr": "la maison et les eaux", "es": "la casa y las aguas"}
    rows = np.array([language.features(t.encode()) for t in texts.values() for _ in range(4)], np.float32)
    model = language.Model(rows, np.array([x for x in texts for _ in range(4)], dtype=object))
    for machines in (model.families, *model.inside.values()):  # every pair is decided evenly
        machines.slopes, machines.offsets = ([0.0] * len(machines.pairs) for _ in range(2))
    assert model.predict(b"the casa")[1] == 0.25
    monkeypatch.setattr(language, "train", lambda docs: model)
    kept = corpus_pipeline.by_language(spark, spark.createDataFrame([row(1, "the casa"), row(2, "??")], SCHEMA), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_one_of_each_group_stays(spark, docs, rows):
    kept = sorted(r[0] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").select("doc_id").collect())
    assert kept == [doc_id for doc_id, _, component in brute(rows, 5, 80) if doc_id == component]
    twice = spark.createDataFrame([row(1, "a b c d e f g"), row(1, "a b c d e f g"), row(2, "x"), row(None, "y")], SCHEMA)
    assert sorted(r["text"] for r in corpus_pipeline.one_of_near_copies(spark, twice, "").collect()) == ["a b c d e f g", "x", "y"]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:30], "other", *base[31:]])
    rows = [
        row(1, " ".join(base)), row(5, near), row(5, "ein deutscher Text der niemandes Kopie ist", "de"), row(5, near),
        row(6, "two texts of one id first"), row(6, "and quite another one here second"), row(6, "two texts of one id first"),
        row(None, near), row(8, None), row(8, ""), row(9, " ".join(base)),
    ]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA).withColumns({c: F.lit(1) for c in ("digest", "id", "copy", "repeated")})
        kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.one_of_near_copies(spark, df, "").collect())
        assert kept == sorted([(1, rows[0][1]), (5, rows[2][1]), (6, rows[4][1]), (6, rows[5][1]), (0, near), (8, "")])


def folders(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_only_the_last_stage_is_left(spark, small):
    before = folders(spark)
    corpus_pipeline.run(spark, small).count()
    left = [os.listdir(os.path.join(shared_folder(spark).removeprefix("file://"), f)) for f in folders(spark) - before if f.startswith("tabscope-")]
    assert sorted(left) == [["lengths"], ["personal_data"]]


def test_tables_go_with_their_block(spark):
    before = folders(spark)
    with pytest.raises(ValueError, match="no"), scratch(spark):
        stored(spark.range(3), "inner")
        raise ValueError("no")
    assert folders(spark) == before
    with scratch(spark):
        kept = stored_alone(spark, lambda: stored(spark.range(5), "a").union(stored(spark.range(2), "b")), "c")
        assert kept.count() == 7 and len(folders(spark) - before) == 1
    assert folders(spark) == before


def test_lengths_follow_the_texts(spark, docs):
    result = corpus_pipeline.without_repeats(spark, docs, "")
    assert result.where(~F.col("n_chars").eqNullSafe(F.char_length("text"))).count() == 0


def test_whole_pipeline(spark, small):
    result = corpus_pipeline.run(spark, small)
    assert result.columns == ["doc_id", "n_tokens", "bucket_length", "batch_id", "slot"]
    assert 0 < result.count() <= spark.read.parquet(f"{small}/documents.parquet").count()
