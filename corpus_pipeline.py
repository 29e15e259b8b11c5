"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and read by the next stage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import language, ngram_join, packing, pii, suffix_dedup
from tabscope.llm.rows import free_name, removed, scratch, stored_alone
from tabscope.session import scratch_path

#: A document goes if the family of its language is predicted with less than this score.
MIN_LANGUAGE_SCORE = 0.3
#: The setting that holds the secret key of the pseudonyms.
KEY_SETTING = "spark.tabscope.pii.key"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Those without letters, or with a very unsure family of languages, go.

    With no row to learn from, all documents with letters stay.
    """
    model = language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    found = language.identify(docs, model, docs.columns, names, by_family=True)
    known = (F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)
    return found.where(known).drop(*names)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Documents without an id stay. Where rows repeat an id, each row is judged by its own text, and of rows of one id with
    equal shingles one stays. A null or empty text is a copy of nothing. Of all tables written on the way only the ids that
    go, and those that repeat, are left.
    """
    decided = stored_alone(spark, lambda: _decisions(docs), "decided")
    gone = decided.where("copy AND NOT repeated").select(F.col("id").alias("doc_id")).distinct()
    again = decided.where("repeated").select(F.col("id").alias("doc_id")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(gone.unionByName(again), "doc_id", "left_anti").select(*columns)
    if again.isEmpty():
        return kept
    name = free_name("digest", docs.columns)
    rows = ngram_join.set_digests(docs.join(again, "doc_id", "left_semi"), 5, docs.columns, name)
    own = decided.where("repeated AND NOT copy").select(F.col("id").alias("doc_id"), F.col("digest").alias(name)).distinct()
    once = rows.join(own, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return kept.unionByName(once.select(*columns))


def _decisions(docs: DataFrame) -> DataFrame:
    """``id, digest, copy, repeated`` of documents that are copies or repeat an id; ``digest`` is of the shingles."""
    groups = ngram_join.members(docs, 5, 80, "doc_id").where("id IS NOT NULL")
    several = groups.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("repeated"))
    marked = groups.join(several, "id", "left").select(
        "id", "digest", (F.col("id") != F.col("component_id")).alias("copy"), F.coalesce("repeated", F.lit(False)).alias("repeated")
    )
    return marked.where("copy OR repeated")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id has; ``n_chars`` follows.

    A null text stays null, a row without an id or with a repeated one keeps its place among the others; all rows stay.
    """
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data. All rows stay, null and empty texts as they are.

    The key is the session's ``spark.tabscope.pii.key``. Without it the key of the source is used, which anybody can read
    and reverse: set one for real data.
    """
    key = spark.conf.get(KEY_SETTING, None)
    return pii.pseudonymize(docs, key.encode() if key else pii.DEMO_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A batch for each document: every row has one, repeated ids each their own, null and empty texts of length 0."""
    return packing.pack(docs)


STAGES = [
    ("language", by_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("personal_data", pseudonymous),
    ("packing", packed),
]

#: The language stage is a fitted classifier and packing a dynamic program: SQL can't state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. What a stage stores, and the rows it has read, go when its own rows are written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            removed(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
