"""The registered queries of these operators, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import (
    audit, bpe, chat, imatch, language, licenses, ngram_join, packing, phrases, pii, ppm, quality, suffix_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from documents that are not held out."""
    docs = table(spark, folder, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are at least 85% similar."""
    return ngram_join.components(table(spark, folder, "documents"), size=4, percent=85)


@query
def op3_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprint_edits(table(spark, folder, "documents"))


@query
def op4_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with pseudonyms for its personal data, and how many of each kind."""
    found = pii.pseudonymize(table(spark, folder, "documents").select("doc_id", "text"), pii.DEMO_KEY, "found")
    counts = [F.coalesce(F.col("found")[k], F.lit(0)).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", "text", *counts)


@query
def op5_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """A batch and slot for every document."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Plain counts and the verdict of the regression for every document."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Base phrases and labels of every document."""
    found = licenses.scan(table(spark, folder, "documents"))
    base, own = F.col("places.label"), F.col("detections.label")
    confidence = F.array(*(F.lit(c) for c in licenses.CONFIDENCE))
    best = F.transform("detections.priority", lambda p: F.element_at(confidence, p + 1))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(best), F.lit(0.0)),
                   F.when(F.size("places") > 0, licenses.BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
    )


@query
def op8_ppm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Word-model and PPM scores of every document."""
    return ppm.score(table(spark, folder, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of a document with a smaller id."""
    return suffix_dedup.digests(table(spark, folder, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document with the multi-language rank file, decode the ids, and digest both sides."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one full of the template's own marks, formatted, encoded, masked and read back."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.digests(chat.format_conversations(turns, path), path).drop("n_tokens", "n_loss_tokens")


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters over all documents, in each of their orders, for each language."""
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest collocations of two and three words of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


#: Text with A-Z in lower case, and nothing for null.
LOWERED = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

SQL["op2_ngram_jaccard"] = f"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT b, root FROM reached JOIN edges ON id = a
)
SELECT id AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM reached LEFT JOIN sizes ON doc_id = id GROUP BY id"""

SQL["op9_suffix_dedup"] = """WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM texts)
), firsts AS (
  SELECT s, min(doc_id) AS holder FROM windows GROUP BY s
), repeats AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50 AS new
  FROM windows JOIN firsts USING (s) WHERE holder < doc_id
), numbered AS (
  SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM repeats
), runs AS (
  SELECT doc_id, run, min(i) AS begin_, max(i) + 50 AS end_ FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, begin_, end_, substr(h, 2 * before + 1, 2 * (begin_ - before)) AS piece FROM (
    SELECT *, coalesce(lag(end_) OVER (PARTITION BY doc_id ORDER BY begin_), 0) AS before FROM runs
  ) JOIN texts USING (doc_id)
), cut AS (
  SELECT doc_id, sum(end_ - begin_) AS n_removed, count(*) AS n_spans, max(end_) AS last_, string_agg(piece, '' ORDER BY begin_) AS head
  FROM pieces GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)"""

_BY_TURN = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

SQL["op11_chat_format"] = f"""WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), filled AS (
  SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t, '[<\\[]\\\\*/?(?:s>|INST\\])' AS marked FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {_BY_TURN})) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' {_BY_TURN}) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(r) + length(t) + len(regexp_extract_all(r, marked)) + len(regexp_extract_all(t, marked)))::BIGINT AS formatted_chars
FROM filled GROUP BY conv_id"""

SQL["op12_filter_audit"] = """WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM texts LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails
), letters(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
), counts AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (translate(fails, earlier || f, '') = fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, earlier, '') <> fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, f) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, f) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counts"""

SQL["op13_phrases"] = f"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (VALUES (1), (2), (3)) AS sizes(size)
  WHERE i + size - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = head JOIN grams t ON t.lang = c.lang AND t.phrase = tail
), best AS (
  SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE size = 3) GROUP BY 1, 2
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE most IS NULL OR 100 * most < 50 * a
) JOIN totals USING (lang) WHERE rank <= 2000"""
