"""Registered queries: text, vectors and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.functions.text import WHITESPACE
from tabscope.operators import documents, pivots, sqltext, vectors
from tabscope.operators.asof import asof_join
from tabscope.operators.intervals import interval_join
from tabscope.operators.windows import windowed
from tabscope.plans.registry import query, table

SPACE = f"'{WHITESPACE}'"

# -- sections and JSON ------------------------------------------------------------------------

SECTIONED = (
    "(SELECT doc_id, 'Preface' || chr(10) || '  Executive Summary  ' || chr(10) || text || chr(10) || 'DATA QUALITY:' || chr(10) || "
    "CASE WHEN doc_id % 3 = 0 THEN 'Key statistical results' || chr(10) ELSE '' END || lang || chr(10) || 'Patterns' || chr(10) || "
    "'first' || chr(10) || '3. Relationships and patterns' || chr(10) || source || chr(10) || 'Recommendations' || "
    "CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' keep it ' ELSE '' END AS report FROM documents)"
)


def sectioned(spark, folder):
    """documents as reports: the whole text under a header, with repeated and empty sections."""
    number = F.col("doc_id")
    return table(spark, folder, "documents").select("doc_id", F.concat(
        F.lit("Preface\n  Executive Summary  \n"), "text", F.lit("\nDATA QUALITY:\n"),
        F.when(number % 3 == 0, "Key statistical results\n").otherwise(""), "lang",
        F.lit("\nPatterns\nfirst\n3. Relationships and patterns\n"), "source", F.lit("\nRecommendations"),
        F.when(number % 2 == 0, "\n keep it ").otherwise(""),
    ).alias("report"))


#: The words of a header line and the section they open, the first that is found.
SECTION_CASE = (
    "CASE WHEN length(low) >= 50 THEN NULL "
    "WHEN contains(low, 'executive summary') THEN 'executive_summary' "
    "WHEN contains(low, 'data quality') THEN 'data_quality' "
    "WHEN contains(low, 'key findings') THEN 'key_findings' "
    "WHEN contains(low, 'key statistical') THEN 'key_findings' "
    "WHEN contains(low, 'patterns') THEN 'patterns' "
    "WHEN contains(low, 'relationships') THEN 'patterns' "
    "WHEN contains(low, 'recommendations') THEN 'recommendations' END"
)


@query("split_sections",
       "WITH lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM "
       f"(SELECT doc_id, string_split(report, chr(10)) AS parts FROM {SECTIONED})), marked AS (SELECT *, {SECTION_CASE} AS mark "
       f"FROM (SELECT *, lower(trim(line, {SPACE})) AS low FROM lines)), grouped AS (SELECT *, "
       "count(mark) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked), pieces AS (SELECT doc_id, g, "
       "coalesce(max(mark), 'introduction') AS section, string_agg(line, chr(10) ORDER BY i) FILTER (mark IS NULL) AS body, "
       "count(*) FILTER (mark IS NULL) AS n FROM grouped GROUP BY doc_id, g) "
       f"SELECT doc_id, section, trim(body, {SPACE}) AS body FROM pieces WHERE n > 0 "
       "QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY g DESC) = 1")
def split_sections(spark, folder):
    return documents.split_sections(sectioned(spark, folder), "doc_id", "report")


WRAPPED = (
    "(SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' "
    "WHEN 2 THEN 'Here is the result: ' || props || ' as asked.' WHEN 3 THEN replace(props, '}', '') WHEN 4 THEN '[' || event_id || ', 2]' "
    "WHEN 5 THEN props || ' and ' || props ELSE '  ' || props || chr(10) || ' ' END AS answer FROM events)"
)


def wrapped(spark, folder):
    """events with their JSON as an answer text: bare, fenced, in prose, broken, doubled."""
    props, kind = F.col("props"), F.col("event_id") % 7
    return table(spark, folder, "events").select("event_id", (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here is the result: "), props, F.lit(" as asked.")))
        .when(kind == 3, F.replace(props, F.lit("}"), F.lit("")))
        .when(kind == 4, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", 2]")))
        .when(kind == 5, F.concat(props, F.lit(" and "), props))
        .otherwise(F.concat(F.lit("  "), props, F.lit("\n ")))
    ).alias("answer"))


@query("extract_json",
       f"WITH s AS (SELECT event_id, trim(answer, {SPACE}) AS t FROM {WRAPPED}), b AS (SELECT event_id, CASE WHEN starts_with(t, '```') THEN "
       f"array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(trim(x, {SPACE}), '```')), chr(10)) ELSE t END AS body FROM s), "
       f"j AS (SELECT event_id, CASE WHEN json_valid(body) THEN trim(body, {SPACE}) WHEN json_valid(regexp_extract(body, '(?s)\\{{.*\\}}')) "
       "THEN regexp_extract(body, '(?s)\\{.*\\}') END AS json FROM b) "
       "SELECT event_id, json, json IS NULL AS parse_error, (json->>'$.k')::BIGINT AS k FROM j")
def extract_json(spark, folder):
    result = documents.extract_json(wrapped(spark, folder), "answer")
    return result.select(
        "event_id", "json", "parse_error", F.get_json_object("json", "$.k").cast("long").alias("k")
    )


STATEMENTS = (
    "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' SELECT ' || event_type || ' FROM data ' WHEN 1 THEN '```sql' || chr(10) || 'select ' || event_type || "
    "' from data' || chr(10) || '```' WHEN 2 THEN 'SQL: select 1' WHEN 3 THEN 'DROP TABLE ' || event_type WHEN 4 THEN '`SELECT 1`' "
    "ELSE 'WITH t AS (SELECT 1) SELECT * FROM t' END AS answer FROM events)"
)


@query("clean_sql_text",
       f"WITH b AS (SELECT event_id, trim(trim(trim(answer, {SPACE}), '`'), {SPACE}) AS bare FROM {STATEMENTS}), c AS (SELECT event_id, "
       f"CASE WHEN starts_with(lower(bare), 'sql') THEN trim(substring(bare, 4), {SPACE}) ELSE bare END AS sql FROM b) "
       "SELECT event_id, sql, starts_with(upper(sql), 'SELECT') AS accepted FROM c")
def clean_sql_text(spark, folder):
    kind, name = F.col("event_id") % 6, F.col("event_type")
    answers = table(spark, folder, "events").select("event_id", (
        F.when(kind == 0, F.concat(F.lit(" SELECT "), name, F.lit(" FROM data ")))
        .when(kind == 1, F.concat(F.lit("```sql\nselect "), name, F.lit(" from data\n```")))
        .when(kind == 2, "SQL: select 1")
        .when(kind == 3, F.concat(F.lit("DROP TABLE "), name))
        .when(kind == 4, "`SELECT 1`")
        .otherwise("WITH t AS (SELECT 1) SELECT * FROM t")
    ).alias("answer"))
    return sqltext.clean_sql_text(answers, "answer").drop("answer")


# -- vector store -----------------------------------------------------------------------------

@query("vector_upsert",
       "SELECT vec_id, label FROM embeddings WHERE label <> 1 UNION ALL SELECT vec_id, 100 FROM embeddings WHERE label = 1 "
       "UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 2")
def vector_upsert(spark, folder):
    store = table(spark, folder, "embeddings")
    relabelled = store.where("label = 1").withColumn("label", F.lit(100))
    added = store.where("label = 2").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return vectors.upsert(store, relabelled.unionByName(added), "vec_id").select("vec_id", "label")


@query("vector_topk",
       "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, label, "
       "round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS distance FROM embeddings, q WHERE label = 3 "
       "ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], v), vec_id LIMIT 5")
def vector_topk(spark, folder):
    store = table(spark, folder, "embeddings")
    question = store.orderBy("vec_id").select("embedding").first()[0]
    result = vectors.nearest(store, question, F.col("label") == 3, key="vec_id")
    return result.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("vector_topk_with_zeros",
       "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 "
       "THEN 1 - list_cosine_similarity(embedding::DOUBLE[], v) END AS distance FROM embeddings, q WHERE label = 3) "
       "SELECT vec_id, round(distance, 6) AS distance FROM d")
def vector_topk_with_zeros(spark, folder):
    store = table(spark, folder, "embeddings")
    question = store.orderBy("vec_id").select("embedding").first()[0]
    zero = F.transform("embedding", lambda x: F.lit(0).cast("float"))
    emptied = store.withColumn("embedding", F.when(F.col("vec_id") % 2 == 1, F.col("embedding")).otherwise(zero))
    found = vectors.nearest(emptied, question, F.col("label") == 3, k=1_000_000, key="vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query("interval_join_open",
       "SELECT n_nationkey, count(*) AS n FROM events JOIN nation ON value >= CASE WHEN n_nationkey % 5 = 0 THEN '-infinity'::DOUBLE ELSE n_nationkey END "
       "AND value < CASE WHEN n_nationkey % 7 = 0 THEN 'infinity'::DOUBLE ELSE n_nationkey * n_nationkey END GROUP BY n_nationkey")
def interval_join_open(spark, folder):
    """Intervals of very different lengths, some open at one end or both."""
    key = F.col("n_nationkey")
    ranges = table(spark, folder, "nation").select(
        "n_nationkey", F.when(key % 5 == 0, float("-inf")).otherwise(key.cast("double")).alias("low"),
        F.when(key % 7 == 0, float("inf")).otherwise((key * key).cast("double")).alias("high"),
    )
    return interval_join(table(spark, folder, "events"), ranges, "value", "low", "high").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("interval_join",
       "SELECT n_nationkey, count(*) AS n, round(sum(value), 2) AS total FROM events "
       "JOIN nation ON value >= n_nationkey * 4 AND value < n_nationkey * 4 + 3 GROUP BY n_nationkey")
def interval_joined(spark, folder):
    ranges = table(spark, folder, "nation").select(
        "n_nationkey", (F.col("n_nationkey") * 4).alias("low"), (F.col("n_nationkey") * 4 + 3).alias("high")
    )
    joined = interval_join(table(spark, folder, "events"), ranges, "value", "low", "high")
    return joined.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("vector_topk_each",
       "WITH q AS (SELECT label, min(vec_id) AS question, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label), "
       "d AS (SELECT question, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS distance FROM embeddings JOIN q USING (label)) "
       "SELECT question, rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, (row_number() OVER (PARTITION BY question ORDER BY "
       "greatest(round(distance, 12), 0), vec_id))::INTEGER AS rank FROM d) WHERE rank <= 5")
def vector_topk_each(spark, folder):
    store = table(spark, folder, "embeddings")
    questions = store.groupBy("label").agg(
        F.min("vec_id").alias("question"), F.min_by("embedding", "vec_id").alias("question_vector")
    )
    result = vectors.nearest_each(store, questions, ["label"], "question", key="vec_id")
    return result.withColumn("distance", F.round("distance", 6))


@query("vector_topk_pivots",
       "WITH q AS (SELECT vec_id AS question, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), "
       "d AS (SELECT question, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS distance FROM embeddings, q) "
       "SELECT question, rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, (row_number() OVER (PARTITION BY question ORDER BY "
       "greatest(round(distance, 12), 0), vec_id))::INTEGER AS rank FROM d) WHERE rank <= 5")
def vector_topk_pivots(spark, folder):
    """The nearest rows of all rows, for every 50th as the question."""
    store = table(spark, folder, "embeddings")
    questions = store.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("question"), F.col("embedding").alias("question_vector")
    )
    chosen = pivots.choose_pivots(store, "vec_id")
    blocked = pivots.pivot_blocks(store, chosen, key="vec_id", block_rows=64)
    found = pivots.nearest_by_pivots(blocked, chosen, questions, [], "question", key="vec_id")
    return found.drop("n_compared").withColumn("distance", F.round("distance", 6))


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 2")
def vector_delete(spark, folder):
    return vectors.delete_where(table(spark, folder, "embeddings"), F.col("label") == 2).select("vec_id", "label")


@query("retention_24h",
       "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def retention(spark, folder):
    return sqltext.newer_than(table(spark, folder, "events"), "ts").select("event_id", "ts")


# -- guarded SQL: one representative statement per kind of query --------------------------------

def passthrough(name: str, main: str, statement: str, others: tuple[str, ...] = (), sql: str | None = None,
                limit: int | None = None) -> None:
    """Register a statement over the table ``data`` (and named tables) that runs as it is."""

    @query(name, sql or f"WITH data AS (SELECT * FROM {main}) {statement}")
    def run(spark, folder):
        views = {other: table(spark, folder, other) for other in others}
        return sqltext.safe_select(table(spark, folder, main), statement, limit=limit, views=views)


passthrough(
    "safe_select", "lineitem",
    "SELECT l_returnflag, l_shipdate, l_extendedprice FROM data WHERE l_quantity > 49 "
    "ORDER BY l_extendedprice DESC, l_shipdate, l_returnflag",
    limit=20,
    sql="SELECT l_returnflag, l_shipdate, l_extendedprice FROM lineitem WHERE l_quantity > 49 "
        "ORDER BY l_extendedprice DESC, l_shipdate, l_returnflag LIMIT 20",
)
passthrough(
    "sql_filter_project", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM data "
    "WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)
passthrough(
    "sql_group_having", "lineitem",
    "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice), 2) AS revenue "
    "FROM data GROUP BY l_suppkey HAVING count(*) > 10",
)
passthrough(
    "sql_rollup", "lineitem",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM data "
    "GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
passthrough(
    "sql_cube", "orders",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM data "
    "GROUP BY CUBE (o_orderstatus, o_orderpriority)",
)
passthrough(
    "sql_grouping_sets", "orders",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM data "
    "GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
)
passthrough(
    "sql_join_inner", "lineitem",
    "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM data "
    "JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
    ("orders",),
)
passthrough(
    "sql_join_left", "customer",
    "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM data "
    "LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    ("orders",),
)
passthrough(
    "sql_semi", "customer",
    "SELECT c_custkey, c_name FROM data WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ("orders",),
)
passthrough(
    "sql_anti", "customer",
    "SELECT c_custkey, c_name FROM data WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ("orders",),
)
passthrough(
    "sql_range_join", "events",
    "SELECT n_nationkey, count(*) AS n, round(sum(value), 2) AS total FROM data "
    "JOIN nation ON value >= n_nationkey * 4 AND value < n_nationkey * 4 + 3 GROUP BY n_nationkey",
    ("nation",),
)
passthrough(
    "sql_window_rank", "orders",
    "SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place, "
    "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS status_place, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM data",
    sql="SELECT o_orderkey, o_custkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INTEGER AS place, "
        "(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus))::INTEGER AS status_place, "
        "(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER AS nth FROM orders",
)
passthrough(
    "sql_window_frame", "events",
    "SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS previous, "
    "round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth, "
    "round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS running FROM data",
)
passthrough(
    "sql_topk", "orders",
    "SELECT o_orderkey, o_totalprice FROM data ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
passthrough(
    "sql_set_ops", "customer",
    "SELECT cast(c_nationkey AS bigint) AS k FROM data WHERE c_acctbal > 0 INTERSECT SELECT cast(s_nationkey AS bigint) FROM supplier "
    "UNION ALL SELECT k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM data WHERE c_mktsegment = 'BUILDING') t",
    ("supplier", "orders"),
)
passthrough(
    "sql_scalars", "orders",
    "SELECT o_orderkey, upper(o_orderpriority) AS loud, substring(o_orderpriority, 3, 4) AS part, "
    "length(o_orderpriority) AS size, replace(o_orderpriority, '-', '_') AS flat, concat(o_orderstatus, '/', o_orderpriority) AS pair, "
    "year(o_orderdate) AS y, month(o_orderdate) AS m, round(sqrt(o_totalprice), 6) AS root, abs(o_totalprice - 150000) AS gap, "
    "floor(o_totalprice / 1000) AS thousands, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS band, "
    "coalesce(nullif(o_orderstatus, 'P'), 'open') AS status FROM data",
    sql="SELECT o_orderkey, upper(o_orderpriority) AS loud, substring(o_orderpriority, 3, 4) AS part, "
        "length(o_orderpriority)::INTEGER AS size, replace(o_orderpriority, '-', '_') AS flat, concat(o_orderstatus, '/', o_orderpriority) AS pair, "
        "year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, round(sqrt(o_totalprice), 6) AS root, abs(o_totalprice - 150000) AS gap, "
        "floor(o_totalprice / 1000)::BIGINT AS thousands, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS band, "
        "coalesce(nullif(o_orderstatus, 'P'), 'open') AS status FROM orders",
)
passthrough(
    "sql_json_array", "events",
    "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k, "
    "size(filter(array(cast(get_json_object(props, '$.k') AS bigint), user_id, event_id), x -> x % 2 = 0)) AS evens, "
    "element_at(transform(array(user_id, event_id), x -> x + 1), 2) AS next, map('a', user_id)['a'] AS a FROM data",
    sql="SELECT event_id, (props->>'$.k')::BIGINT AS k, len(list_filter([(props->>'$.k')::BIGINT, user_id, event_id], lambda x: x % 2 = 0))::INTEGER AS evens, "
        "list_transform([user_id, event_id], lambda x: x + 1)[2] AS next, user_id AS a FROM events",
)
passthrough(
    "sql_subquery", "orders",
    "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM data GROUP BY o_custkey) "
    "SELECT o_custkey, round(total, 2) AS total FROM spent WHERE total > (SELECT avg(total) FROM spent) "
    "AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    ("customer",),
    sql="WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) "
        "SELECT o_custkey, round(total, 2) AS total FROM spent WHERE total > (SELECT avg(total) FROM spent) "
        "AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)


@query("asof_join",
       "WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'error'), "
       "r AS (SELECT user_id, ts AS error_ts, event_id AS error_id FROM events WHERE event_type = 'error') "
       "SELECT e.event_id, e.user_id, e.ts, e.value, r.error_ts, r.error_id FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.error_ts")
def asof(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left = events.where("event_type <> 'error'").drop("event_type")
    right = events.where("event_type = 'error'").select(
        "user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id")
    )
    return asof_join(left, right, "user_id", "ts", "error_ts", ["error_ts", "error_id"], how="left")


@query("windowed_ranks",
       "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, row_number() OVER o AS nth, rank() OVER w AS place, "
       "dense_rank() OVER w AS level FROM lineitem "
       "WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC), "
       "o AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber)")
def windowed_ranks(spark, folder):
    """Three keys for all rows: each has about a third or more."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return windowed(
        lines, ["l_returnflag"], ["l_quantity"], descending=["l_quantity"],
        ranks={"nth": "row_number", "place": "rank", "level": "dense_rank"},
    )


@query("windowed_frames",
       "SELECT event_id, event_type, cents, sum(cents) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS running, "
       "min(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS lowest, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far, "
       "sum(cents) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)::BIGINT AS near, "
       "max(cents) OVER (w ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS high "
       "FROM (SELECT event_id, event_type, ts, round(value * 100)::BIGINT AS cents FROM events) "
       "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def windowed_frames(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    found = windowed(
        events, ["event_type"], ["ts", "event_id"],
        running={"running": ("sum", "cents"), "lowest": ("min", "cents"), "so_far": ("count", "event_id")},
        frames={"near": ("sum", "cents", 3, 2), "high": ("max", "cents", 10, 0)},
    )
    return found.drop("ts")
