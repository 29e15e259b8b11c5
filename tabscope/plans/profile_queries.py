"""Registered queries: sources, filters, typing, profiling, counting, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.operators import frequency, profile, quantiles
from tabscope.operators.association import impute_mean, nonconstant_columns
from tabscope.plans.registry import (
    CONTACT_CUSTOMERS,
    GAPPY_LINEITEM,
    RATED_DOCUMENTS,
    contact_customers,
    gappy_lineitem,
    per_column,
    query,
    rated_documents,
    table,
)
from tabscope.session import scratch_path
from tabscope.sources import dataset_metadata, file_metadata, load, require_rows, results_as_json, sample_rows, write_results

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# The personal-data and date patterns in this dialect.
DATE_REGEX = r"^(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}|\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4}|\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{4})"
EMAIL_REGEX = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_REGEX = r"(\+?\p{Nd}{1,3}[-.\s\p{Z}]?)?\(?\p{Nd}{3}\)?[-.\s\p{Z}]?\p{Nd}{3}[-.\s\p{Z}]?\p{Nd}{4}"


# -- sources and sinks ------------------------------------------------------------------------

@query("scan_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(spark, folder):
    path = scratch_path(spark, "nation.csv")
    table(spark, folder, "nation").write.option("header", True).csv(path)
    return load(spark, path)


@query("scan_csv_texts",
       "SELECT doc_id::INTEGER AS doc_id, text || chr(10) || '\"' || lang || '\", ' || chr(65533) AS text, source FROM documents")
def scan_csv_texts(spark, folder):
    text = F.concat("text", F.lit("\n\""), "lang", F.lit("\", \ufffd"))
    documents = table(spark, folder, "documents").select("doc_id", text.alias("text"), "source")
    (path,) = write_results({"documents": documents}, scratch_path(spark, "texts"), "csv")
    return load(spark, path)


@query("scan_json_array", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def scan_json_array(spark, folder):
    path = scratch_path(spark, "nation.json")
    rows = table(spark, folder, "nation").select(F.struct("n_nationkey", "n_name").alias("row"))
    rows.agg(F.to_json(F.collect_list("row")).alias("value")).coalesce(1).write.text(path)
    return load(spark, path)


@query("file_metadata", "SELECT 'lineitem.parquet' AS file_name, true AS has_size")
def file_listing(spark, folder):
    found = file_metadata(spark, f"{folder}/lineitem.parquet")
    return found.select("file_name", (F.col("file_size_mb") > 0).alias("has_size"))


@query("validated_rows", "SELECT count(*) AS rows FROM orders")
def validated_rows(spark, folder):
    return require_rows(table(spark, folder, "orders")).agg(F.count(F.lit(1)).alias("rows"))


@query("scan_json", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_json(spark, folder):
    path = scratch_path(spark, "customer.json")
    table(spark, folder, "customer").write.json(path)
    return load(spark, path, json_lines=True)


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def scan_parquet(spark, folder):
    df = load(spark, f"{folder}/orders.parquet")
    return df.where("o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("dataset_metadata", per_column(
    "SELECT {i}::INTEGER AS position, '{c}' AS \"column\", "
    "(map {dtypes})['{c}'] AS dtype, count(*) AS rows, 11::INTEGER AS columns FROM lineitem",
    list(LINEITEM), dtypes="{" + ", ".join(f"'{c}': '{t}'" for c, t in LINEITEM.items()) + "}",
))
def metadata(spark, folder):
    return dataset_metadata(table(spark, folder, "lineitem"))


@query("sample_rows",
       "SELECT event_id, ts, user_id, event_type, value, props FROM events ORDER BY ts, event_id LIMIT 10")
def first_rows(spark, folder):
    return sample_rows(table(spark, folder, "events"), ["ts", "event_id"], 10)


@query("sink_roundtrip", per_column(
    "SELECT '{c}' AS \"column\", count(*) AS total_count, count(*) - count({c}) AS null_count, "
    "round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS null_pct FROM {t}",
    list(DOCUMENTS) + ["quality", "toxic"], t=RATED_DOCUMENTS,
))
def sink_roundtrip(spark, folder):
    nulls = frequency.null_counts(rated_documents(spark, folder))
    (path,) = write_results({"nulls": nulls}, scratch_path(spark, "results"))
    return load(spark, path)


@query("results_as_json",
       "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"nations\":' "
       "|| count(*) || '}' AS json FROM region JOIN nation ON r_regionkey = n_regionkey "
       "GROUP BY r_regionkey, r_name")
def json_results(spark, folder):
    nations = (
        table(spark, folder, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
        .join(table(spark, folder, "region"), "r_regionkey")
        .groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("nations"))
    )
    return results_as_json(nations)


# -- filters and imputation -------------------------------------------------------------------

@query("drop_nulls", f"SELECT l_orderkey, l_linenumber, l_quantity FROM {GAPPY_LINEITEM} WHERE l_quantity IS NOT NULL")
def drop_nulls(spark, folder):
    df = gappy_lineitem(spark, folder).where(F.col("l_quantity").isNotNull())
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@query("pairwise_complete",
       f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM {GAPPY_LINEITEM} "
       "WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
def pairwise_complete(spark, folder):
    df = gappy_lineitem(spark, folder).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return df.na.drop(subset=["l_quantity", "l_returnflag"])


@query("impute_mean",
       f"SELECT doc_id, n_chars, coalesce(quality, trunc((SELECT avg(quality) FROM {RATED_DOCUMENTS}))::INTEGER) "
       f"AS quality, round(coalesce(share, (SELECT avg(CASE WHEN quality = 1 THEN n_chars / 7.0 END) "
       f"FROM {RATED_DOCUMENTS})), 6) AS share "
       f"FROM (SELECT *, CASE WHEN quality = 1 THEN n_chars / 7.0 END AS share FROM {RATED_DOCUMENTS})")
def imputed(spark, folder):
    df = rated_documents(spark, folder).withColumn(
        "share", F.when(F.col("quality") == 1, F.col("n_chars") / F.lit(7.0))
    )
    filled = impute_mean(df, ["n_chars", "quality", "share"])
    return filled.select("doc_id", "n_chars", "quality", F.round("share", 6).alias("share"))


@query("nonconstant_columns",
       "SELECT * FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_tax')) t(\"column\") WHERE "
       "(SELECT stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 AND stddev_pop(l_tax) > 0 FROM lineitem)")
def varying(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("constant", F.col("l_linenumber") * 0 + 3)
    return nonconstant_columns(df, ["l_quantity", "l_extendedprice", "constant", "l_tax"])


# -- counting and duplicates ------------------------------------------------------------------

@query("value_counts", per_column(
    "SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS count FROM {t} GROUP BY {c}",
    ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_shipdate"], t=GAPPY_LINEITEM,
))
def value_counts(spark, folder):
    return frequency.value_counts(
        gappy_lineitem(spark, folder),
        ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_shipdate"],
    )


N_UNIQUE = (
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique FROM {t}"
)


@query("n_unique", per_column(N_UNIQUE, list(LINEITEM), t=GAPPY_LINEITEM))
def distinct_values(spark, folder):
    return frequency.n_unique(gappy_lineitem(spark, folder))


@query("null_counts", per_column(
    "SELECT '{c}' AS \"column\", count(*) AS total_count, count(*) - count({c}) AS null_count, "
    "round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS null_pct FROM {t}",
    list(LINEITEM), t=GAPPY_LINEITEM,
))
def null_counts(spark, folder):
    return frequency.null_counts(gappy_lineitem(spark, folder))


@query("completeness",
       "SELECT count(*) AS rows, 7::BIGINT AS columns, (2 * count(*) - count(quality) - count(toxic))::BIGINT AS total_nulls, "
       "round((1 - (2 * count(*) - count(quality) - count(toxic)) / (count(*) * 7)) * 100, 2) AS completeness_pct "
       f"FROM {RATED_DOCUMENTS}")
def completeness(spark, folder):
    return frequency.completeness(rated_documents(spark, folder))


TOP_VALUES = (
    "SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {c} ASC NULLS LAST)::INTEGER AS rank, "
    "coalesce({c}::VARCHAR, 'None') AS value, count(*) AS count FROM {t} GROUP BY {c} "
    "QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c} ASC NULLS LAST) <= {k}"
)


@query("top_values", per_column(
    TOP_VALUES, ["l_returnflag", "l_linenumber", "l_quantity", "l_suppkey", "l_shipdate"],
    t=GAPPY_LINEITEM, k="10",
))
def top_values(spark, folder):
    return frequency.top_values(
        gappy_lineitem(spark, folder),
        ["l_returnflag", "l_linenumber", "l_quantity", "l_suppkey", "l_shipdate"],
    )


@query("top_values_text",
       f"SELECT 'text' AS \"column\", (row_number() OVER (ORDER BY count(*) DESC, text))::INTEGER AS rank, text AS value, count(*) AS count "
       f"FROM documents GROUP BY text QUALIFY row_number() OVER (ORDER BY count(*) DESC, text) <= 10")
def top_values_text(spark, folder):
    return frequency.top_values(table(spark, folder, "documents"), ["text"])


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM " + GAPPY_LINEITEM)
def distinct_rows(spark, folder):
    df = gappy_lineitem(spark, folder).select("l_returnflag", "l_linestatus", "l_linenumber")
    return frequency.distinct_rows(df)


@query("duplicate_rows",
       "SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows FROM "
       f"(SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM {GAPPY_LINEITEM})")
def duplicate_rows(spark, folder):
    df = gappy_lineitem(spark, folder).select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return frequency.duplicate_rows(df)


# -- quantiles and moments --------------------------------------------------------------------

NEAREST = (
    "(SELECT v FROM (SELECT {c} + 0.0 AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n "
    "FROM {t} WHERE {c} IS NOT NULL) WHERE i = floor((n - 1) * {p} + 0.5))"
)


def nearest(column: str, source: str, probability: float) -> str:
    """SQL for the value at the rank nearest to a probability."""
    return NEAREST.format(c=column, t=source, p=f"{probability}::DOUBLE")


@query("quantile_nearest", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS probability, {nearest(c, GAPPY_LINEITEM, p)} AS value"
    for c in LINEITEM_MEASURES for p in (0.25, 0.75)
))
def quantile_nearest(spark, folder):
    return quantiles.quantiles(gappy_lineitem(spark, folder), LINEITEM_MEASURES)


@query("quantile_linear", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS probability, round(quantile_cont({c}, {p}), 6) AS value FROM orders"
    for c in ("o_totalprice", "o_custkey") for p in (0.05, 0.25, 0.5, 0.75, 0.99)
))
def quantile_linear(spark, folder):
    result = quantiles.quantiles(
        table(spark, folder, "orders"), ["o_totalprice", "o_custkey"], (0.05, 0.25, 0.5, 0.75, 0.99), "linear"
    )
    return result.withColumn("value", F.round("value", 6))


NUMERIC_STATS = (
    "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c} + 0.0)::DOUBLE AS min, "
    "max({c} + 0.0)::DOUBLE AS max, round(quantile_cont({c}, 0.5), 4) AS median"
)


def quartile_sql(column: str, source: str) -> str:
    return (
        f"round({nearest(column, source, 0.25)}, 4)::DOUBLE AS q25, "
        f"round({nearest(column, source, 0.75)}, 4)::DOUBLE AS q75"
    )


@query("profile_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {NUMERIC_STATS.format(c=c)}, {quartile_sql(c, GAPPY_LINEITEM)} FROM {GAPPY_LINEITEM}"
    for c in LINEITEM_MEASURES
))
def profile_numeric(spark, folder):
    return profile.numeric_profile(gappy_lineitem(spark, folder), LINEITEM_MEASURES)


@query("profile_categorical", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT n_unique FROM ({N_UNIQUE.format(c=c, t=GAPPY_LINEITEM)})) AS n_unique, "
    f"(SELECT to_json(list({{'value': value, 'count': count}} ORDER BY rank))::VARCHAR "
    f"FROM ({TOP_VALUES.format(c=c, t=GAPPY_LINEITEM, k=10)})) AS top_values"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")
))
def profile_categorical(spark, folder):
    result = profile.categorical_profile(
        gappy_lineitem(spark, folder), ["l_returnflag", "l_linestatus", "l_linenumber"]
    )
    return result.withColumn("top_values", F.to_json("top_values"))


@query("profile_datetime",
       "SELECT 'l_shipdate' AS \"column\", min(l_shipdate)::VARCHAR AS min, max(l_shipdate)::VARCHAR AS max FROM lineitem")
def profile_datetime(spark, folder):
    return profile.datetime_profile(table(spark, folder, "lineitem"), ["l_shipdate"])


# -- typing, personal data --------------------------------------------------------------------

DATED_ORDERS = (
    "(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_text, strftime(o_orderdate, '%m/%d/%Y') AS us_text, "
    "CASE WHEN o_orderkey % 2 = 0 THEN ' ' || strftime(o_orderdate, '%d-%m-%Y') ELSE o_orderpriority END AS mixed_text, "
    "o_orderpriority FROM orders)"
)


def dated_orders(spark, folder):
    day = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(day, "yyyy-MM-dd").alias("iso_text"),
        F.date_format(day, "MM/dd/yyyy").alias("us_text"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.date_format(day, "dd-MM-yyyy")))
        .otherwise(F.col("o_orderpriority")).alias("mixed_text"),
        "o_orderpriority",
    )


@query("date_like_share", per_column(
    "SELECT '{c}' AS \"column\", avg(CASE WHEN regexp_matches(trim({c}), '{r}') THEN 1.0 ELSE 0.0 END) AS date_share FROM {t}",
    ["iso_text", "us_text", "mixed_text", "o_orderpriority"], t=DATED_ORDERS, r=DATE_REGEX,
))
def date_share(spark, folder):
    return profile.date_like_share(
        dated_orders(spark, folder), ["iso_text", "us_text", "mixed_text", "o_orderpriority"]
    )


def class_sql(source: str, dtypes: dict[str, str]) -> str:
    """SQL for the summary rows: counts and the semantic class of every column."""
    rows = []
    for i, (c, dtype) in enumerate(dtypes.items()):
        dates = (
            f"avg(CASE WHEN regexp_matches(trim({c}), '{DATE_REGEX}') THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END)"
            if dtype == "string" else "NULL::DOUBLE"
        )
        rows.append(
            f"(SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{dtype}' AS dtype, count(*) AS total_count, "
            f"count(*) - count({c}) AS null_count, "
            f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique, "
            f"{dates} AS date_share FROM {source})"
        )
    return (
        "SELECT position, \"column\", dtype, n_unique, total_count, null_count, CASE "
        "WHEN dtype LIKE 'timestamp%' OR dtype = 'date' THEN 'datetime' "
        "WHEN dtype IN ('int', 'bigint', 'double') AND n_unique <= 50 AND n_unique / total_count < 0.05 THEN 'categorical' "
        "WHEN dtype IN ('int', 'bigint', 'double') THEN 'numeric' "
        "WHEN dtype = 'string' AND coalesce(date_share, 0) > 0.8 THEN 'datetime' "
        "WHEN dtype = 'string' AND n_unique <= 50 THEN 'categorical' "
        "WHEN dtype = 'boolean' THEN 'categorical' ELSE 'text' END AS detected_type "
        "FROM (" + " UNION ALL ".join(rows) + ")"
    )


MIXED_ORDERS = f"(SELECT o.*, d.iso_text, d.mixed_text FROM orders o JOIN {DATED_ORDERS} d USING (o_orderkey))"
MIXED_TYPES = {**ORDERS, "iso_text": "string", "mixed_text": "string"}


def mixed_orders(spark, folder):
    return table(spark, folder, "orders").join(
        dated_orders(spark, folder).drop("us_text", "o_orderpriority"), "o_orderkey"
    )


@query("column_types",
       f"SELECT position, \"column\", dtype, n_unique, total_count, detected_type FROM ({class_sql(MIXED_ORDERS, MIXED_TYPES)})")
def column_types(spark, folder):
    return profile.column_types(mixed_orders(spark, folder))


@query("columns_by_class",
       f"SELECT detected_type, string_agg(\"column\", ',' ORDER BY position) AS columns FROM ({class_sql('lineitem', LINEITEM)}) GROUP BY 1")
def columns_by_class(spark, folder):
    types = profile.column_types(table(spark, folder, "lineitem"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "column")))
    return types.groupBy("detected_type").agg(
        F.array_join(F.transform(ordered, lambda x: x["column"]), ",").alias("columns")
    )


@query("time_columns",
       f"SELECT \"column\", position = min(position) OVER () AS is_primary FROM ({class_sql(MIXED_ORDERS, MIXED_TYPES)}) "
       "WHERE detected_type = 'datetime'")
def time_columns(spark, folder):
    from tabscope.operators.series import time_columns as find
    return find(profile.column_types(mixed_orders(spark, folder)))


PII_SHARES = (
    "avg(CASE WHEN regexp_matches({c}, '" + EMAIL_REGEX.replace("{", "{{").replace("}", "}}") + "') THEN 1.0 ELSE 0.0 END)",
    "avg(CASE WHEN regexp_matches({c}, '" + PHONE_REGEX.replace("{", "{{").replace("}", "}}") + "') THEN 1.0 ELSE 0.0 END)",
)
PII_FLAGS = (
    "concat_ws(',', CASE WHEN {0} > 0.3 THEN 'potential_email' END, CASE WHEN {1} > 0.3 THEN 'potential_phone' END)"
)


def pii_sql(column: str, source: str) -> str:
    email, phone = (s.format(c=column) for s in PII_SHARES)
    return (
        f"SELECT '{column}' AS \"column\", round({email}, 9) AS email_share, round({phone}, 9) AS phone_share, "
        f"{PII_FLAGS.format(email, phone)} AS pii_flags FROM {source}"
    )


@query("pii_flags", " UNION ALL ".join(
    [pii_sql(c, CONTACT_CUSTOMERS) for c in ("c_name", "email", "phone")] + [pii_sql("text", "documents")]
))
def pii_flags(spark, folder):
    contacts = profile.pii_shares(contact_customers(spark, folder), ["c_name", "email", "phone"])
    documents = profile.pii_shares(table(spark, folder, "documents"), ["text"])
    return contacts.unionByName(documents).select(
        "column", F.round("email_share", 9).alias("email_share"),
        F.round("phone_share", 9).alias("phone_share"), F.array_join("pii_flags", ",").alias("pii_flags"),
    )


@query("pii_rows",
       f"SELECT * FROM (SELECT doc_id, regexp_matches(text, '{EMAIL_REGEX}') AS has_email, "
       f"regexp_matches(text, '{PHONE_REGEX}') AS has_phone FROM documents) WHERE has_email OR has_phone")
def pii_rows(spark, folder):
    return profile.pii_rows(table(spark, folder, "documents"), "text").select("doc_id", "has_email", "has_phone")


# -- column and table profiles ----------------------------------------------------------------

def record_sql(source: str, dtypes: dict[str, str]) -> str:
    """SQL for the full record of every column."""
    numbers = ("int", "bigint", "double")
    rows = []
    for c, dtype in dtypes.items():
        if dtype in numbers:
            stats = f"{NUMERIC_STATS.format(c=c)}, {quartile_sql(c, source)}"
        else:
            stats = ", ".join(f"NULL::DOUBLE AS {s}" for s in ("mean", "std", "min", "max", "median", "q25", "q75"))
        dated = dtype not in numbers
        flags = PII_FLAGS.format(*(s.format(c=c) for s in PII_SHARES)) if dtype == "string" else "''"
        rows.append(
            f"(SELECT '{c}' AS \"column\", {stats}, "
            f"{f'min({c})::VARCHAR' if dated else 'NULL::VARCHAR'} AS min_text, "
            f"{f'max({c})::VARCHAR' if dated else 'NULL::VARCHAR'} AS max_text, "
            f"(SELECT to_json(list({{'value': value, 'count': count}} ORDER BY rank))::VARCHAR FROM "
            f"({TOP_VALUES.format(c=c, t=source, k=10)})) AS top_values, {flags} AS pii_flags FROM {source})"
        )
    numeric = ", ".join(
        f"CASE WHEN detected_type = 'numeric' THEN {s} END AS {s}"
        for s in ("mean", "median", "std", "min", "max", "q25", "q75")
    )
    return (
        "SELECT position, \"column\", detected_type, dtype, total_count, null_count, "
        f"round(null_count / greatest(total_count, 1) * 100, 2) AS null_pct, n_unique, {numeric}, "
        "CASE WHEN detected_type = 'datetime' THEN min_text END AS min_text, "
        "CASE WHEN detected_type = 'datetime' THEN max_text END AS max_text, "
        "CASE WHEN detected_type IN ('categorical', 'text') THEN top_values END AS top_values, "
        "CASE WHEN detected_type = 'text' THEN pii_flags ELSE '' END AS pii_flags "
        f"FROM ({class_sql(source, dtypes)}) JOIN (" + " UNION ALL ".join(rows) + ") USING (\"column\")"
    )


def flat(records):
    """Column records with their lists as text, to compare with SQL."""
    return records.withColumns({
        "top_values": F.to_json("top_values"), "pii_flags": F.array_join("pii_flags", ","),
    })


CONTACTS = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string", "email": "string", "phone": "string",
}


@query("profile_columns", record_sql(GAPPY_LINEITEM, LINEITEM))
def profile_columns(spark, folder):
    return flat(profile.profile_columns(gappy_lineitem(spark, folder)))


@query("profile_columns_text", record_sql(CONTACT_CUSTOMERS, CONTACTS))
def profile_columns_text(spark, folder):
    return flat(profile.profile_columns(contact_customers(spark, folder)))


def dataset_sql(source: str, dtypes: dict[str, str]) -> str:
    """SQL for the one-row table profile."""
    classes = ", ".join(
        f"count(*) FILTER (detected_type = '{k}') AS {k}_columns" for k in ("numeric", "categorical", "datetime", "text")
    )
    return (
        "SELECT max(total_count) AS rows, count(*) AS columns, sum(null_count)::BIGINT AS total_nulls, "
        "round((1 - sum(null_count) / (max(total_count) * count(*))) * 100, 2) AS completeness_pct, "
        f"{classes}, (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) "
        f"AS duplicate_rows FROM ({class_sql(source, dtypes)})"
    )


@query("profile_dataset", dataset_sql("lineitem", LINEITEM))
def profile_dataset(spark, folder):
    return profile.profile_dataset(table(spark, folder, "lineitem"))


@query("profile_dataset_gaps", dataset_sql(RATED_DOCUMENTS, {**DOCUMENTS, "quality": "int", "toxic": "int"}))
def profile_dataset_gaps(spark, folder):
    return profile.profile_dataset(rated_documents(spark, folder))
