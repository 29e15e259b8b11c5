"""Registered queries: time series, findings, charts, summaries and reports."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tabscope.functions.bounded import local_table
from tabscope.operators import association, charts, contexts, documents, findings, frequency, outliers, profile, series
from tabscope.plans.profile_queries import (
    CONTACTS,
    LINEITEM,
    class_sql,
    dataset_sql,
    nearest,
    pii_sql,
    record_sql,
)
from tabscope.plans.registry import (
    CONTACT_CUSTOMERS,
    RATED_DOCUMENTS,
    contact_customers,
    per_column,
    query,
    rated_documents,
    table,
)
from tabscope.plans.statistics_queries import (
    PULLED_SUPPLIER,
    anderson_sql,
    matrix_sql,
    outlier_sql,
    pulled_supplier,
    shapiro_sql,
)

# -- time series ------------------------------------------------------------------------------

WAVY_EVENTS = (
    "(SELECT *, CASE WHEN event_id % 11 <> 0 THEN value END AS gappy, "
    "sin(2 * pi() * event_id / 12) * 100 + value AS wave FROM events)"
)
SERIES = ["value", "user_id", "gappy", "wave", "event_id"]
EVENT_ORDER = ["ts", "event_id"]


def wavy_events(spark, folder):
    """events with a column that has gaps and one that repeats every 12 rows."""
    number = F.col("event_id")
    return table(spark, folder, "events").withColumns({
        "gappy": F.when(number % 11 != 0, F.col("value")),
        "wave": F.sin(2 * F.pi() * number / 12) * 100 + F.col("value"),
    })


PLACED = (
    "SELECT '{c}' AS \"column\", {c}::DOUBLE AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, "
    "avg({c}) OVER () AS mean, var_pop({c}) OVER () AS variance, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL"
)


def placed_sql(columns: list[str]) -> str:
    return per_column(PLACED, columns, t=WAVY_EVENTS)


def trend_sql(columns: list[str]) -> str:
    return (
        "SELECT \"column\", CASE WHEN relative > 0.001 THEN 'increasing' WHEN relative < -0.001 THEN 'decreasing' "
        "ELSE 'stable' END AS direction, round(slope, 6) AS slope, round(relative, 6) AS normalized_slope FROM ("
        "SELECT \"column\", regr_slope(x, i) AS slope, regr_slope(x, i) / abs(avg(x)) AS relative "
        f"FROM ({placed_sql(columns)}) GROUP BY 1)"
    )


@query("trend", trend_sql(SERIES))
def trend(spark, folder):
    return series.trend(wavy_events(spark, folder), SERIES, EVENT_ORDER)


def lag_sql(columns: list[str]) -> str:
    """SQL for the autocorrelations of series of at least 100 values."""
    return (
        f"WITH placed AS ({placed_sql(columns)}), lagged AS (SELECT \"column\", k::INTEGER AS lag, "
        "avg((x - mean) * (nexts[k] - mean)) / any_value(variance) AS r FROM (SELECT *, ["
        + ", ".join(f"lead(x, {k}) OVER w" for k in range(1, 51))
        + "] AS nexts FROM placed WINDOW w AS (PARTITION BY \"column\" ORDER BY i)) CROSS JOIN range(1, 51) g(k) GROUP BY 1, 2) "
    )


@query("autocorrelation", lag_sql(SERIES) + "SELECT \"column\", lag, round(r, 6) AS autocorrelation FROM lagged")
def autocorrelation(spark, folder):
    result = series.autocorrelation(wavy_events(spark, folder), SERIES, EVENT_ORDER)
    return result.withColumn("autocorrelation", F.round("autocorrelation", 6))


PEAKS = (
    ", peaks AS (SELECT \"column\", lag, round(r, 4) AS strength FROM (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after "
    "FROM lagged WINDOW w AS (PARTITION BY \"column\" ORDER BY lag)) WHERE r > before AND r > after AND r > 0.3 "
    "QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY round(r, 4) DESC, lag) = 1) "
)


@query("seasonality", lag_sql(SERIES) + PEAKS +
       "SELECT c AS \"column\", lag IS NOT NULL AS detected, lag AS period, strength FROM (VALUES "
       + ", ".join(f"('{c}')" for c in SERIES) + ") t(c) LEFT JOIN peaks ON peaks.\"column\" = c")
def seasonality(spark, folder):
    return series.seasonality(wavy_events(spark, folder), SERIES, EVENT_ORDER)


@query("timeseries_report", lag_sql(SERIES) + PEAKS +
       f"SELECT t.\"column\", 'ts' AS time_column, direction, slope, normalized_slope, lag IS NOT NULL AS detected, "
       f"lag AS period, strength FROM ({trend_sql(SERIES)}) t LEFT JOIN peaks USING (\"column\")")
def timeseries_report(spark, folder):
    return series.timeseries_report(wavy_events(spark, folder), SERIES, "ts", ["event_id"])


FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d")


@query("parse_dates",
       "SELECT o_orderkey, " + ", ".join(
           f"CASE WHEN o_orderkey % 10 < 8 THEN o_orderdate::DATE END AS d{i}" for i in range(len(FORMATS))
       ) + ", CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS unparsed FROM orders")
def parse_dates(spark, folder):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        *[
            F.when(key % 10 < 8, F.date_format(day, fmt)).otherwise("bad").alias(f"d{i}")
            for i, fmt in enumerate(series.DATE_FORMATS)
        ],
        F.when(key % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise("n/a").alias("unparsed"),
    )
    return series.parse_all_dates(df, [f"d{i}" for i in range(len(FORMATS))] + ["unparsed"])


# -- findings ---------------------------------------------------------------------------------

MESSY_TYPES = {
    "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string", "email": "string",
    "rarely": "double", "extreme": "double",
}
MESSY_SELECT = (
    "SELECT c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment, email, "
    "CASE WHEN c_custkey % 4 = 0 THEN c_acctbal / 4 END AS rarely, "
    f"CASE WHEN c_custkey % 8 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS extreme FROM {CONTACT_CUSTOMERS}"
)
MESSY = f"({MESSY_SELECT} UNION ALL {MESSY_SELECT} WHERE c_custkey % 20 = 7)"


def messy_customers(spark, folder):
    """customer with missing, personal, repeated and extreme values."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    customers = contact_customers(spark, folder)

    def spoiled(df):
        return df.select(
            "c_nationkey", F.when(key % 5 != 0, balance).alias("c_acctbal"), "c_mktsegment", "email",
            F.when(key % 4 == 0, balance / 4).alias("rarely"),
            F.when(key % 8 == 0, balance * 100).otherwise(balance).alias("extreme"),
        )

    return spoiled(customers).unionByName(spoiled(customers.where(key % 20 == 7)))


def shown(report):
    """Findings with their column list as text, to compare with SQL."""
    return report.withColumn("affected_columns", F.array_join("affected_columns", ","))


# The sentences of findings, reports and summaries in the SQL below.

def missing_sql(source: str, columns: list[str]) -> str:
    return (
        "SELECT CASE WHEN pct > 50 THEN 'High missing rate in ''' ELSE 'Notable missing values in ''' END || c || '''' AS title, "
        "CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS severity, pct || CASE WHEN pct > 50 THEN '% of values are missing.' "
        "ELSE '% missing.' END AS description, c AS affected_columns, CASE WHEN pct > 50 THEN 'Consider dropping or imputing this column.' "
        "ELSE 'Investigate why data is missing. Impute if appropriate.' END AS recommendation FROM ("
        + per_column("SELECT '{c}' AS c, round((count(*) - count({c})) / count(*) * 100, 2) AS pct FROM {t}", columns, t=source)
        + ") WHERE pct > 10"
    )


def pii_finding_sql(source: str, columns: list[str]) -> str:
    return (
        "SELECT 'Potential PII in ''' || \"column\" || '''' AS title, 'high' AS severity, 'Detected patterns: ' || "
        "replace(pii_flags, ',', ', ') AS description, \"column\" AS affected_columns, 'Review and mask/remove PII before sharing.' "
        "AS recommendation FROM (" + " UNION ALL ".join(pii_sql(c, source) for c in columns) + ") WHERE pii_flags <> ''"
    )


def duplicate_sql(source: str) -> str:
    return (
        "SELECT 'Duplicate rows detected' AS title, CASE WHEN n < 100 THEN 'medium' ELSE 'high' END AS severity, "
        "n || ' duplicate rows found.' AS description, '' AS affected_columns, 'Review and deduplicate if not intentional.' AS recommendation "
        f"FROM (SELECT (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS n) WHERE n > 0"
    )


def outlier_finding_sql(source: str, columns: list[str]) -> str:
    return (
        "SELECT 'High outlier rate in ''' || \"column\" || '''' AS title, 'medium' AS severity, count || ' outliers (' || pct || "
        "'%) outside IQR bounds.' AS description, \"column\" AS affected_columns, 'Check if these are data entry errors or genuine extreme values.' "
        "AS recommendation FROM (" + " UNION ALL ".join(outlier_sql(c, source) for c in columns) + ") WHERE pct > 5"
    )


MESSY_NUMBERS = ["c_acctbal", "rarely", "extreme"]


@query("finding_missing", missing_sql(MESSY, list(MESSY_TYPES)))
def finding_missing(spark, folder):
    return shown(findings.missing_findings(frequency.null_counts(messy_customers(spark, folder))))


@query("finding_pii", pii_finding_sql(CONTACT_CUSTOMERS, ["c_name", "email", "phone"]))
def finding_pii(spark, folder):
    records = profile.profile_columns(contact_customers(spark, folder))
    return shown(findings.pii_findings(records))


@query("finding_duplicates", duplicate_sql(MESSY))
def finding_duplicates(spark, folder):
    return shown(findings.duplicate_findings(frequency.duplicate_rows(messy_customers(spark, folder))))


@query("finding_outliers", outlier_finding_sql(MESSY, MESSY_NUMBERS))
def finding_outliers(spark, folder):
    return shown(findings.outlier_findings(outliers.iqr_outliers(messy_customers(spark, folder), MESSY_NUMBERS)))


def score_sql(source: str, dtypes: dict[str, str], numbers: list[str]) -> str:
    return (
        "SELECT quality_score, CASE WHEN quality_score >= 70 THEN 'high' WHEN quality_score >= 40 THEN 'mid' ELSE 'low' END AS band "
        "FROM (SELECT round_even(greatest(0.0::DOUBLE, completeness_pct - least(duplicate_rows / rows * 100, 20) - "
        "least((SELECT count(*) FROM (" + " UNION ALL ".join(outlier_sql(c, source) for c in numbers) + ") WHERE count > 0) * 3, 15)), 0)::INTEGER "
        f"AS quality_score FROM ({dataset_sql(source, dtypes)}))"
    )


@query("quality_score", score_sql(MESSY, MESSY_TYPES, MESSY_NUMBERS))
def quality_score(spark, folder):
    df = messy_customers(spark, folder)
    return findings.quality_score(profile.profile_dataset(df), outliers.iqr_outliers(df, MESSY_NUMBERS))


MESSY_FINDINGS = " UNION ALL ".join((
    missing_sql(MESSY, list(MESSY_TYPES)), pii_finding_sql(MESSY, ["email"]), duplicate_sql(MESSY),
    outlier_finding_sql(MESSY, MESSY_NUMBERS),
))


def messy_results(spark, folder):
    df = messy_customers(spark, folder)
    records = profile.profile_columns(df)
    return df, records, frequency.duplicate_rows(df), outliers.univariate_report(df, MESSY_NUMBERS)


@query("findings_report", MESSY_FINDINGS)
def findings_report(spark, folder):
    _, records, duplicates, extreme = messy_results(spark, folder)
    return shown(findings.findings_report(records, duplicates, extreme))


# -- charts -----------------------------------------------------------------------------------

@query("chart_histogram",
       "WITH r AS (SELECT min(value + 0.0) AS lo, max(value + 0.0) AS hi FROM events), c AS (SELECT "
       "least(floor((value - lo) / (hi - lo) * 50), 49)::INTEGER AS bin, count(*) AS count FROM events, r GROUP BY 1) "
       "SELECT g.bin::INTEGER AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS high, "
       "coalesce(count, 0) AS count FROM range(0, 50) g(bin) CROSS JOIN r LEFT JOIN c ON c.bin = g.bin")
def chart_histogram(spark, folder):
    result = charts.histogram(table(spark, folder, "events"), "value")
    return result.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


BOX_COLUMNS = ["value", "user_id", "gappy"]


def box_sql(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", min(x) AS min, any_value(q1) AS q25, quantile_cont(x, 0.5) AS median, any_value(q3) AS q75, max(x) AS max, "
        "min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS lower_whisker, max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS upper_whisker FROM ("
        f"SELECT ({column} + 0.0)::DOUBLE AS x, {nearest(column, source, 0.25)}::DOUBLE AS q1, {nearest(column, source, 0.75)}::DOUBLE AS q3 FROM {source} WHERE {column} IS NOT NULL)"
    )


@query("chart_box", " UNION ALL ".join(box_sql(c, WAVY_EVENTS) for c in BOX_COLUMNS))
def chart_box(spark, folder):
    return charts.box(wavy_events(spark, folder), BOX_COLUMNS)


@query("chart_bar", "SELECT c_nationkey::VARCHAR AS value, count(*) AS count FROM customer GROUP BY c_nationkey "
       "ORDER BY count(*) DESC, c_nationkey LIMIT 20")
def chart_bar(spark, folder):
    return charts.bar(table(spark, folder, "customer"), "c_nationkey")


@query("chart_pie", "SELECT value, count, round(count / sum(count) OVER (), 6) AS share FROM (SELECT coalesce(quality::VARCHAR, 'None') AS value, "
       f"count(*) AS count FROM {RATED_DOCUMENTS} GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 10)")
def chart_pie(spark, folder):
    return charts.pie(rated_documents(spark, folder), "quality")


@query("chart_scatter", f"SELECT s_suppkey, s_acctbal, pull FROM {PULLED_SUPPLIER}")
def chart_scatter(spark, folder):
    return charts.scatter(pulled_supplier(spark, folder), "s_acctbal", "pull", ["s_suppkey"])


@query("chart_scatter_sampled",
       "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 5000")
def chart_scatter_sampled(spark, folder):
    return charts.scatter(table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], sample_size=5000)


@query("chart_scatter_binned",
       "SELECT least(floor((o_custkey - x0) / (x1 - x0) * 50), 49)::INTEGER AS x_bin, "
       "least(floor((o_totalprice - y0) / (y1 - y0) * 50), 49)::INTEGER AS y_bin, count(*) AS count FROM orders, "
       "(SELECT min(o_custkey)::DOUBLE AS x0, max(o_custkey)::DOUBLE AS x1, min(o_totalprice) AS y0, max(o_totalprice) AS y1 FROM orders) "
       "GROUP BY 1, 2")
def chart_scatter_binned(spark, folder):
    return charts.binned_scatter(table(spark, folder, "orders"), "o_custkey", "o_totalprice")


CHART_ROWS = (
    "SELECT 'quantity' AS title, 50::BIGINT AS rows UNION ALL SELECT 'flags', count(DISTINCT l_returnflag) FROM lineitem UNION ALL "
    "SELECT 'price', count(*) FROM lineitem UNION ALL SELECT 'shares', count(DISTINCT l_linestatus) FROM lineitem"
)


@query("chart_data", CHART_ROWS)
def chart_data(spark, folder):
    """How many rows each chart of a plan has; a chart of a missing column has no data."""
    plan = local_table(spark, [
        (0, "histogram", ["l_quantity"], "quantity", ""), (1, "bar", ["l_returnflag"], "flags", ""),
        (2, "scatter", ["l_extendedprice", "l_quantity"], "price", ""), (3, "pie", ["l_linestatus"], "shares", ""),
        (4, "bar", ["gone"], "missing", ""),
    ], "place int, chart_type string, columns array<string>, title string, reason string")
    data = charts.chart_data(table(spark, folder, "lineitem"), plan, ["l_orderkey", "l_linenumber"])
    counts = [df.agg(F.lit(title).alias("title"), F.count(F.lit(1)).alias("rows")) for title, df in data.items()]
    return reduce(DataFrame.unionByName, counts)


@query("chart_line_binned", f"SELECT date_trunc('hour', ts) AS time, avg(gappy) AS value FROM {WAVY_EVENTS} WHERE gappy IS NOT NULL GROUP BY 1")
def chart_line_binned(spark, folder):
    return charts.line(wavy_events(spark, folder), "ts", "gappy", every="hour")


HEAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]


@query("chart_heatmap", matrix_sql("(SELECT *, 3 AS constant FROM lineitem)", HEAT))
def chart_heatmap(spark, folder):
    return charts.heatmap(table(spark, folder, "lineitem").withColumn("constant", F.lit(3)), HEAT)


@query("chart_line", f"SELECT ts AS time, gappy AS value FROM {WAVY_EVENTS} WHERE gappy IS NOT NULL")
def chart_line(spark, folder):
    return charts.line(wavy_events(spark, folder), "ts", "gappy", pixels=None)


@query("chart_line_outline",
       f"WITH rows AS (SELECT ts, gappy, epoch_us(ts) AS us FROM {WAVY_EVENTS} WHERE gappy IS NOT NULL), "
       "placed AS (SELECT ts, gappy, (us - (SELECT min(us) FROM rows))::HUGEINT * 800 // (SELECT max(us) - min(us) + 1 FROM rows) AS pixel FROM rows), "
       "kept AS (SELECT pixel, unnest([min({'t': ts, 'v': gappy}), max({'t': ts, 'v': gappy})]) AS s FROM placed GROUP BY pixel "
       "UNION SELECT pixel, {'t': x.t, 'v': x.v} FROM (SELECT pixel, unnest([min({'v': gappy, 't': ts}), max({'v': gappy, 't': ts})]) AS x FROM placed GROUP BY pixel)) "
       "SELECT s.t AS time, s.v AS value FROM kept")
def chart_line_outline(spark, folder):
    """What a drawing of 800 pixels needs of the line."""
    return charts.line(wavy_events(spark, folder), "ts", "gappy", pixels=800)


COSTED_LINEITEM = "(SELECT *, l_extendedprice * 0.5 - l_tax AS unit_cost FROM lineitem)"
COSTED_TYPES = {**LINEITEM, "unit_cost": "double"}
COSTED_NUMBERS = ["l_orderkey", "l_partkey", "l_extendedprice", "unit_cost"]


def costed_lineitem(spark, folder):
    return table(spark, folder, "lineitem").withColumn("unit_cost", F.col("l_extendedprice") * 0.5 - F.col("l_tax"))


def plan_sql(classes: str, pairs: str) -> str:
    """SQL for the chart plan from a class table and a table of high correlations."""
    return (
        f"WITH cl AS ({classes}), num AS (SELECT \"column\" AS c, row_number() OVER (ORDER BY position) AS i FROM cl WHERE detected_type = 'numeric'), "
        "cat AS (SELECT \"column\" AS c, row_number() OVER (ORDER BY position) AS i FROM cl WHERE detected_type = 'categorical'), "
        "times AS (SELECT arg_min(\"column\", position) AS t FROM cl WHERE detected_type = 'datetime'), "
        f"pairs AS (SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, col1, col2) AS i FROM ({pairs})), plan AS ("
        "SELECT 1 AS part, i, 'histogram' AS chart_type, c AS columns, 'Distribution of ' || c AS title, 'Shows the spread and shape of values' AS reason FROM num WHERE i <= 3 "
        "UNION ALL SELECT 2, 1, 'box', string_agg(c, ',' ORDER BY i), 'Box plots of numeric columns', 'Compare distributions and spot outliers' FROM num WHERE i <= 6 HAVING count(*) > 0 "
        "UNION ALL SELECT 3, i, 'bar', c, 'Value counts for ' || c, 'Shows category distribution' FROM cat WHERE i <= 2 "
        "UNION ALL SELECT 4, i, 'scatter', col1 || ',' || col2, col1 || ' vs ' || col2 || ' (r=' || correlation || ')', 'High correlation: ' || correlation FROM pairs WHERE i <= 2 "
        "UNION ALL SELECT 5, 1, 'heatmap', string_agg(c, ',' ORDER BY i), 'Correlation heatmap', 'Overview of numeric relationships' FROM num WHERE i <= 10 HAVING (SELECT count(*) FROM num) >= 3 "
        "UNION ALL SELECT 6, i, 'line', t || ',' || c, c || ' over time', 'Time trend visualization' FROM num, times WHERE i <= 2 AND t IS NOT NULL) "
        "SELECT (row_number() OVER (ORDER BY part, i) - 1)::INTEGER AS place, chart_type, columns, title, reason FROM plan "
        "QUALIFY row_number() OVER (ORDER BY part, i) <= 10"
    )


def high_sql(source: str, columns: list[str]) -> str:
    return (
        f"SELECT * FROM ({matrix_sql(source, columns)}) WHERE abs(correlation) >= 0.7 AND (col1, col2) IN ("
        + ", ".join(f"('{a}', '{b}')" for a, b in combinations(columns, 2)) + ")"
    )


@query("chart_plan", plan_sql(class_sql(COSTED_LINEITEM, COSTED_TYPES), high_sql(COSTED_LINEITEM, COSTED_NUMBERS)))
def chart_plan(spark, folder):
    df = costed_lineitem(spark, folder)
    plan = charts.chart_plan(profile.column_types(df), association.high_correlations(df, COSTED_NUMBERS))
    return plan.withColumn("columns", F.array_join("columns", ","))


# -- summaries and reports --------------------------------------------------------------------

@query("summary_docs",
       f"WITH rec AS ({record_sql(CONTACT_CUSTOMERS, CONTACTS)}), ds AS ({dataset_sql(CONTACT_CUSTOMERS, CONTACTS)}), "
       "lines AS (SELECT string_agg('Column ''' || \"column\" || ''': type=' || detected_type || ', dtype=' || dtype || "
       "CASE WHEN mean IS NOT NULL THEN ', mean=' || mean || ', min=' || min || ', max=' || max "
       "WHEN detected_type IN ('categorical', 'text') THEN ', ' || n_unique || ' unique values' ELSE '' END, chr(10) ORDER BY position) AS body FROM rec) "
       "SELECT 'customers_schema' AS id, 'customers' AS dataset_id, 'schema' AS type, 'Dataset: customer.parquet' || chr(10) || 'Shape: ' || rows || "
       "' rows x ' || columns || ' columns' || chr(10) || 'Columns:' || chr(10) || body AS doc FROM ds, lines UNION ALL "
       "SELECT 'customers_profile', 'customers', 'profile', 'Data quality: ' || completeness_pct || '% complete, ' || total_nulls || ' total nulls, ' || "
       "duplicate_rows || ' duplicate rows. Type breakdown: numeric: ' || numeric_columns || ', categorical: ' || categorical_columns || "
       "', datetime: ' || datetime_columns || ', text: ' || text_columns FROM ds UNION ALL "
       "SELECT 'customers_samples', 'customers', 'samples', 'Sample data rows:' || chr(10) || string_agg('Row ' || c_custkey || ': {\"c_custkey\":' || c_custkey || "
       "',\"c_mktsegment\":\"' || c_mktsegment || '\"}', chr(10) ORDER BY c_custkey) FROM customer WHERE c_custkey < 5")
def summary_docs(spark, folder):
    df = contact_customers(spark, folder)
    sample = df.where("c_custkey < 10").select(
        F.col("c_custkey").cast("int").alias("place"), "c_custkey", "c_mktsegment"
    )
    return documents.summary_documents(
        "customers", profile.profile_columns(df), profile.profile_dataset(df), sample, "customer.parquet"
    )


MESSY_PAIRS = ["c_acctbal", "rarely", "extreme"]
FILLED_MESSY = (
    f"(WITH m AS (SELECT * FROM {MESSY}) SELECT coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM m)) AS c_acctbal, "
    "coalesce(rarely, (SELECT avg(rarely) FROM m)) AS rarely, extreme, "
    "coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM m)) * 2 AS twice FROM m)"
)


@query("report_lines",
       f"WITH ds AS ({dataset_sql(MESSY, MESSY_TYPES)}), sc AS ({score_sql(MESSY, MESSY_TYPES, MESSY_NUMBERS)}), "
       f"fi AS (SELECT *, row_number() OVER (ORDER BY title) AS n FROM ({MESSY_FINDINGS})), "
       f"co AS (SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, col1, col2) AS n FROM ({high_sql(FILLED_MESSY, [*MESSY_PAIRS, 'twice'])})) "
       "SELECT 'executive_summary' AS section, 1::INTEGER AS line_no, 'This dataset contains ' || rows || ' rows and ' || columns || ' columns. Overall data quality score: ' "
       "|| quality_score || '/100. The analysis identified ' || (SELECT count(*) FROM fi) || ' potential issues.' AS text FROM ds, sc "
       "UNION ALL SELECT 'data_quality', 1, 'Completeness: ' || completeness_pct || '% of cells contain values.' FROM ds "
       "UNION ALL SELECT 'data_quality', 2, 'Duplicate rows: ' || duplicate_rows || '.' FROM ds "
       "UNION ALL SELECT 'data_quality', ((n - 1) * 3 + 3)::INTEGER, '[' || upper(severity) || '] ' || title FROM fi "
       "UNION ALL SELECT 'data_quality', ((n - 1) * 3 + 4)::INTEGER, '  ' || description FROM fi "
       "UNION ALL SELECT 'data_quality', ((n - 1) * 3 + 5)::INTEGER, '  Recommendation: ' || recommendation FROM fi "
       "UNION ALL SELECT 'key_findings', 1, count(*) || ' findings' FROM fi "
       "UNION ALL SELECT 'patterns', n::INTEGER, '- Strong correlation between ' || col1 || ' and ' || col2 || ' (r=' || correlation || ')' FROM co WHERE n <= 5 "
       "UNION ALL SELECT 'recommendations', 1, '- Address any high-severity data quality issues before further analysis.' "
       "UNION ALL SELECT 'recommendations', 2, '- Investigate highly correlated variables for potential redundancy.' "
       "UNION ALL SELECT 'recommendations', 3, '- Review and deduplicate rows if appropriate.' FROM ds WHERE duplicate_rows > 0".replace(
           "count(*) || ' findings'", "'- ' || count(*) || ' findings.'"))
def report_lines(spark, folder):
    df, records, duplicates, extreme = messy_results(spark, folder)
    found = findings.findings_report(records, duplicates, extreme)
    dataset = profile.dataset_profile_of(records, duplicates)
    takeaways = found.agg(F.format_string("%d findings.", F.count(F.lit(1))).alias("takeaway")).select(
        F.lit(1).alias("place"), "takeaway"
    )
    doubled = df.withColumn("twice", F.col("c_acctbal") * 2)
    related = association.high_correlations(doubled, [*MESSY_PAIRS, "twice"])
    return documents.report_lines(dataset, findings.quality_score(dataset, extreme), found, takeaways, related)


# -- the whole analysis -------------------------------------------------------------------------

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ANALYZED = (
    "SELECT 'dataset' AS result, 'rows' AS key, count(*)::VARCHAR AS value FROM orders UNION ALL "
    "SELECT 'dataset', 'total_nulls', '0' UNION ALL "
    "SELECT 'dataset', 'duplicate_rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)))::VARCHAR FROM orders UNION ALL "
    f"SELECT 'correlations', col1 || ',' || col2, format('{{:.4f}}', correlation) FROM ({matrix_sql('orders', ORDER_NUMBERS)}) "
    "WHERE abs(correlation) >= 0.7 AND col1 < col2 UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'normality', \"column\", format('{{:.6f}}', statistic) FROM ({shapiro_sql(c, 'orders')}) UNION ALL "
        f"SELECT 'distributions', \"column\", format('{{:.4f}}', statistic) FROM ({anderson_sql(c, 'orders')}) UNION ALL "
        f"SELECT 'outliers', \"column\", count::VARCHAR FROM ({outlier_sql(c, 'orders')}) WHERE count > 0"
        for c in ORDER_NUMBERS
    )
)


@query("analyze_summary", ANALYZED)
def analyze_summary(spark, folder):
    """One value of each main result of the whole analysis of a table."""
    from tabscope.plans.analyze import analyze

    results = analyze(table(spark, folder, "orders"), ["o_orderkey"])

    def lines(result, key, value):
        return results[result].select(F.lit(result).alias("result"), key.alias("key"), value.alias("value"))

    facts = [lines("dataset", F.lit(c), F.col(c).cast("string")) for c in ("rows", "total_nulls", "duplicate_rows")]
    facts += [
        lines("correlations", F.concat("col1", F.lit(","), "col2"), F.format_string("%.4f", "correlation")),
        lines("normality", F.col("column"), F.format_string("%.6f", "statistic")),
        lines("distributions", F.col("column"), F.format_string("%.4f", "statistic")),
        lines("outliers", F.col("column"), F.col("count").cast("string")),
    ]
    return reduce(DataFrame.unionByName, facts)


def tagged_documents(spark, folder):
    return table(spark, folder, "documents").select("lang", "source")


TAGGED_DUPLICATES = "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)))"


@query("quality_context",
       "SELECT 1 AS part, 0 AS place, 'Dataset: ' || count(*) || ' rows, 2 columns' AS text FROM documents UNION ALL "
       "SELECT 1, 1, 'Completeness: 100.0%' UNION ALL "
       f"SELECT 1, 2, 'Duplicate rows: ' || {TAGGED_DUPLICATES} FROM documents UNION ALL "
       "SELECT 2, 0, '- lang (categorical): 0.0% null, ' || count(DISTINCT lang) || ' unique' FROM documents UNION ALL "
       "SELECT 2, 1, '- source (categorical): 0.0% null, ' || count(DISTINCT source) || ' unique' FROM documents")
def quality_context(spark, folder):
    from tabscope.plans.analyze import analyze

    results = analyze(tagged_documents(spark, folder))
    return contexts.quality_context(
        results["columns"], results["dataset"], results["outliers"], results["multivariate_outliers"]
    )


@query("report_context_overview",
       "SELECT 0 AS place, 'DATASET OVERVIEW' AS text UNION ALL "
       "SELECT 1, 'Rows: ' || count(*) || ', Columns: 2' FROM documents UNION ALL SELECT 2, 'Completeness: 100.0%' UNION ALL "
       f"SELECT 3, 'Duplicate rows: ' || {TAGGED_DUPLICATES} FROM documents UNION ALL "
       "SELECT 4, 'Type breakdown: numeric: 0, categorical: 2, datetime: 0, text: 0'")
def report_context_overview(spark, folder):
    from tabscope.plans.analyze import analyze

    results = analyze(tagged_documents(spark, folder))
    context = contexts.report_context(*(results[r] for r in (
        "dataset", "findings", "quality_score", "takeaways", "interpretations", "correlations"
    )))
    return context.where("part = 1").select("place", "text")


@query("chart_context",
       "SELECT 1 AS part, 0 AS place, 'Columns:' AS text UNION ALL "
       + " UNION ALL ".join(
           f"SELECT 1, {i}, '  {c}: {kind}, ' || count(DISTINCT {c}) || ' unique, 0.0% null' FROM orders"
           for i, (c, kind) in enumerate((("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderdate", "datetime")), 1)
       ) + " UNION ALL SELECT 2, 0, 'High correlations:' UNION ALL "
       "SELECT 2, 1, '  o_totalprice <-> tripled: 1.0' UNION ALL SELECT 1, 4, '  tripled: numeric, ' || count(DISTINCT o_totalprice * 3) || "
       "' unique, 0.0% null' FROM orders UNION ALL SELECT 3, 0, 'Time columns: o_orderdate'")
def chart_context(spark, folder):
    df = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderdate").withColumn(
        "tripled", F.col("o_totalprice") * 3
    )
    columns = profile.profile_columns(df)
    return contexts.chart_context(columns, association.high_correlations(df, ["o_custkey", "o_totalprice", "tripled"]))
