"""Registered queries: correlation, association, statistical tests, outliers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabscope.functions.bounded import local_table
from tabscope.operators import association, contexts, forest, inference, outliers
from tabscope.plans.profile_queries import LINEITEM_MEASURES, nearest
from tabscope.plans.registry import GAPPY_LINEITEM, gappy_lineitem, per_column, query, table

# -- correlation ------------------------------------------------------------------------------

DOC_MEASURES = ["doc_id", "n_chars", "n_words", "n_lines", "quality", "constant"]
MEASURED_DOCUMENTS = (
    "(SELECT d.doc_id, d.n_chars, len(string_split(d.text, ' '))::INTEGER AS n_words, "
    "len(string_split(d.text, chr(10)))::INTEGER AS n_lines, l.quality, 3 AS constant "
    "FROM documents d LEFT JOIN labels l USING (doc_id))"
)
FILLED_DOCUMENTS = (
    "(SELECT * REPLACE (coalesce(quality, trunc((SELECT avg(quality) FROM labels))::INTEGER) AS quality) "
    f"FROM {MEASURED_DOCUMENTS})"
)


def measured_documents(spark, folder):
    """documents measured in characters, words and lines, some with a quality label."""
    documents = table(spark, folder, "documents").select(
        "doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"), F.lit(3).alias("constant"),
    )
    return documents.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")


def matrix_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, round(coalesce(CASE WHEN isnan(corr({a}, {b})) THEN NULL "
        f"ELSE corr({a}, {b}) END, 0), 4)::DOUBLE AS correlation FROM {source}"
        for a in columns for b in columns
    )


@query("pearson_matrix", matrix_sql(FILLED_DOCUMENTS, [c for c in DOC_MEASURES if c != "constant"]))
def pearson_matrix(spark, folder):
    return association.pearson_matrix(measured_documents(spark, folder), DOC_MEASURES)


@query("high_correlations",
       f"SELECT * FROM ({matrix_sql(FILLED_DOCUMENTS, DOC_MEASURES)}) WHERE abs(correlation) >= 0.7 AND (col1, col2) IN ("
       + ", ".join(f"('{a}', '{b}')" for a, b in combinations(DOC_MEASURES, 2)) + ")")
def high_correlations(spark, folder):
    return association.high_correlations(measured_documents(spark, folder), DOC_MEASURES)


# -- association ------------------------------------------------------------------------------

CATEGORIES = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "price_band", "ship_quarter"]
BANDED_LINEITEM = (
    "(SELECT *, CASE WHEN l_extendedprice < 20000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'mid' ELSE 'high' END "
    f"AS price_band, CASE WHEN l_linenumber <> 3 THEN quarter(l_shipdate)::INTEGER END AS ship_quarter FROM {GAPPY_LINEITEM})"
)


def banded_lineitem(spark, folder):
    """lineitem with a price band and a quarter that is missing on line 3."""
    price = F.col("l_extendedprice")
    return gappy_lineitem(spark, folder).withColumns({
        "price_band": F.when(price < 20000, "low").when(price < 50000, "mid").otherwise("high"),
        "ship_quarter": F.when(F.col("l_linenumber") != 3, F.quarter("l_shipdate")),
    })


DENSE = (
    "SELECT a, b, coalesce(observed, 0) AS observed FROM (SELECT DISTINCT {x}::VARCHAR AS a FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) "
    "CROSS JOIN (SELECT DISTINCT {y}::VARCHAR AS b FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) "
    "LEFT JOIN (SELECT {x}::VARCHAR AS a, {y}::VARCHAR AS b, count(*) AS observed FROM {t} GROUP BY 1, 2) USING (a, b)"
)


STEPPED = f"(SELECT *, floor(l_extendedprice / 10000)::INTEGER AS price_step FROM {GAPPY_LINEITEM})"


def stepped_lineitem(spark, folder):
    """lineitem with its price in steps: small quantities never reach the upper ones, so cells are empty."""
    return gappy_lineitem(spark, folder).withColumn("price_step", F.floor(F.col("l_extendedprice") / 10000).cast("int"))


@query("contingency", DENSE.format(x="l_quantity", y="price_step", t=STEPPED))
def contingency(spark, folder):
    return association.contingency(stepped_lineitem(spark, folder), "l_quantity", "price_step")


@query("contingency_expected",
       "SELECT a, b, observed, row_total, col_total, round(row_total * col_total / n, 6) AS expected FROM ("
       "SELECT *, (sum(observed) OVER (PARTITION BY a))::BIGINT AS row_total, "
       "(sum(observed) OVER (PARTITION BY b))::BIGINT AS col_total, (sum(observed) OVER ())::BIGINT AS n "
       f"FROM ({DENSE.format(x='l_quantity', y='price_step', t=STEPPED)}))")
def contingency_expected(spark, folder):
    result = association.contingency_expected(stepped_lineitem(spark, folder), "l_quantity", "price_step")
    return result.withColumn("expected", F.round("expected", 6))


CHI_SQUARE = (
    "SELECT '{x}' AS col1, '{y}' AS col2, max(n) AS n, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb, "
    "sum((observed - e) * (observed - e) / e) AS chi2, "
    "sum(power(greatest(abs(observed - e) - 0.5, 0), 2) / e) AS yates FROM ("
    "SELECT *, (sum(observed) OVER (PARTITION BY a)) * (sum(observed) OVER (PARTITION BY b)) / sum(observed) OVER () AS e, "
    "sum(observed) OVER () AS n FROM (" + DENSE + "))"
)
PAIRS = list(combinations(CATEGORIES, 2))
ALL_CHI = " UNION ALL ".join("(" + CHI_SQUARE.format(x=x, y=y, t="banded") + ")" for x, y in PAIRS)
WITH_BANDED = f"WITH banded AS (SELECT * FROM {BANDED_LINEITEM}), stats AS ({ALL_CHI}) "
V = "round(least(sqrt(chi2 / (n * (least(ra, rb) - 1))), 1.0), 4)"


@query("cramers_v", WITH_BANDED + f"SELECT col1, col2, {V}::DOUBLE AS cramers_v FROM stats")
def cramers_v(spark, folder):
    return association.cramers_v(banded_lineitem(spark, folder), PAIRS)


@query("categorical_associations",
       WITH_BANDED + f"SELECT col1, col2, {V}::DOUBLE AS cramers_v FROM stats WHERE {V} > 0.1")
def categorical_associations(spark, folder):
    return association.categorical_associations(banded_lineitem(spark, folder), CATEGORIES)


PRICED = ["l_extendedprice", "unit_cost", "l_orderkey", "l_partkey"]


@query("correlation_report",
       f"WITH banded AS (SELECT *, l_extendedprice * 0.5 - l_tax AS unit_cost FROM {BANDED_LINEITEM}), stats AS ({ALL_CHI}) "
       f"SELECT 'cramers_v' AS kind, col1, col2, {V}::DOUBLE AS value FROM stats WHERE {V} > 0.1 UNION ALL "
       f"SELECT 'pearson', col1, col2, correlation FROM ({matrix_sql('banded', PRICED)}) WHERE abs(correlation) >= 0.7 "
       "AND (col1, col2) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in combinations(PRICED, 2)) + ")")
def correlation_report(spark, folder):
    df = banded_lineitem(spark, folder).withColumn(
        "unit_cost", F.col("l_extendedprice") * 0.5 - F.col("l_tax")
    )
    return association.correlation_report(df, PRICED, CATEGORIES)


# -- statistical tests ------------------------------------------------------------------------

# P(X <= x) of a gamma variable with shape a: x^a e^-x sum x^k / gamma(a+k+1); the terms are
# listed up to where they vanish.
GAMMA_P = (
    "list_sum(list_transform(range(0, {terms}), lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1))))"
)
CHI_TAIL = (
    "CASE WHEN stat <= 0 THEN 1.0 WHEN stat / 2 > 900 THEN 0.0 ELSE 1 - "
    + GAMMA_P.format(a="(dof / 2)", x="(stat / 2)", terms="2000") + " END"
)
CHI_TESTS = (
    "(SELECT col1, col2, stat, dof, " + CHI_TAIL + " AS p FROM (SELECT *, CASE WHEN dof = 1 THEN yates ELSE chi2 END AS stat "
    "FROM (SELECT *, ((ra - 1) * (rb - 1))::INTEGER AS dof FROM stats WHERE n >= 10 AND ra BETWEEN 2 AND 20 AND rb BETWEEN 2 AND 20)))"
)


@query("chi_square", WITH_BANDED +
       "SELECT col1, col2, 'chi_square' AS test, round(stat, 4)::DOUBLE AS statistic, round(abs(p), 6)::DOUBLE AS p_value, "
       f"dof, p < 0.05 AS significant, NULL::VARCHAR AS skipped FROM {CHI_TESTS} UNION ALL "
       "SELECT col1, col2, 'chi_square', NULL, NULL, NULL, NULL, CASE WHEN coalesce(n, 0) < 10 THEN 'fewer than 10 complete rows' "
       "WHEN least(ra, rb) < 2 THEN 'a column has one value' ELSE 'too many values' END FROM stats "
       "WHERE coalesce(n, 0) < 10 OR ra NOT BETWEEN 2 AND 20 OR rb NOT BETWEEN 2 AND 20")
def chi_square(spark, folder):
    return inference.chi_square_tests(banded_lineitem(spark, folder), CATEGORIES)


def moment_sql(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", n, round(m3 / power(m2, 1.5), 4)::DOUBLE AS skewness, "
        f"round(m4 / (m2 * m2) - 3, 4)::DOUBLE AS kurtosis FROM (SELECT count(*) AS n, avg(power(d, 2)) AS m2, "
        f"avg(power(d, 3)) AS m3, avg(power(d, 4)) AS m4 FROM (SELECT {column} - avg({column}) OVER () AS d "
        f"FROM {source} WHERE {column} IS NOT NULL))"
    )


@query("skew_kurtosis", " UNION ALL ".join(moment_sql(c, GAPPY_LINEITEM) for c in LINEITEM_MEASURES))
def skew_kurtosis(spark, folder):
    return inference.skew_kurtosis(gappy_lineitem(spark, folder), LINEITEM_MEASURES)


# Wichura (1988), algorithm AS 241, the normal quantile; highest power first.
CENTRAL = (
    (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
     1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
    (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
     5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0),
)
TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
     3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0),
)


def polynomial_sql(coefficients: tuple, x: str) -> str:
    text = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def normal_quantile_sql(p: str) -> str:
    """SQL for the normal quantile of a probability between 1e-11 and 1 - 1e-11."""
    centre = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    far = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)"
    return (
        f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {polynomial_sql(CENTRAL[0], centre)} / {polynomial_sql(CENTRAL[1], centre)} "
        f"ELSE sign({p} - 0.5) * {polynomial_sql(TAIL[0], far)} / {polynomial_sql(TAIL[1], far)} END"
    )


def upper_tail_sql(z: str) -> str:
    """SQL for P(Z > z) with an absolute error near 1e-16."""
    return (
        f"CASE WHEN abs({z}) > 8 THEN CASE WHEN {z} > 0 THEN 0.0 ELSE 1.0 END ELSE 0.5 - 0.5 * sign({z}) * "
        f"coalesce({GAMMA_P.format(a='0.5', x=f'({z} * {z} / 2)', terms='200')}, 0) END"
    )


def horner_sql(coefficients: tuple, x: str) -> str:
    return polynomial_sql(tuple(reversed(coefficients)), x)


# Royston (1995), algorithm AS R94; lowest power first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_SHIFT = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def shapiro_sql(column: str, source: str) -> str:
    """SQL for the Shapiro-Wilk test of 8 values or more, from the published formulas."""
    m = normal_quantile_sql("((i - 0.375) / (n + 0.25))")
    last = f"(mn / sqrt(mm) + {horner_sql(LAST_WEIGHT, '(1 / sqrt(n))')})"
    bound = horner_sql(SMALL_SHIFT, "n")
    second = f"(mn1 / sqrt(mm) + {horner_sql(SECOND_WEIGHT, '(1 / sqrt(n))')})"
    return (
        f"(WITH ranked AS (SELECT x, i, n, {m} AS m FROM (SELECT {column} + 0.0 AS x, "
        f"row_number() OVER (ORDER BY {column}) AS i, count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL)), "
        "scores AS (SELECT *, sum(m * m) OVER () AS mm, max(m) OVER () AS mn, "
        "max(m) FILTER (i = n - 1) OVER () AS mn1, avg(x) OVER () AS mean FROM ranked), "
        f"ends AS (SELECT *, {last} AS an, {second} AS an1 FROM scores), "
        "weighted AS (SELECT *, CASE i WHEN n THEN an WHEN n - 1 THEN an1 WHEN 1 THEN -an WHEN 2 THEN -an1 "
        "ELSE m / sqrt((mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)) END AS a FROM ends), "
        "w AS (SELECT max(n) AS n, power(sum(a * (x - mean)), 2) / sum(power(x - mean, 2)) AS w FROM weighted), "
        f"z AS (SELECT *, CASE WHEN n > 11 THEN (ln(1 - w) - {horner_sql(LARGE_MEAN, 'ln(n)')}) / exp({horner_sql(LARGE_LOG_SD, 'ln(n)')}) "
        f"WHEN ln(1 - w) < {bound} THEN (-ln({bound} - ln(1 - w)) - {horner_sql(SMALL_MEAN, 'n')}) / exp({horner_sql(SMALL_LOG_SD, 'n')}) "
        f"ELSE 100.0 END AS z FROM w), p AS (SELECT *, {upper_tail_sql('z')} AS p FROM z) "
        f"SELECT '{column}' AS \"column\", 'shapiro_wilk' AS test, p.n AS sample_size, round(w, 6) AS statistic, "
        f"round(abs(p), 6)::DOUBLE AS p_value, p > 0.05 AS is_normal, skewness, kurtosis FROM p, ({moment_sql(column, source)}))"
    )


SUPPLIER_MEASURES = ["s_acctbal", "s_suppkey", "pull"]
PULLED_SUPPLIER = (
    "(SELECT s_suppkey, s_acctbal, s_acctbal + (s_suppkey * 7919 % 1000) * 10.0 + (s_suppkey * 104729 % 1000) * 10.0 AS pull FROM supplier)"
)


def pulled_supplier(spark, folder):
    """supplier with a sum of three nearly uniform numbers, which is close to normal."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        "s_suppkey", "s_acctbal",
        (F.col("s_acctbal") + key * 7919 % 1000 * 10.0 + key * 104729 % 1000 * 10.0).alias("pull"),
    )


SHAPIRO = " UNION ALL ".join(shapiro_sql(c, PULLED_SUPPLIER) for c in SUPPLIER_MEASURES)


@query("shapiro_wilk_few", SHAPIRO)
def shapiro_wilk_few(spark, folder):
    return inference.normality_tests(pulled_supplier(spark, folder), SUPPLIER_MEASURES)


@query("shapiro_wilk", " UNION ALL ".join(shapiro_sql(c, GAPPY_LINEITEM) for c in LINEITEM_MEASURES))
def shapiro_wilk(spark, folder):
    return inference.normality_tests(gappy_lineitem(spark, folder), LINEITEM_MEASURES)


LOG_UPPER = (
    "CASE WHEN {z} > 3 THEN -{z} * {z} / 2 - 0.5 * ln(2 * pi()) - ln(list_reduce(list_prepend({z}, "
    "list_transform(range(150, 0, -1), lambda j: j::DOUBLE)), lambda acc, k: {z} + k / acc)) ELSE ln({q}) END"
)


def log_upper_sql(z: str) -> str:
    return LOG_UPPER.format(z=z, q=upper_tail_sql(z))


def anderson_sql(column: str, source: str) -> str:
    values = {"15": 0.576, "10": 0.656, "5": 0.787, "2.5": 0.918, "1": 1.092}
    limits = ", ".join(
        f"round({v} / (1 + 4.0 / n - 25.0 / (n::DOUBLE * n)), 3)::DOUBLE AS critical_{k.replace('.', '_')}pct" for k, v in values.items()
    )
    five = "round(0.787 / (1 + 4.0 / n - 25.0 / (n::DOUBLE * n)), 3)"
    return (
        f"SELECT '{column}' AS \"column\", 'anderson_darling' AS test, round(a2, 4) AS statistic, {limits}, a2 < {five} AS likely_normal "
        "FROM (SELECT max(n) AS n, -max(n) - sum((2 * i - 1) * lower + (2 * n + 1 - 2 * i) * upper) / max(n) AS a2 FROM "
        f"(SELECT i, n, {log_upper_sql('(-z)')} AS lower, {log_upper_sql('z')} AS upper FROM "
        f"(SELECT row_number() OVER (ORDER BY x) AS i, n, (x - mean) / sd AS z FROM (SELECT x, count(*) OVER () AS n, "
        f"avg(x) OVER () AS mean, stddev_samp(x) OVER () AS sd FROM (SELECT {column} + 0.0 AS x FROM {source} WHERE {column} IS NOT NULL)))) "
        "HAVING max(n) >= 20)"
    )


ANDERSON_COLUMNS = ["value", "user_id"]


@query("anderson_darling", " UNION ALL ".join(anderson_sql(c, "events") for c in ANDERSON_COLUMNS))
def anderson_darling(spark, folder):
    events = table(spark, folder, "events").withColumn("constant", F.lit(1.5))
    return inference.distribution_tests(events, [*ANDERSON_COLUMNS, "constant"])


# more columns than any bound on columns or pairs that a report might have
MANY = [f"c{i}" for i in range(17)]
MANY_ORDERS = "(SELECT " + ", ".join(
    f"((o_custkey * {i + 1} + o_orderkey) % {i % 5 + 2}) AS {c}" for i, c in enumerate(MANY)
) + " FROM orders)"


def many_orders(spark, folder):
    key = F.col("o_custkey")
    return table(spark, folder, "orders").select(*[
        ((key * (i + 1) + F.col("o_orderkey")) % (i % 5 + 2)).alias(c) for i, c in enumerate(MANY)
    ])


@query("anderson_darling_wide", " UNION ALL ".join(anderson_sql(c, MANY_ORDERS) for c in MANY))
def anderson_darling_wide(spark, folder):
    return inference.distribution_tests(many_orders(spark, folder), MANY)


@query("pearson_matrix_wide", matrix_sql(MANY_ORDERS, MANY))
def pearson_matrix_wide(spark, folder):
    return association.pearson_matrix(many_orders(spark, folder), MANY)


MANY_STATS = (
    f"WITH many AS (SELECT * FROM {MANY_ORDERS}), stats AS ("
    + " UNION ALL ".join("(" + CHI_SQUARE.format(x=x, y=y, t="many") + ")" for x, y in combinations(MANY, 2)) + ") "
)


@query("chi_square_wide", MANY_STATS + "SELECT col1, col2, round(stat, 4)::DOUBLE AS statistic, dof FROM " + CHI_TESTS)
def chi_square_wide(spark, folder):
    return inference.chi_square_tests(many_orders(spark, folder), MANY).select("col1", "col2", "statistic", "dof")


@query("categorical_associations_wide", MANY_STATS + f"SELECT col1, col2, {V}::DOUBLE AS cramers_v FROM stats WHERE {V} > 0.1")
def categorical_associations_wide(spark, folder):
    return association.categorical_associations(many_orders(spark, folder), MANY)


TESTED_SUPPLIER = f"(SELECT *, s_suppkey % 3 AS third, s_suppkey % 2 AS half, CASE WHEN s_suppkey % 6 < 2 THEN 'x' ELSE 'y' END AS mark FROM {PULLED_SUPPLIER})"
SUPPLIER_CATEGORIES = ["third", "half", "mark"]


def tested_supplier(spark, folder):
    key = F.col("s_suppkey")
    return pulled_supplier(spark, folder).withColumns({
        "third": key % 3, "half": key % 2, "mark": F.when(key % 6 < 2, "x").otherwise("y"),
    })


SUPPLIER_TESTS = (
    f"WITH tested AS (SELECT * FROM {TESTED_SUPPLIER}), stats AS ("
    + " UNION ALL ".join("(" + CHI_SQUARE.format(x=x, y=y, t="tested") + ")" for x, y in combinations(SUPPLIER_CATEGORIES, 2))
    + "), chi AS (SELECT col1, col2, round(stat, 4)::DOUBLE AS statistic, round(abs(p), 6)::DOUBLE AS p_value, p < 0.05 AS significant "
    f"FROM {CHI_TESTS}), normality AS ({SHAPIRO}) "
)


def supplier_tests(spark, folder):
    df = tested_supplier(spark, folder)
    normality = inference.normality_tests(df, SUPPLIER_MEASURES)
    return df, normality, inference.chi_square_tests(df, SUPPLIER_CATEGORIES)


@query("test_interpretations", SUPPLIER_TESTS +
       "SELECT 'Shapiro-Wilk normality' AS test_name, \"column\" AS columns, CASE WHEN is_normal THEN 'Appears normally distributed' "
       "ELSE 'Not normally distributed' END || ' (p=' || p_value || '). Skewness: ' || skewness || '.' AS result_summary, "
       "CASE WHEN is_normal THEN 'not_significant' ELSE 'significant' END AS significance, CASE WHEN is_normal THEN "
       "'Parametric tests are appropriate.' ELSE 'Consider non-parametric methods or transformations.' END AS practical_meaning "
       "FROM normality UNION ALL SELECT 'Chi-square independence', col1 || ',' || col2, CASE WHEN significant THEN "
       "'Statistically significant' ELSE 'No significant' END || ' relationship found (p=' || p_value || ').', "
       "CASE WHEN significant THEN 'significant' ELSE 'not_significant' END, CASE WHEN significant THEN "
       "'These variables appear to be related.' ELSE 'No evidence of association between these variables.' END FROM chi")
def test_interpretations(spark, folder):
    _, normality, chi = supplier_tests(spark, folder)
    result = inference.interpretations(normality, chi)
    return result.withColumn("columns", F.array_join("columns", ","))


@query("test_takeaways", SUPPLIER_TESTS +
       "SELECT 1::INTEGER AS place, count(*) FILTER (is_normal) || '/' || count(*) || ' numeric columns follow a normal distribution.' "
       "AS takeaway FROM normality UNION ALL SELECT 2, count(*) FILTER (significant) || ' significant categorical relationships found.' FROM chi")
def test_takeaways(spark, folder):
    _, normality, chi = supplier_tests(spark, folder)
    return inference.takeaways(normality, chi)


@query("tests_context", SUPPLIER_TESTS +
       ", high AS (SELECT * FROM (" + matrix_sql("tested", SUPPLIER_MEASURES) + ") WHERE abs(correlation) >= 0.7 AND (col1, col2) IN ("
       + ", ".join(f"('{a}', '{b}')" for a, b in combinations(SUPPLIER_MEASURES, 2)) + ")), lines AS ("
       "SELECT 1 AS part, (row_number() OVER (ORDER BY \"column\"))::INTEGER AS place, '  ' || \"column\" || ': p=' || p_value || "
       "CASE WHEN is_normal THEN ' (normal)' ELSE ' (not normal)' END || ', skew=' || skewness AS text FROM normality UNION ALL "
       "SELECT 2, (row_number() OVER (ORDER BY col1, col2))::INTEGER, '  ' || col1 || ' vs ' || col2 || ': p=' || p_value || "
       "CASE WHEN significant THEN ' (significant)' ELSE ' (not significant)' END FROM chi UNION ALL "
       "SELECT 3, (row_number() OVER (ORDER BY abs(correlation) DESC, col1, col2))::INTEGER, '  ' || col1 || ' <-> ' || col2 || ': r=' || "
       "correlation FROM high) SELECT * FROM lines UNION ALL SELECT DISTINCT part, 0, ['Normality Tests (Shapiro-Wilk):', "
       "'Chi-Square Independence Tests:', 'High Correlations:'][part] FROM lines")
def tests_context(spark, folder):
    df, normality, chi = supplier_tests(spark, folder)
    return contexts.tests_context(normality, chi, association.high_correlations(df, SUPPLIER_MEASURES))


@query("statistics_report", SUPPLIER_TESTS +
       "SELECT test, \"column\" AS columns, statistic, p_value, CASE WHEN is_normal THEN 'normal' ELSE 'not normal' END AS verdict FROM normality "
       "UNION ALL SELECT 'chi_square', col1 || ',' || col2, statistic, p_value, CASE WHEN significant THEN 'significant' ELSE 'not significant' END FROM chi "
       "UNION ALL SELECT test, \"column\", statistic, NULL, CASE WHEN likely_normal THEN 'likely normal' ELSE 'not normal' END FROM ("
       + " UNION ALL ".join(anderson_sql(c, "tested") for c in SUPPLIER_MEASURES) +
       ") UNION ALL SELECT 'pearson', col1 || ',' || col2, correlation, NULL, 'high correlation' FROM ("
       + matrix_sql("tested", SUPPLIER_MEASURES) + ") WHERE abs(correlation) >= 0.7 AND (col1, col2) IN ("
       + ", ".join(f"('{a}', '{b}')" for a, b in combinations(SUPPLIER_MEASURES, 2)) + ")")
def statistics_report(spark, folder):
    df, normality, chi = supplier_tests(spark, folder)
    report = inference.statistics_report(
        normality, chi, inference.distribution_tests(df, SUPPLIER_MEASURES),
        association.high_correlations(df, SUPPLIER_MEASURES),
    )
    return report.withColumn("columns", F.array_join("columns", ","))


# -- outliers ---------------------------------------------------------------------------------

def bounds_sql(column: str, source: str) -> str:
    """SQL with q1 and q3 of a column."""
    return f"SELECT {nearest(column, source, 0.25)} AS q1, {nearest(column, source, 0.75)} AS q3"


def outlier_sql(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count(*) FILTER (x < lo OR x > hi) AS count, "
        f"round(count(*) FILTER (x < lo OR x > hi) / count(*) * 100, 2) AS pct, round(max(lo), 4)::DOUBLE AS lower, "
        f"round(max(hi), 4)::DOUBLE AS upper FROM (SELECT {column} + 0.0 AS x, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi "
        f"FROM {source}, ({bounds_sql(column, source)}) WHERE {column} IS NOT NULL)"
    )


SKEWED_LINEITEM = (
    "(SELECT *, l_extendedprice * l_extendedprice * l_tax AS squared FROM " + GAPPY_LINEITEM + ")"
)
OUTLIER_COLUMNS = ["l_extendedprice", "l_quantity", "squared", "l_suppkey"]


def skewed_lineitem(spark, folder):
    price = F.col("l_extendedprice")
    return gappy_lineitem(spark, folder).withColumn("squared", price * price * F.col("l_tax"))


@query("iqr_outliers", " UNION ALL ".join(outlier_sql(c, SKEWED_LINEITEM) for c in OUTLIER_COLUMNS))
def iqr_outliers(spark, folder):
    return outliers.iqr_outliers(skewed_lineitem(spark, folder), OUTLIER_COLUMNS)


@query("outlier_report",
       "SELECT * FROM (" + " UNION ALL ".join(outlier_sql(c, SKEWED_LINEITEM) for c in OUTLIER_COLUMNS) + ") WHERE count > 0")
def outlier_report(spark, folder):
    return outliers.univariate_report(skewed_lineitem(spark, folder), OUTLIER_COLUMNS)


@query("iqr_outlier_rows", per_column(
    "SELECT event_id, '{c}' AS \"column\", {c} + 0.0 AS value FROM events, (SELECT q1 - 1.5 * (q3 - q1) AS lo, "
    "q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT (SELECT v FROM (SELECT {c} + 0.0 AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, "
    "count(*) OVER () AS n FROM events) WHERE i = floor((n - 1) * 0.25::DOUBLE + 0.5)) AS q1, (SELECT v FROM (SELECT {c} + 0.0 AS v, "
    "row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = floor((n - 1) * 0.75::DOUBLE + 0.5)) AS q3)) "
    "WHERE {c} < lo OR {c} > hi", ["value", "user_id"],
))
def iqr_outlier_rows(spark, folder):
    return outliers.iqr_outlier_rows(table(spark, folder, "events"), ["value", "user_id"], ["event_id"])


@query("isolation_forest")
def isolation_forest(spark, folder):
    return forest.isolation_forest(
        table(spark, folder, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"]
    )


@query("isolation_summary")
def isolation_summary(spark, folder):
    df = table(spark, folder, "events")
    return forest.isolation_summary(df, ["value", "user_id"], ["event_id"])


PLANTED = [(-1, 5_000_000.0, 10), (-2, -4_000_000.0, 900_000_000), (-3, 3_000_000.0, -800_000_000)]


def planted_events(spark, folder):
    """events with three rows that are extreme in value and user."""
    planted = local_table(spark, PLANTED, "event_id long, value double, user_id long")
    return table(spark, folder, "events").select("event_id", "value", "user_id").unionByName(planted)


@query("isolation_forest_facts", "SELECT 3::BIGINT AS planted_found, true AS share_in_bounds, true AS same_for_other_partitions")
def isolation_forest_facts(spark, folder):
    """What a forest must do whatever it draws: find planted rows, flag its share, ignore the partitions."""
    df = planted_events(spark, folder)

    def flagged(parts):
        return forest.isolation_forest(df.repartition(parts, "event_id"), ["value", "user_id"], ["event_id"])

    def facts(found):
        return found.agg(F.count_if(F.col("event_id") < 0).alias("planted"), F.count(F.lit(1)).alias("n"),
                         F.sum(F.xxhash64("event_id", F.round("score", 9)).cast("decimal(38,0)")).alias("mark"))

    one, many = facts(flagged(1)), facts(flagged(8))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    # three tables of one row each
    joined = one.withColumn("k", F.lit(1)).join(many.select(F.col("mark").alias("other"), F.lit(1).alias("k")), "k").join(
        rows.withColumn("k", F.lit(1)), "k"
    )
    return joined.select(
        F.col("planted").alias("planted_found"), (F.col("n") / F.col("rows")).between(0.04, 0.06).alias("share_in_bounds"),
        (F.col("mark") == F.col("other")).alias("same_for_other_partitions"),
    )


@query("isolation_forest_nan",
       "SELECT 0::BIGINT AS without_number, ceil((count(*) FILTER (event_id % 7 <> 0) - 1) / 20.0)::BIGINT AS flagged FROM events")
def isolation_forest_nan(spark, folder):
    """Rows with a NaN take no part; of the others those above the interpolated 95% quantile of scores are flagged."""
    value = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    df = table(spark, folder, "events").withColumn("value", value)
    found = forest.isolation_forest(df, ["value", "user_id"], ["event_id"])
    return found.agg(F.count_if(F.col("event_id") % 7 == 0).alias("without_number"), F.count(F.lit(1)).alias("flagged"))


@query("outliers_all",
       "SELECT 'iqr' AS kind, \"column\", count FROM (" + " UNION ALL ".join(outlier_sql(c, "events") for c in ["value", "user_id"]) +
       ") WHERE count > 0 UNION ALL SELECT 'isolation_forest', 'value,user_id', (SELECT count(*) FROM events) // 20")
def outliers_all(spark, folder):
    """Outliers of single columns, and of all together; the forest flags the twentieth part with the largest scores."""
    return outliers.all_outliers(table(spark, folder, "events"), ["value", "user_id"], ["event_id"])
