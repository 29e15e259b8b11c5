"""Association, statistical tests, outliers and the isolation forest."""

import math
import random
from collections import Counter
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.functions import normal, shapiro
from tabscope.functions.text import number_text
from tabscope.operators import association, forest, inference, ordering, outliers, sampling


def test_normal_tails(spark):
    points = [(x,) for x in (-9.0, -2.5, -0.4, 0.0, 0.3, 0.5, 1.7, 4.5, 12.0, 30.0)]
    df = spark.createDataFrame(points, "x double")
    for r in df.select("x", normal.erfc(F.col("x")).alias("e"), normal.log_upper_tail(F.col("x")).alias("u")).collect():
        assert math.isclose(r["e"], math.erfc(r["x"]), rel_tol=1e-13)
        if r["x"] < 30:
            assert math.isclose(r["u"], math.log(math.erfc(r["x"] / math.sqrt(2)) / 2), rel_tol=1e-12, abs_tol=1e-15)


def test_chi_square_tail(spark):
    # table values at the 5% level, and an exact even case
    cases = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (30.143527, 19, 0.05), (6.0, 4, math.exp(-3) * 4), (0.0, 3, 1.0), (5000.0, 361, 0.0)]
    df = spark.createDataFrame([c[:2] for c in cases], "s double, d int")
    rows = df.select("s", "d", normal.chi_square_upper_tail(F.col("s"), F.col("d")).alias("p")).collect()
    want = {c[:2]: c[2] for c in cases}
    for r in rows:
        assert abs(r["p"] - want[r["s"], r["d"]]) < 1e-6


def test_number_text(spark):
    values = [0.0, 0.05, 0.0001, 0.000123, 0.00002, 1e-06, 123.5, -0.0004, 12345678.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", number_text(F.col("v")).alias("t")).collect():
        assert r["t"] == str(r["v"])


def brute_shapiro(values):
    """W by the published weights, on a sorted list."""
    x, n = np.sort(np.asarray(values, dtype=float)), len(values)
    scores = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    squares, u = scores @ scores, 1 / math.sqrt(n)
    last = scores[-1] / math.sqrt(squares) + 0.221157 * u - 0.147981 * u**2 - 2.07119 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    second = scores[-2] / math.sqrt(squares) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    inner = (squares - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    weights = np.concatenate(([-last, -second], scores[2:-2] / math.sqrt(inner), [second, last]))
    return (weights @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def test_shapiro_published_example(spark):
    # Shapiro and Wilk (1965): weights in pounds of eleven men, W = 0.79
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(float(x), 1.0) for x in men], "x double, same double")
    rows = {r["column"]: r for r in inference.normality_tests(df, ["x", "same"]).collect()}
    assert (round(rows["x"]["statistic"], 4), round(rows["x"]["p_value"], 4)) == (0.7888, 0.0067)
    assert (rows["same"]["statistic"], rows["same"]["p_value"]) == (1.0, 1.0)


@pytest.mark.parametrize(("edge", "counted"), [(32, 100_000), (5, 500)])
def test_normality_of_whole_columns(spark, monkeypatch, edge, counted):
    monkeypatch.setattr(shapiro, "EDGE", edge)
    monkeypatch.setattr(ordering, "COUNTED", counted)
    gauss = random.Random(7)
    rows = [(i, gauss.gauss(0, 1), gauss.random() ** 3, float(i) if i < 7 else None, float(i % 3 == 0) * 4 + i % 5)
            for i in range(6_000)]
    df = spark.createDataFrame(rows, "id int, normal double, skewed double, short double, tied double")
    found = {r["column"]: r for r in inference.normality_tests(df.repartition(5), ["normal", "skewed", "short", "tied"]).collect()}
    assert set(found) == {"normal", "skewed", "tied"} and found["normal"]["sample_size"] == 6000
    assert found["normal"]["is_normal"] and not found["skewed"]["is_normal"]
    for place, name in ((1, "normal"), (2, "skewed"), (4, "tied")):
        assert abs(found[name]["statistic"] - brute_shapiro([r[place] for r in rows])) < 2e-6


def test_sums_of_scores():
    for n in (8, 9, 40, 64, 65, 1_000, 2_500):
        scores = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        assert math.isclose(shapiro.squared_scores(n), sum(z * z for z in scores), rel_tol=1e-10)
        source = random.Random(n)
        spans = [(1, n), (1, 1), (n, n), (3, n - 2)] + [tuple(sorted(source.choices(range(1, n + 1), k=2))) for _ in range(40)]
        first, last = np.array(spans).T
        want = [sum(scores[a - 1 : b]) for a, b in spans]
        assert np.allclose(shapiro.score_sums(first, last, n), want, rtol=0, atol=1e-9)


def test_ranks_of_values(spark):
    source = random.Random(3)
    rows = [(float(source.randrange(40)), source.gauss(0, 1) if i % 5 else None, 7.0 if i % 3 else float("nan")) for i in range(3_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    for splits in ({"a": [3.0, 3.0, 20.0], "b": [-1.0, 0.0], "c": [7.0]}, {"a": None, "b": [9.0], "c": []}):
        found = {(r["column"], str(r["value"])): (r["count"], r["before"]) for r in ordering.ranked_values(df, splits).collect()}
        want = {}
        for i, name in enumerate("abc"):
            values = sorted((r[i] for r in rows if r[i] is not None), key=lambda v: (math.isnan(v), v))
            for at, v in reversed(list(enumerate(values))):
                want[name, str(v)] = (sum(str(x) == str(v) for x in values) if name != "b" else 1, at)
        assert found == want


def test_blocks_of_columns_serve_every_pair_once():
    columns = [f"c{i}" for i in range(17)]
    pairs = list(combinations(columns, 2))
    blocks = association.column_blocks(pairs, dict.fromkeys(columns, 4))
    assert sorted(p for _, own in blocks for p in own) == sorted(pairs)
    assert len(blocks) < len(pairs) / 4 and all(len(b) <= 5 and set(x for p in own for x in p) <= set(b) for b, own in blocks)
    wide = dict.fromkeys(columns, 4) | {"c3": 5_000, "c9": 900}
    blocks = association.column_blocks(pairs, wide)
    assert sorted(p for _, own in blocks for p in own) == sorted(pairs)
    assert all(len(b) == 2 for b, _ in blocks if "c3" in b) and all(math.prod(wide[c] for c in b) <= 4096 for b, _ in blocks if len(b) > 2)
    assert all(len(b) == 2 for b, _ in association.column_blocks(pairs, None))


def test_cells_from_blocks_and_from_pairs(spark, monkeypatch):
    source = random.Random(4)
    columns = [f"x{i}" for i in range(7)]
    rows = [tuple(None if source.random() < 0.1 else source.randrange(2 + i) for i in range(7)) for _ in range(2_000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in columns)).repartition(3)
    pairs = list(combinations(columns, 2)) + [("x1", "x0")]
    want = Counter()
    for r in rows:
        for a, b in pairs:
            x, y = r[columns.index(a)], r[columns.index(b)]
            if x is not None and y is not None:
                want[a, b, str(x), str(y)] += 1
    for most in (4096, 30, 1):
        monkeypatch.setattr(association, "MEASURED_PAIRS", 2)
        monkeypatch.setattr(association.column_blocks, "__defaults__", (most, 5))
        found = {tuple(r)[:4]: r["observed"] for r in association.cell_counts(df, pairs).collect()}
        assert found == dict(want)


def test_dense_table_in_blocks(spark):
    source = random.Random(5)
    rows = [(f"a{source.randrange(300)}", f"b{source.randrange(170)}") for _ in range(900)] + [("a0", "b0")] * 500 + [(None, "b1"), ("only", None)]
    df = spark.createDataFrame(rows, "p string, q string").repartition(3)
    counts = Counter(r for r in rows if None not in r)
    by_row, by_col = Counter(r[0] for r in rows if None not in r), Counter(r[1] for r in rows if None not in r)
    for levels in (1000, 40):
        cells = association.dense_cells(df, "p", "q", levels)
        found = {(r["a"], r["b"]): tuple(r)[2:] for r in cells.collect()}
        assert len(found) == cells.count() == len(by_row) * len(by_col)
        for (a, b), (observed, row_total, col_total) in found.items():
            assert observed == counts[a, b]
            assert (row_total, col_total) == (by_row[a], by_col[b])
    plan = cells._jdf.queryExecution().toString()
    assert not any(node in plan for node in ("NestedLoop", "Cartesian", "SinglePartition"))


def test_normal_quantiles():
    points = [1e-300, 1e-13, 1e-5, 0.01, 0.2, 0.5, 0.7, 0.999, 1 - 1e-9]
    for p, z in zip(points, normal.normal_quantiles(np.array(points)), strict=True):
        assert math.isclose(z, NormalDist().inv_cdf(p), rel_tol=1e-12, abs_tol=1e-15)


def test_samples_are_whole_and_stable(spark):
    df = spark.range(50_000).toDF("id")
    one = {r["id"] for r in sampling.sample(df.coalesce(1), 500, ["id"]).collect()}
    many = {r["id"] for r in sampling.sample(df.repartition(9), 500, ["id"]).collect()}
    assert one == many and len(one) == 500
    assert abs(sum(one) / 500 - 25_000) < 3_000


def brute_chi(table, correct):
    table = np.array(table, dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    gap = np.abs(table - expected)
    if correct and table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return (gap**2 / expected).sum()


def test_chi_square_and_cramers_v(spark):
    table = [[12, 5], [3, 20]]
    rows = [(f"r{i}", f"c{j}") for i in range(2) for j in range(2) for _ in range(table[i][j])] + [("r0", None), (None, "c1")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("one", F.lit("x"))
    tests = inference.chi_square_tests(df, ["a", "b", "one"]).collect()
    (r,) = [t for t in tests if t["skipped"] is None]
    assert [t["skipped"] for t in tests if t["skipped"]] == ["a column has one value"] * 2
    assert (r["col1"], r["col2"], r["dof"]) == ("a", "b", 1)
    assert r["statistic"] == round(brute_chi(table, True), 4) and r["significant"]
    v = {(x["col1"], x["col2"]): x["cramers_v"] for x in association.cramers_v(df, [("a", "b"), ("a", "one")]).collect()}
    assert v == {("a", "b"): round(math.sqrt(brute_chi(table, False) / 40), 4), ("a", "one"): 0.0}


def test_perfect_and_absent_association(spark):
    df = spark.range(120).select(
        (F.col("id") % 4).alias("x"), (F.col("id") % 4 * 10).alias("same"), (F.col("id") % 3).alias("other")
    )
    rows = association.categorical_associations(df, ["x", "same", "other"]).collect()
    assert [(r["col1"], r["col2"], r["cramers_v"]) for r in rows] == [("x", "same", 1.0)]
    assert association.categorical_associations(df, ["x"]).count() == 0


def test_contingency_has_empty_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", None)], "p string, q string")
    cells = {(r["a"], r["b"]): r["observed"] for r in association.contingency(df, "p", "q").collect()}
    assert cells == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1}
    expected = {(r["a"], r["b"]): r["expected"] for r in association.contingency_expected(df, "p", "q").collect()}
    assert math.isclose(expected["a", "x"], 4 / 3)


def test_correlation_edges(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 5, 1.0, None), (2, 4.0, 5, float("nan"), 3), (3, 6.0, 5, 3.0, None), (None, 8.0, 5, 4.0, 4)],
        "a int, b double, const int, nan double, gaps int",
    )
    r = {(x["col1"], x["col2"]): x["correlation"] for x in association.pearson_matrix(df, df.columns).collect()}
    assert ("const", "a") not in r and r["a", "nan"] == 0.0 and r["nan", "nan"] == 0.0
    # the mean of 1, 2, 3 fills the gap in a; the mean 3.5 of gaps is truncated to 3
    assert r["a", "b"] == round(np.corrcoef([1, 2, 3, 2], [2, 4, 6, 8])[0, 1], 4)
    assert r["a", "gaps"] == round(np.corrcoef([1, 2, 3, 2], [3, 3, 3, 4])[0, 1], 4)
    full = association.pearson_matrix(df, ["a", "const"], drop_constant=False)
    assert full.count() == 4
    assert association.pearson_matrix(df, ["a"]).count() == 0
    assert association.nonconstant_columns(df, ["a", "const", "nan"]).count() == 2


def anderson(values):
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    z = (x - x.mean()) / x.std(ddof=1)
    low = np.array([math.log(math.erfc(-v / math.sqrt(2)) / 2) for v in z])
    high = np.array([math.log(math.erfc(v / math.sqrt(2)) / 2) for v in z])
    i = np.arange(1, n + 1)
    return -n - ((2 * i - 1) * (low + high[::-1])).sum() / n


def test_anderson_darling_with_ties(spark):
    source = random.Random(3)
    values = [round(source.gauss(10, 2), 1) for _ in range(400)] + [10.0] * 200
    df = spark.createDataFrame([(v, v if i < 10 else None) for i, v in enumerate(values)], "x double, few double")
    (r,) = inference.distribution_tests(df, ["x", "few"]).collect()
    assert r["column"] == "x" and abs(r["statistic"] - anderson(values)) < 1e-4
    assert r["critical_5pct"] == round(0.787 / (1 + 4 / 600 - 25 / 600**2), 3)


def test_constant_columns_are_left_out(spark):
    df = spark.range(20).select(F.lit(5.0).alias("same"), F.col("id").cast("double").alias("x"))
    assert [r["column"] for r in inference.distribution_tests(df, ["same", "x"]).collect()] == ["x"]


def test_all_columns_are_paired(spark):
    names = [f"c{i}" for i in range(17)]
    df = spark.range(300).select(*[(F.col("id") * (i + 1) % 4).cast("string").alias(c) for i, c in enumerate(names)])
    assert inference.chi_square_tests(df, names).count() == 136
    numbers = df.select(*[F.col(c).cast("double") for c in names])
    assert inference.distribution_tests(numbers, names).count() == sum((i + 1) % 4 > 0 for i in range(17))
    rows = {(r["col1"], r["col2"]): r["correlation"] for r in association.pearson_matrix(numbers, names).collect()}
    data = numbers.toPandas()
    for (a, b), r in rows.items():
        assert r == round(np.corrcoef(data[a], data[b])[0, 1], 4)


def test_interpretations_and_takeaways(spark):
    normality = spark.createDataFrame(
        [("age", "shapiro_wilk", 0.9, 0.03, False, 0.5)], "column string, test string, statistic double, p_value double, is_normal boolean, skewness double"
    )
    chi = spark.createDataFrame(
        [("a", "b", "chi_square", 9.0, 0.01, 1, True, None)], inference.CHI_SCHEMA
    )
    rows = inference.interpretations(normality, chi).collect()
    assert [r["significance"] for r in rows] == ["significant", "significant"]
    assert rows[0]["result_summary"] == "Not normally distributed (p=0.03). Skewness: 0.5."
    lines = [r["takeaway"] for r in inference.takeaways(normality, chi).orderBy("place").collect()]
    assert lines == ["0/1 numeric columns follow a normal distribution.", "1 significant categorical relationships found."]
    assert inference.takeaways(normality.limit(0), chi.limit(0)).count() == 0


def test_iqr_outliers(spark):
    df = spark.createDataFrame([(i, float(v), None if i > 2 else 1.0) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 100])],
                               "id int, x double, few double")
    rows = {r["column"]: r for r in outliers.iqr_outliers(df, ["x", "few"]).collect()}
    assert (rows["x"]["count"], rows["x"]["pct"], rows["x"]["lower"], rows["x"]["upper"]) == (1, 11.11, -3.0, 13.0)
    assert rows["few"]["count"] == 0 and rows["few"]["lower"] is None
    (flagged,) = outliers.iqr_outlier_rows(df, ["x", "few"], ["id"]).collect()
    assert (flagged["id"], flagged["column"], flagged["value"]) == (8, "x", 100.0)


@pytest.fixture(scope="module")
def cloud(spark):
    source = random.Random(11)
    rows = [(i, source.gauss(0, 1), source.gauss(5, 2)) for i in range(2_000)]
    rows += [(9_000, 40.0, 5.0), (9_001, 0.0, -70.0), (9_002, 30.0, 60.0), (9_003, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "id int, x double, y double")


def test_forest_flags_planted_rows(cloud):
    found = forest.isolation_forest(cloud, ["x", "y"], ["id"])
    rows = found.orderBy(F.desc("score")).collect()
    # a row that is extreme in one column only, and in few samples, scores like the rim of the cloud
    assert rows[0]["id"] == 9_002 and {9_000, 9_001} <= {r["id"] for r in rows}
    assert 95 <= len(rows) <= 105
    again = forest.isolation_forest(cloud.repartition(7), ["x", "y"], ["id"]).orderBy(F.desc("score")).collect()
    assert [(r["id"], r["score"]) for r in rows] == [(r["id"], r["score"]) for r in again]


def test_forest_limits(spark, cloud):
    row = forest.isolation_summary(cloud, ["x"], ["id"]).first()
    assert row["count"] == 0 and "at least 2" in row["note"]
    few = forest.isolation_summary(cloud.limit(5), ["x", "y"], ["id"]).first()
    assert few["count"] == 0 and few["note"] == "not enough valid rows"
    full = forest.isolation_summary(cloud, ["x", "y"], ["id"]).first()
    assert 4.5 < full["pct"] < 5.5
