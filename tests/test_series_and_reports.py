"""Time series, findings, charts, documents, vectors, SQL text, as-of join, whole analysis."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import charts, contexts, documents, findings, frequency, ordering, pivots, profile, series, sqltext, vectors
from tabscope.operators.asof import asof_join
from tabscope.operators.intervals import interval_join
from tabscope.plans.analyze import analyze


def test_order_with_a_hot_time(spark):
    # a third of the rows share one time: ties are ordered by the values, over several partitions
    rows = [(1_000 if i % 3 == 0 else i, float(i % 701), None if i % 4 == 0 else i * 0.5) for i in range(3_000)]
    df = spark.createDataFrame(rows, "t int, x double, y double").repartition(6)
    found = {r["column"]: r for r in ordering.in_row_order(df, {"x": 350.0, "y": 0.0}, ["t"], 3).collect()}
    for place, name, mean in ((1, "x", 350.0), (2, "y", 0.0)):
        ordered = sorted(rows, key=lambda r: (r[0], r[1], -1.0 if r[2] is None else r[2]))
        d = np.array([r[place] for r in ordered if r[place] is not None]) - mean
        assert math.isclose(found[name]["slope"], np.polyfit(np.arange(len(d)), d, 1)[0], rel_tol=1e-9)
        assert found[name]["pairs"] == [len(d) - lag for lag in (1, 2, 3)]
        assert np.allclose(found[name]["totals"], [d[:-lag] @ d[lag:] for lag in (1, 2, 3)], rtol=1e-9)


def test_summaries_of_parts_make_the_whole():
    source = np.random.default_rng(2)
    values = source.normal(size=400)
    values[[3, 50, 51, 399]] = np.nan
    whole = ordering.Neighbours(12)
    whole.add(values)
    for sizes in ([400], [1, 2, 3, 5, 8, 381], [390, 10], [7] * 57 + [1]):
        found, at = ordering.Neighbours(12), 0
        for size in sizes:
            part = ordering.Neighbours(12)
            for piece in np.array_split(values[at : at + size], 3):
                part.add(piece)
            found.follow(part)
            at += size
        assert (found.n, found.known) == (400, 396) and np.array_equal(found.pairs, whole.pairs)
        assert np.allclose(found.totals, whole.totals) and math.isclose(found.shared / found.spread, whole.shared / whole.spread)


def lagged(values, lag):
    x = np.asarray(values, dtype=float)
    return np.nanmean((x[:-lag] - np.nanmean(x)) * (x[lag:] - np.nanmean(x))) / np.nanvar(x)


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_autocorrelation_across_partitions(spark, settings, parts):
    settings({"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    source = random.Random(5)
    values = [math.sin(i * math.pi / 6) * 3 + source.random() for i in range(700)]
    values[100] = float("nan")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "t int, x double").repartition(5)
    rows = series.autocorrelation(df, ["x"], ["t"]).collect()
    assert len(rows) == 50
    for r in rows:
        assert math.isclose(r["autocorrelation"], lagged(values, r["lag"]), rel_tol=1e-9, abs_tol=1e-12)
    season = series.seasonality(df, ["x"], ["t"]).first()
    by_lag = {lag: lagged(values, lag) for lag in range(1, 51)}
    peaks = [lag for lag in range(2, 50) if by_lag[lag] > max(by_lag[lag - 1], by_lag[lag + 1], 0.3)]
    best = max(peaks, key=lambda lag: round(by_lag[lag], 4))
    assert (season["detected"], season["period"]) == (True, best) and best % 12 == 0


def test_short_and_flat_series(spark):
    df = spark.range(30).select("id", F.lit(2.0).alias("flat"), F.col("id").cast("double").alias("up"))
    assert series.autocorrelation(df, ["flat"], ["id"]).count() == 0
    assert series.autocorrelation(df, ["up"], ["id"]).agg(F.max("lag")).first()[0] == 7
    rows = {r["column"]: r for r in series.trend(df, ["flat", "up"], ["id"]).collect()}
    assert rows["up"]["direction"] == "increasing" and rows["up"]["slope"] == 1.0
    assert rows["flat"]["direction"] == "stable"
    assert series.trend(df.limit(4), ["up"], ["id"]).first()["direction"] == "none"


def test_trend_in_time_order(spark):
    source = random.Random(9)
    values = [100 + 0.8 * i + source.uniform(-3, 3) for i in range(50)]
    rows = [(f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", i, v) for i, v in enumerate(values)]
    source.shuffle(rows)
    row = series.trend(spark.createDataFrame(rows, "day string, id int, x double"), ["x"], ["day", "id"]).first()
    slope = np.polyfit(np.arange(50), values, 1)[0]
    assert row["direction"] == "increasing" and abs(row["slope"] - slope) < 1e-6
    assert abs(row["normalized_slope"] - slope / np.mean(values)) < 1e-6


def test_date_formats(spark):
    df = spark.createDataFrame([("03/04/2024", "x"), ("12/31/2023", "2024-01-01"), (None, "y")], "us string, no string")
    assert series.choose_date_format(df.limit(2), "us") == "MM/dd/yyyy"
    assert series.choose_date_format(df, "no") is None
    assert str(series.parse_dates(df.limit(2), "us").orderBy("us").first()["us"]) == "2023-12-31"


def test_findings(spark):
    df = spark.createDataFrame([(1 if i < 2 else None, i) for i in range(10)], "a int, b int")
    (row,) = findings.missing_findings(frequency.null_counts(df)).collect()
    assert row["title"] == "High missing rate in 'a'" and row["severity"] == "high"
    assert row["description"] == "80.0% of values are missing." and row["affected_columns"] == ["a"]
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "a int, b string")
    (row,) = findings.duplicate_findings(frequency.duplicate_rows(twice)).collect()
    assert row["severity"] == "medium" and row["description"] == "2 duplicate rows found."
    assert findings.duplicate_findings(frequency.duplicate_rows(twice.distinct())).count() == 0


@pytest.mark.parametrize(("complete", "dupes", "columns", "score"), [
    (100.0, 0, 0, 100), (80.5, 0, 0, 80), (81.5, 0, 0, 82), (100.0, 90, 9, 65), (10.0, 90, 9, 0),
])
def test_quality_score(spark, complete, dupes, columns, score):
    dataset = spark.createDataFrame([(100, complete, dupes)], "rows long, completeness_pct double, duplicate_rows long")
    outliers = spark.createDataFrame([(f"c{i}", 1) for i in range(columns)], "column string, count long")
    row = findings.quality_score(dataset, outliers).first()
    assert row["quality_score"] == score
    assert row["band"] == ("high" if score >= 70 else "mid" if score >= 40 else "low")


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,), (float("nan"),)], "x double")
    rows = charts.histogram(df, "x").orderBy("bin").collect()
    assert len(rows) == 50 and sum(r["count"] for r in rows) == 101 and rows[-1]["count"] == 3
    flat = charts.histogram(df.select(F.lit(1.0).alias("x")), "x").where("count > 0").collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(0, 103)]
    assert charts.histogram(df.where("x is null"), "x").count() == 0


def test_charts(spark):
    df = spark.range(8_000).select(
        "id", (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") * 3.0).alias("y"),
        F.when(F.col("id") % 9 > 0, (F.col("id") % 3).cast("string")).alias("c"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("t"),
    )
    assert charts.scatter(df, "x", "y", ["id"]).count() == 4_000
    assert charts.scatter(df, "x", "id", ["id"]).count() == 8_000
    assert charts.scatter(df, "x", "id", ["id"], sample_size=500).count() == 500
    assert charts.binned_scatter(df, "x", "y").agg(F.sum("count")).first()[0] == 4_000
    shares = charts.pie(df, "c").collect()
    assert len(shares) == 4 and abs(sum(r["share"] for r in shares) - 1) < 1e-5
    assert charts.bar(df, "x").count() == 20
    assert charts.line(df, "t", "y", every="DAY").count() == 334
    every = charts.line(df, "t", "y", pixels=None).collect()
    drawn = charts.line(df, "t", "y", pixels=25).collect()
    assert len(every) == 4_000 and len(drawn) <= 100 and {tuple(r) for r in drawn} <= {tuple(r) for r in every}
    assert {drawn[0], drawn[-1], max(drawn, key=lambda r: r["value"])} <= {every[0], every[-1], max(every, key=lambda r: r["value"])}
    assert charts.line(df.where("id < 0"), "t", "y").count() == 0 and charts.line(df.where("id < 3"), "id", "x", pixels=1).count() == 2
    plan = charts.chart_plan(profile.column_types(df), spark.createDataFrame(
        [("x", "y", 0.99)], "col1 string, col2 string, correlation double"))
    kinds = [r["chart_type"] for r in plan.orderBy("place").collect()]
    assert kinds == ["histogram"] * 3 + ["box", "bar", "scatter", "heatmap", "line", "line"]
    data = charts.chart_data(df, plan, ["id"])
    assert len(data) == 9 and data["x vs y (r=0.99)"].count() == 4_000
    odd = spark.createDataFrame(
        [(0, "pie", ["c"], "p", ""), (1, "radar", ["x"], "r", ""), (2, "bar", ["gone"], "g", "")], plan.schema)
    assert set(charts.chart_data(df, odd, ["id"])) == {"p"}


def test_split_sections(spark):
    cases = [
        ("Executive Summary\nGood.\n\nData Quality Assessment\nFine.\nKey Findings\nA\nB\nRecommendations\nDo it.",
         {"executive_summary": "Good.", "data_quality": "Fine.", "key_findings": "A\nB", "recommendations": "Do it."}),
        ("no header at all", {"introduction": "no header at all"}),
        ("", {"introduction": ""}),
        ("a line that mentions recommendations but is far too long to be a header line\nRECOMMENDATIONS:\n x ",
         {"introduction": "a line that mentions recommendations but is far too long to be a header line", "recommendations": "x"}),
        ("Key Findings\nold\nKey Findings\nnew", {"key_findings": "new"}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    found: dict = {i: {} for i in range(len(cases))}
    for r in documents.split_sections(df, "id", "t").collect():
        assert r["section"] not in found[r["id"]]
        found[r["id"]][r["section"]] = r["body"]
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_extract_json(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', ' [1, 2] ': "[1, 2]", "12": "12", "```json\n{\"a\": 2}\n```": '{"a": 2}',
        'so: {"a": {"b": 3}} ok': '{"a": {"b": 3}}', '{"a": 1} and {"b": 2}': None, "nothing": None, "": None,
        '{"a": 1} tail': '{"a": 1}', "1] [2": None, '1, "w": 2': None, '{"a":': None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in documents.extract_json(df, "t").collect():
        assert r["json"] == cases[r["t"]] and r["parse_error"] == (cases[r["t"]] is None), r


def test_vectors(spark):
    source = random.Random(1)
    rows = [(f"v{i}", f"doc {i}", {"upload": str(i % 2)}, [source.random() - 0.5 for _ in range(8)]) for i in range(60)]
    store = spark.createDataFrame(rows, "id string, doc string, metadata map<string,string>, embedding array<float>")
    question = rows[4][3]

    def distance(v):
        a, b = np.asarray(v, dtype=np.float32).astype(float), np.asarray(question)
        return 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    want = sorted((distance(r[3]), r[0]) for r in rows if r[2]["upload"] == "0")[:5]
    found = vectors.nearest(store, question, F.col("metadata")["upload"] == "0").orderBy("distance", "id").collect()
    assert [r["id"] for r in found] == [w[1] for w in want] and found[0]["id"] == "v4"
    new = spark.createDataFrame([("v1", "changed", {"upload": "1"}, [0.0] * 8), ("n", "new", {"upload": "1"}, [1.0] * 8)], store.schema)
    merged = {r["id"]: r["doc"] for r in vectors.upsert(store, new).collect()}
    assert len(merged) == 61 and merged["v1"] == "changed" and merged["n"] == "new"
    left = vectors.delete_where(store, F.col("metadata")["upload"] == "1")
    assert left.count() == 30
    assert vectors.delete_where(store, F.col("metadata")["none"] == "1").count() == 60
    questions = store.where("id in ('v4', 'v5')").select(
        F.col("id").alias("q"), F.col("embedding").alias("question_vector"), F.col("metadata")["upload"].alias("u"))
    each = vectors.nearest_each(store.withColumn("u", F.col("metadata")["upload"]), questions, ["u"], "q").collect()
    assert len(each) == 10 and {r["id"] for r in each if r["q"] == "v4"} == {w[1] for w in want}


def test_zero_vectors_come_last(spark):
    store = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    rows = vectors.nearest(store, [1.0, 0.1], k=3).collect()
    assert [r["id"] for r in rows] == ["b", "c", "a"] and rows[2]["distance"] is None


def test_safe_select(spark, small):
    df = spark.range(50).toDF("n")
    assert sqltext.safe_select(df, "```sql\nselect n from data order by n desc\n```").collect()[0]["n"] == 49
    assert sqltext.safe_select(df, "SELECT * FROM data;").count() == 50
    assert sqltext.safe_select(df, "SELECT * FROM data", limit=20).count() == 20
    assert sqltext.safe_select(df, "SELECT 'using \"x\"' AS s FROM data").first()["s"] == 'using "x"'
    assert sqltext.safe_select(df, "SELECT n FROM `data`").count() == 50
    spark.range(3).createOrReplaceTempView("data")
    assert sqltext.safe_select(df, "SELECT n FROM data").count() == 50 and spark.table("data").count() == 3
    spark.catalog.dropTempView("data")
    assert sqltext.safe_select(df, "WITH t AS (SELECT count(*) AS c FROM data) SELECT c FROM t -- end").first()["c"] == 50
    for refused in (
        "DROP VIEW data", "INSERT INTO data VALUES (1)", "select 1; select 2", "select none from data", "",
        "WITH t AS (SELECT 1) INSERT INTO data SELECT * FROM t", "select 1) x; drop view data; --",
        "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT TRANSFORM(n) USING 'cat' FROM data", "describe data",
        f"SELECT * FROM parquet.`{small}/nation.parquet` WHERE true",
    ):
        assert sqltext.safe_select(df, refused) is None, refused
    joined = sqltext.safe_select(df, "SELECT count(*) AS c FROM data JOIN other USING (n)", views={"other": df.limit(3)})
    assert joined.first()["c"] == 3


def test_newer_than(spark):
    df = spark.range(100).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("t"))
    assert sqltext.newer_than(df, "t").count() == 25
    assert sqltext.newer_than(df.limit(0), "t").count() == 0


def test_asof_join_with_a_hot_key(spark):
    source = random.Random(2)

    def rows(n, first):
        return [(first + i, 0 if source.random() < 0.4 else source.randrange(1, 40), source.randrange(2_000)) for i in range(n)]

    lefts, rights = rows(3_000, 0) + [(9_999, None, 5)], rows(800, 10_000)
    left = spark.createDataFrame(lefts, "id int, k int, t int").repartition(5)
    right = spark.createDataFrame(rights, "rid int, k int, rt int").repartition(3)
    got = {r["id"]: (r["rt"], r["rid"]) for r in asof_join(left, right, "k", "t", "rt", ["rt", "rid"], "left").collect()}
    assert len(got) == 3_001
    for i, k, t in lefts:
        best = max(((rt, rid) for rid, rk, rt in rights if rk == k and rt <= t), default=(None, None))
        assert got[i] == best
    inner = asof_join(left, right, "k", "t", "rt", ["rt", "rid"])
    assert inner.count() == sum(1 for v in got.values() if v[0] is not None)


def test_whole_analysis(spark):
    source = random.Random(4)
    rows = [
        (i, ["pen", "ink"][i % 2], price := round(source.uniform(5, 20), 2), round(price * 3, 2), 7.0,
         f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", None if i == 5 else f"u{i % 30}")
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "order_id int, product string, price double, total double, flat double, day string, who string")
    results = analyze(df, ["order_id"], dataset_id="sales", file_name="sales.csv")
    docs = {r["id"]: r["doc"] for r in results["summary_documents"].collect()}
    assert set(docs) == {"sales_schema", "sales_profile", "sales_samples"}
    assert docs["sales_schema"].startswith("Dataset: sales.csv\nShape: 60 rows x 7 columns\nColumns:\nColumn 'order_id': type=numeric")
    assert "Column 'who': type=categorical, dtype=string, 31 unique values" in docs["sales_schema"]
    assert docs["sales_profile"].startswith("Data quality: 99.76% complete, 1 total nulls, 0 duplicate rows.")
    assert docs["sales_samples"].count("\nRow ") == 5
    by_section: dict = {}
    for r in results["report"].orderBy("section", "line_no").collect():
        by_section.setdefault(r["section"], []).append(r["text"])
    assert "60 rows and 7 columns" in by_section["executive_summary"][0]
    assert by_section["patterns"] == ["- Strong correlation between price and total (r=1.0)"]
    assert {r["column"]: r["time_column"] for r in results["timeseries"].collect()}["total"] == "day"
    assert {r["column"] for r in results["distributions"].collect()} == {"order_id", "price", "total"}
    for name, table in results.items():
        assert table.count() >= 0, name
    context = contexts.report_context(
        *(results[r] for r in ("dataset", "findings", "quality_score", "takeaways", "interpretations", "correlations", "timeseries"))
    ).orderBy("part", "place").collect()
    texts = [r["text"] for r in context]
    assert texts[:2] == ["DATASET OVERVIEW", "Rows: 60, Columns: 7"] and texts[-1].startswith("Quality score: ")
    assert "HIGH CORRELATIONS" in texts and "- price <-> total: r=1.0" in texts and "TIME SERIES PATTERNS" in texts
    quality = contexts.quality_context(*(results[r] for r in ("columns", "dataset", "outliers", "multivariate_outliers")))
    lines = [r["text"] for r in quality.orderBy("part", "place").collect()]
    assert lines[0] == "Dataset: 60 rows, 7 columns" and any(x.startswith("- price (numeric): 0.0% null, ") for x in lines)


def test_analysis_without_numbers_or_times(spark):
    df = spark.createDataFrame([(f"w{i % 3}", f"z{i % 2}") for i in range(40)], "a string, b string")
    results = analyze(df)
    assert results["timeseries"].first()["note"] == "no time columns"
    assert results["outliers"].count() == 0 and results["normality"].count() == 0
    assert results["chi_square"].count() == 1
    assert {r["title"] for r in results["findings"].collect()} == {"Duplicate rows detected"}
    assert results["quality_score"].first()["quality_score"] == 80


def test_interval_join_of_all_lengths(spark):
    source, inf, nan = random.Random(6), math.inf, math.nan
    points = [source.uniform(-50, 50) for _ in range(300)] + [7.0] * 100 + [0.0, -inf, inf, nan, None, 1e300, -1e-300, 4.0]
    spans = [(x, x + 10 ** source.uniform(-6, 3)) for x in (source.uniform(-60, 60) for _ in range(60))]
    spans += [(-inf, inf), (-inf, 0.0), (4.0, inf), (5.0, 5.0), (6.0, 2.0), (nan, 1.0), (None, 1.0), (0.0, nan), (1e15, 1e15 + 0.25), (-1e300, 1e300), (0.0, 4.0)]
    left = spark.createDataFrame(list(enumerate(points)), "p long, x double").repartition(3)
    right = spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "s long, low double, high double")
    found = {(r["p"], r["s"]) for r in interval_join(left, right, "x", "low", "high").collect()}
    want = {(i, j) for i, x in enumerate(points) for j, (a, b) in enumerate(spans) if None not in (x, a, b) and a <= x < b}
    assert found == want
    assert interval_join(left, right.where("false"), "x", "low", "high").count() == 0
    assert interval_join(left, right.where("s = 60"), "x", "low", "high").count() == sum(x is not None and -inf <= x < inf for x in points)


@pytest.mark.parametrize("on", [[], ["kind"]])
def test_pivots_give_the_same_neighbours(spark, on):
    source = np.random.default_rng(3)
    centres = source.normal(size=(12, 16))
    near = [(i, int(i % 3 > 0), (centres[i % 12] + 0.05 * source.normal(size=16)).tolist()) for i in range(1500)]
    # a third of the rows are the same vector; some have no direction; one is far from all
    rows = near + [(2000 + i, 1, near[5][2]) for i in range(750)] + [(3000, 1, [0.0] * 16), (3001, 0, None), (3002, 0, [-1.0] * 16)]
    store = spark.createDataFrame(rows, "id long, kind int, embedding array<double>").repartition(6)
    questions = store.where("id % 50 = 0 or id > 3000").selectExpr("id as q", "kind", "embedding as question_vector")
    chosen = pivots.choose_pivots(store)
    blocked = pivots.pivot_blocks(store, chosen, on, block_rows=100)
    assert blocked.count() == len(rows)
    found = pivots.nearest_by_pivots(blocked, chosen, questions, on, "q", k=7).collect()
    asked = questions if on else questions.drop("kind")
    want = vectors.nearest_each(
        store.withColumn("all", F.lit(1)), asked.withColumn("all", F.lit(1)), [*on, "all"], "q", k=7
    ).collect()
    columns = ["q", "rank", "id", "distance"]
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(tuple(r[c] for c in columns) for r in want)
    directed = {r["q"]: r["n_compared"] for r in found if r["distance"] is not None}
    assert sum(directed.values()) < 0.45 * len(directed) * len(rows)


def test_pivots_of_few_rows(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "q long, question_vector array<double>")
    for rows, ids in ([], []), ([(1, [0.0, 0.0])], [1]), ([(1, [0.0, 0.0]), (2, [0.0, 1.0])], [2, 1]):
        store = spark.createDataFrame(rows, empty.schema)
        chosen = pivots.choose_pivots(store)
        found = pivots.nearest_by_pivots(pivots.pivot_blocks(store, chosen), chosen, questions, [], "q").orderBy("rank")
        assert [r["id"] for r in found.collect()] == ids


@pytest.mark.parametrize("on", [[], ["kind"]])
def test_pivots_in_many_parts_and_chunks(spark, on, monkeypatch):
    """Pairs of questions and blocks stay inside tasks; ties, rows without direction and repeated questions are as in ``nearest_each``."""
    for name, value in (("NUMBERS", 800), ("ASKED", 7), ("MEASURED", 11)):
        monkeypatch.setattr(pivots, name, value)
    source = np.random.default_rng(5)
    draws = [(i, i % 2, source.normal(size=8).tolist()) for i in range(500)]
    copies = [(1000 + i, i % 2, [c * 2.0**-i for c in draws[3][2]] if i < 9 else draws[4][2]) for i in range(90)]
    odd = [(None, 0, draws[7][2]), (8, 1, draws[9][2]), (2000, 0, [0.0] * 8), (2001, 1, None), (2002, 0, None),
           (2003, 0, [1.0] * 7 + [math.nan]), (2004, None, [1.0] * 8), (2005, 1, [0.0] * 8)]
    store = spark.createDataFrame(draws + copies + odd, "id long, kind int, embedding array<double>").repartition(3)
    questions = store.where("id % 25 = 0 or id >= 2000 or id in (3, 4, 8)").selectExpr("id as q", "kind", "embedding as question_vector")
    questions = questions.unionByName(questions.where("q in (3, 4, 2001)"))
    chosen = pivots.choose_pivots(store, pivots=4)
    blocked = pivots.pivot_blocks(store, chosen, on, block_rows=16)
    asked = questions if on else questions.drop("kind")
    found = pivots.nearest_by_pivots(blocked, chosen, asked, on, "q", k=6)
    want = vectors.nearest_each(store.withColumn("all", F.lit(1)), asked.withColumn("all", F.lit(1)), [*on, "all"], "q", k=6).collect()
    assert sorted(str(r[:4]) for r in map(tuple, found.collect())) == sorted(str(tuple(r)) for r in want)
    assert len(want) == 6 * questions.select("q").where("q <> 2004" if on else "true").distinct().count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 2
