"""Typing and profiling."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabscope.operators import frequency, outliers, profile, quantiles
from tabscope.operators.association import high_correlations


def classes(df, **options):
    rows = profile.column_types(df, profile.Options(**options)).collect()
    return {r["column"]: r["detected_type"] for r in rows}


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (i, f"Name{i}", None if i == 3 else 20 + i, None if i == 6 else 50000 + i * 1000, ["Eng", "Ops"][i % 2],
         None if i == 8 else f"n{i}@example.com", f"2020-01-{i + 10}")
        for i in range(1, 11)
    ]
    return spark.createDataFrame(
        rows, "id int, name string, age int, salary int, department string, email string, hire_date string"
    )


def test_small_table(people):
    assert classes(people) == {
        "id": "numeric", "name": "categorical", "age": "numeric", "salary": "numeric",
        "department": "categorical", "email": "categorical", "hire_date": "datetime",
    }
    row = profile.profile_dataset(people).first()
    assert (row["rows"], row["columns"], row["total_nulls"], row["completeness_pct"]) == (10, 7, 3, 95.71)
    assert row["duplicate_rows"] == 0
    kinds = ("numeric_columns", "categorical_columns", "datetime_columns", "text_columns")
    assert sum(row[k] for k in kinds) == 7


def test_class_limits(spark):
    df = spark.range(100).select(
        F.col("id").alias("i"), (F.col("id") % 5).alias("five"), (F.col("id") % 4).alias("four"),
        F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 2 == 0).alias("flag"),
        F.col("id").cast("decimal(10,2)").alias("dec"), F.array("id").alias("list"),
        F.create_map(F.lit("k"), F.col("id")).alias("map"), F.lit(None).cast("int").alias("void"),
        F.lit(None).cast("string").alias("blank"), F.current_date().alias("day"),
    )
    assert classes(df) == {
        "i": "numeric", "five": "numeric", "four": "categorical", "text": "text", "flag": "categorical",
        "dec": "text", "list": "text", "map": "text", "void": "categorical", "blank": "categorical", "day": "datetime",
    }
    assert classes(df, decimal_as_numeric=True)["dec"] == "numeric"


def test_dates_need_more_than_four_fifths(spark):
    def share(n):
        rows = [(i, "2024-01-05 x" if i < n else f"word{i}") for i in range(100)]
        return spark.createDataFrame(rows, "i int, s string")

    assert classes(share(81))["s"] == "datetime"
    assert classes(share(80))["s"] == "categorical"
    assert classes(share(20), date_sample=20, order_by=("i",))["s"] == "datetime"
    assert classes(share(81), date_sample=20, order_by=("s",))["s"] == "datetime"


def test_numeric_profile(spark):
    df = spark.createDataFrame([(10,), (None,), (30,), (None,), (50,)], "x int")
    row = profile.numeric_profile(df, ["x"]).first()
    assert (row["mean"], row["median"], row["min"], row["max"], row["q25"], row["q75"]) == (30, 30, 10, 50, 30, 50)
    empty = profile.numeric_profile(df.where("x is null"), ["x"]).first()
    assert all(empty[c] is None for c in ("mean", "median", "std", "min", "max", "q25", "q75"))
    one = profile.numeric_profile(df.where("x = 30"), ["x"]).first()
    assert one["std"] is None and one["mean"] == 30


def test_value_counts_with_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("a",), ("b",), (None,)], "s string")
    top = frequency.top_values(df, k=10).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 3), ("b", 2), ("c", 1), ("None", 1)]
    assert frequency.n_unique(df).first()["n_unique"] == 4
    assert frequency.approximate_n_unique(df).first()["n_unique"] == 4


def test_values_are_shown_as_written(spark):
    df = spark.sql(
        "select * from values (true, date'2024-02-03', timestamp'2024-02-03 04:05:06.5', "
        "timestamp_ntz'1969-12-31 23:59:59.25', cast(1.1 as float), map('b', 1, 'a', 2)) t(a, b, c, d, e, f)"
    )
    shown = {r["column"]: r["value"] for r in frequency.value_counts(df).collect()}
    assert shown == {
        "a": "true", "b": "2024-02-03", "c": "2024-02-03 04:05:06.5", "d": "1969-12-31 23:59:59.25", "e": "1.1",
        "f": '[{"key":"a","value":2},{"key":"b","value":1}]',
    }


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x"), (2, "y"), (None, None), (None, None)], "a int, b string")
    assert frequency.duplicate_rows(df).first()["duplicate_rows"] == 3
    assert frequency.distinct_rows(df).count() == 3
    assert frequency.duplicate_rows(df.limit(0)).first()["duplicate_rows"] == 0


def test_pii(spark):
    mails = spark.createDataFrame([(f"user{i}@mail.org", f"name {i}", f"+1 (212) 555-{i:04d}") for i in range(60)],
                                  "m string, n string, p string")
    flags = {r["column"]: r["pii_flags"] for r in profile.pii_shares(mails, ["m", "n", "p"]).collect()}
    assert flags == {"m": ["potential_email"], "n": [], "p": ["potential_phone"]}
    few = mails.limit(5)
    assert profile.profile_columns(few).where("size(pii_flags) > 0").count() == 0
    scoped = profile.profile_columns(few, profile.Options(pii_scope="string"))
    assert scoped.where("size(pii_flags) > 0").count() == 2


def test_pii_of_first_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 100, "a@b.cd").otherwise("none").alias("s"))
    assert profile.pii_shares(df, ["s"]).first()["pii_flags"] == []
    first = profile.pii_shares(df, ["s"], sample=100, order_by=["id"]).first()
    assert first["pii_flags"] == ["potential_email"]


def exact(values, p, method):
    values = sorted(values)
    ranks = quantiles.ranks_for(len(values), p, method)
    return quantiles.combine([values[r] for r in ranks], len(values), p)


@pytest.mark.parametrize("limit", [0, 500, 10**6])
def test_quantiles_by_narrowing(spark, limit):
    # a third of the rows hold one value; one column is heavy-tailed, one has gaps
    df = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, 500.0).otherwise((F.col("id") * 7919) % 10_007).alias("hot"),
        F.exp((F.col("id") * 104_729) % 20_011 / 300.0).alias("tail"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("gaps"),
        F.lit(3.0).alias("same"),
    )
    columns, points = ["hot", "tail", "gaps", "same"], (0.0, 0.25, 0.5, 0.999, 1.0)
    data = {c: [r[c] for r in df.select(c).collect() if r[c] is not None] for c in columns}
    for method in ("nearest", "linear"):
        result = quantiles.quantiles(df, columns, points, method, inside_limit=limit)
        for r in result.collect():
            assert r["value"] == exact(data[r["column"]], r["probability"], method), (limit, method, r)


def test_approximate_quantiles(spark):
    df = spark.range(1, 1002).toDF("x")
    rows = quantiles.quantiles(df, ["x"], (0.25, 0.75), "approximate").collect()
    assert abs(rows[0]["value"] - 251) <= 2


@pytest.fixture(scope="module")
def sales(spark):
    """Sixty sales with gaps, a pair of columns that go together, and three wild prices."""
    source = random.Random(17)
    rows = []
    for i in range(60):
        price = 900.0 + 100 * i if i in (7, 21, 40) else round(source.uniform(5, 20), 2)
        rows.append((
            1000 + i, ["pen", "ink", "pad"][i % 3], source.randint(1, 6), price, round(price * 2 + i / 100, 2),
            f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", None if i % 15 == 4 else f"u{i}@example.com",
        ))
    schema = "order_id int, product string, quantity int, price double, total double, day string, email string"
    return rows, spark.createDataFrame(rows, schema)


def test_worked_numbers(sales):
    rows, df = sales
    records = profile.profile_columns(df)
    row = profile.dataset_profile_of(records, frequency.duplicate_rows(df)).first()
    assert (row["total_nulls"], row["duplicate_rows"]) == (4, 0)
    assert row["completeness_pct"] == round((1 - 4 / 420) * 100, 2)
    found = {r["column"]: r["detected_type"] for r in records.collect()}
    assert [c for c, k in found.items() if k == "numeric"] == ["order_id", "quantity", "price", "total"]
    assert (found["day"], found["product"], found["email"]) == ("datetime", "categorical", "text")
    by_name = {r["column"]: r for r in records.collect()}
    for place, name in ((2, "quantity"), (3, "price"), (4, "total")):
        values = sorted(r[place] for r in rows)
        assert math.isclose(by_name[name]["mean"], statistics.mean(values), abs_tol=1e-4)
        assert math.isclose(by_name[name]["std"], statistics.stdev(values), abs_tol=1e-4)
        assert (by_name[name]["q25"], by_name[name]["q75"]) == (values[15], values[44])
    wild = outliers.univariate_report(df, ["quantity", "price", "total"]).collect()
    assert {r["column"]: r["count"] for r in wild} == {"price": 3, "total": 3}
    pairs = {(r["col1"], r["col2"]) for r in high_correlations(df, ["order_id", "quantity", "price", "total"]).collect()}
    assert pairs == {("price", "total")}


def test_profile_does_not_depend_on_partitions(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet")
    one = sorted(map(str, profile.profile_columns(df.coalesce(1)).collect()))
    many = sorted(map(str, profile.profile_columns(df.repartition(13, "o_custkey")).collect()))
    assert one == many


def test_long_texts_count_by_value(spark):
    long = ["x" * 150, "2024-01-01 " + "y" * 200, "x" * 151]
    rows = [(long[0],)] * 5 + [(long[1],)] * 3 + [(long[2],)] + [("short",)] * 4 + [(None,)]
    df = spark.createDataFrame(rows, "s string")
    top = frequency.top_values(df).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [
        (long[0], 5), ("short", 4), (long[1], 3), (long[2], 1), ("None", 1)]
    assert frequency.n_unique(df).first()["n_unique"] == 5
    assert frequency.duplicate_rows(df).first()["duplicate_rows"] == 9
    record = profile.profile_columns(df).first()
    assert [e["value"] for e in record["top_values"]][:2] == [long[0], "short"]
    assert profile.summarize(df).first()["date_share"] == 3 / 13
    ties = spark.createDataFrame([("b" * 101,), ("a" * 150,), ("c" * 120,)], "s string")
    assert [r["value"][0] for r in frequency.top_values(ties, k=2).orderBy("rank").collect()] == ["a", "b"]


def test_duplicates_of_odd_values(spark):
    df = spark.sql("select * from values (0.0D, map('a', 1, 'b', 2)), (-0.0D, map('b', 2, 'a', 1)), (null, null), (null, null) t(x, m)")
    assert frequency.duplicate_rows(df).first()["duplicate_rows"] == 2
