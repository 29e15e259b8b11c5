"""Window functions over hot keys against plain Python."""

import random

import pytest

from pyspark.sql import functions as F

from tabscope.operators import asof
from tabscope.operators.windows import windowed

SCHEMA = "id int, k string, t int, v int, row_ int"


@pytest.fixture(params=[3, 24])
def parts(spark, request):
    """Partitions of a fixed number, some of them shorter than a frame."""
    names = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in old.items():
        spark.conf.set(n, v)


def expected(rows, descending):
    keys = {}
    for r in rows:
        keys.setdefault(r[1], []).append(r)
    found = {}
    for own in keys.values():
        sign = -1 if descending else 1
        none = float("-inf")  # nulls are the smallest
        own.sort(key=lambda r: (sign * (none if r[2] is None else r[2]), r[0]))
        rank = dense = 0
        for i, r in enumerate(own):
            if not i or r[2] != own[i - 1][2]:
                rank, dense = i + 1, dense + 1

            def values(low, high):
                return [x[3] for x in own[max(low, 0) : high] if x[3] is not None]

            so_far, near = values(0, i + 1), values(i - 5, i + 8)
            found[r[0]] = (
                i + 1, rank, dense, sum(so_far) if so_far else None, len(so_far), min(so_far, default=None), max(so_far, default=None),
                sum(near) / len(near) if near else None, min(values(i - 2, i + 1), default=None),
            )
    return found


def result(df, descending):
    found = windowed(
        df, ["k"], ["t"], descending=["t"] if descending else [],
        ranks={"nth": "row_number", "place": "rank", "level": "dense_rank"},
        running={"total": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "high": ("max", "v")},
        frames={"near": ("avg", "v", 5, 7), "last": ("min", "v", 2, 0)},
    )
    assert found.columns[:5] == df.columns
    rows = found.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: tuple(r)[5:] for r in rows}


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("size", [9, 700])
def test_hot_keys_ties_and_nulls(spark, parts, descending, size):
    source = random.Random(size)
    rows = [
        (i, "hot" if source.random() < 0.4 else source.choice([None, *"abcdef"]), source.choice([None, *range(6)]),
         source.choice([None, *range(-20, 20)]), 1)
        for i in range(size)
    ]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(4), descending) == expected(rows, descending)


def test_one_tie_over_all_partitions(spark, parts):
    rows = [(i, "hot", 1, i, 1) for i in range(300)] + [(300 + i, "hot", 2, None, 1) for i in range(200)]
    assert result(spark.createDataFrame(rows, SCHEMA), False) == expected(rows, False)


def test_repeated_rows_and_nothing(spark, parts):
    rows = spark.createDataFrame([(1, "a", 1, 2, 1)] * 50, SCHEMA)
    found = windowed(rows, ["k"], ["t"], ranks={"nth": "row_number", "place": "rank"}, frames={"s": ("sum", "v", 1, 1)}).collect()
    assert sorted(r["nth"] for r in found) == list(range(1, 51)) and {r["place"] for r in found} == {1}
    assert sorted(r["s"] for r in found) == [4, 4] + [6] * 48
    nothing = windowed(rows.limit(0), ["k"], ["t"], ranks={"nth": "row_number"}, running={"r": ("sum", "v")}, frames={"s": ("sum", "v", 1, 1)})
    assert nothing.columns == [*rows.columns, "nth", "r", "s"] and nothing.count() == 0


def test_wrong_arguments(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="name of another"):
        windowed(df, ["id"], ["id"], ranks={"ID": "rank"})
    with pytest.raises(ValueError, match="unknown"):
        windowed(df, ["id"], ["id"], ranks={"a": "ntile"})


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Neither the layout nor the windows over it put more rows into a task when the table grows."""
    monkeypatch.setattr(asof, "PART_ROWS", 40)
    source = random.Random(1)
    rows = [(i, source.choice(["hot", "hot", "a"]), source.choice([None, *range(6)]), source.choice([None, *range(9)]), 1) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, True) == expected(rows, True)
    for size in (500, 1000):
        found = windowed(df.where(f"id < {size}"), ["k"], ["t"], ranks={"place": "rank"}).groupBy(F.spark_partition_id()).count().collect()
        assert len(found) > size / 100 and max(r["count"] for r in found) < 400
    laid, number = asof.range_sorted(df, ["k", "t", "id"])
    assert number == 25 and laid.select("part_").distinct().count() > 20


def test_asof_join_in_many_partitions(spark, monkeypatch):
    source = random.Random(2)
    left = [(i, source.choice("aab"), source.randrange(90)) for i in range(300)]
    right = [(i, source.choice("aab"), source.randrange(90)) for i in range(60)]
    sides = spark.createDataFrame(left, "l int, k string, t int"), spark.createDataFrame(right, "r int, k string, u int")
    monkeypatch.setattr(asof, "PART_ROWS", 20)
    found = {(r["l"], r["u"], r["r"]) for r in asof.asof_join(*sides, "k", "t", "u", ["u", "r"], how="left").collect()}
    best = {i: max(((u, r) for r, k2, u in right if k2 == k and u <= t), default=(None, None)) for i, k, t in left}
    assert found == {(i, *b) for i, b in best.items()}
