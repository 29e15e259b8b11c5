"""Multivariate outliers by an isolation forest (Liu, Ting, Zhou 2008)."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.bounded import column_ref, local_table, small_rows
from tabscope.operators.association import impute_mean
from tabscope.operators.columns import as_double
from tabscope.operators.quantiles import quantile_values
from tabscope.operators.sampling import draw, generous_share
from tabscope.session import materialize

# Size of the forest and the share of rows it flags.
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.05
SEED = 42
MIN_COLUMNS, MIN_ROWS = 2, 10

# trees grow and score in Python workers, which then need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, cut double, path double"


def expected_path(n: float) -> float:
    """Average depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow_tree(sample: np.ndarray, seed: int, depth_limit: int) -> list[tuple[int, int, float, float]]:
    """Nodes (number, feature, cut, path) of one tree; a leaf has feature -1 and its path length.

    Children of node k are 2k+1 (below the cut) and 2k+2.
    """
    random = np.random.default_rng(seed)
    nodes = []
    waiting = [(0, 0, sample)]
    while waiting:
        node, depth, rows = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((node, -1, 0.0, depth + expected_path(len(rows))))
            continue
        feature = int(random.choice(varying))
        cut = float(random.uniform(low[feature], high[feature]))
        below = rows[:, feature] < cut
        if below.all() or not below.any():
            cut, below = float(high[feature]), rows[:, feature] < high[feature]
        nodes.append((node, feature, cut, 0.0))
        waiting.append((2 * node + 1, depth + 1, rows[below]))
        waiting.append((2 * node + 2, depth + 1, rows[~below]))
    return nodes


def _complete(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Imputed features as doubles f0, f1, ... of the rows without a missing one."""
    filled = impute_mean(df, columns)
    features = [as_double(c).alias(f"f{i}") for i, c in enumerate(columns)]
    rows = filled.select(*[column_ref(k) for k in keep], *features)
    usable = F.lit(True)
    for i in range(len(columns)):
        usable = usable & F.col(f"f{i}").isNotNull() & ~F.isnan(f"f{i}")
    return rows.where(usable)


def _tree_samples(rows: DataFrame, total: int, key: Sequence[str], seed: int) -> DataFrame:
    """(tree, features): up to 256 rows for each of 100 trees.

    A pool large enough for all trees is drawn first; then every tree draws from the pool.
    Draws that cannot win are dropped before the sort, so at most about 45,000 rows are
    sorted for a table of any size.
    """
    pool_size = TREES * TREE_ROWS
    pool = rows.where(draw(key, seed) < generous_share(pool_size, F.lit(total)))
    expected = F.lit(min(float(total), pool_size + 10 * math.sqrt(pool_size) + 30))
    tickets = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    tickets = tickets.withColumn("ticket", draw(key, seed + 1, F.col("tree"))).where(
        F.col("ticket") < generous_share(TREE_ROWS, expected * 0.98)
    )
    smallest = Window.partitionBy("tree").orderBy("ticket", *[column_ref(k) for k in key])
    return tickets.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= TREE_ROWS)


def _forest(rows: DataFrame, n_features: int, total: int, key: Sequence[str], seed: int) -> list:
    """The nodes of all trees: at most 100 * 511 small rows."""
    names = [f"f{i}" for i in range(n_features)]
    depth_limit = math.ceil(math.log2(max(min(TREE_ROWS, total), 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf.sort_values(names)[names].to_numpy()
        grown = grow_tree(values, seed * 1_000_003 + tree, depth_limit)
        return pd.DataFrame(
            [(tree, *node) for node in grown], columns=["tree", "node", "feature", "cut", "path"]
        )

    samples = _tree_samples(rows, total, key, seed).select("tree", *names)
    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return small_rows(nodes, TREES * 2 * TREE_ROWS)


def _arrays(nodes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node tables indexed by [tree, node number]."""
    size = max(row["node"] for row in nodes) + 1
    feature = np.full((TREES, size), -1, dtype=np.int32)
    cut = np.zeros((TREES, size))
    path = np.zeros((TREES, size))
    for row in nodes:
        feature[row["tree"], row["node"]] = row["feature"]
        cut[row["tree"], row["node"]] = row["cut"]
        path[row["tree"], row["node"]] = row["path"]
    return feature, cut, path


def _score(nodes: list, columns: list[Column], sample_size: int) -> Column:
    """Anomaly score of a row: 2 to the minus average depth over the expected depth."""
    feature, cut, path = _arrays(nodes)
    scale = expected_path(sample_size)
    levels = int(math.log2(feature.shape[1] + 1)) + 1

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        matrix = np.column_stack([v.to_numpy() for v in values])
        index = np.arange(len(matrix))
        depth = np.zeros(len(matrix))
        for tree in range(TREES):
            at = np.zeros(len(matrix), dtype=np.int64)
            for _ in range(levels):
                split = feature[tree, at]
                inner = split >= 0
                if not inner.any():
                    break
                right = matrix[index, np.maximum(split, 0)] >= cut[tree, at]
                at = np.where(inner, 2 * at + 1 + right, at)
            depth += path[tree, at]
        return pd.Series(np.exp2(-depth / TREES / scale))

    return score(*columns)


def isolation_scores(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = SEED
) -> DataFrame | None:
    """(key..., score) of the rows without NaN, written once; None if there are too few."""
    if len(columns) < MIN_COLUMNS:
        return None
    rows = _complete(df, columns, key)
    total = rows.count()
    if total < MIN_ROWS:
        return None
    nodes = _forest(rows, len(columns), total, key, seed)
    features = [F.col(f"f{i}") for i in range(len(columns))]
    scored = rows.select(
        *[column_ref(k) for k in key],
        _score(nodes, features, min(TREE_ROWS, total)).alias("score"),
    )
    return materialize(scored)


def isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> DataFrame:
    """(key..., score): the rows whose score lies above the 1 - contamination quantile.

    ``key`` must identify a row; draws come from it, so the forest does not depend on how the
    table is partitioned.
    """
    scores = isolation_scores(df, columns, key, seed)
    if scores is None:
        return df.select(*[column_ref(k) for k in key], F.lit(0.0).alias("score")).where(F.lit(False))
    wanted = (1.0 - contamination, "linear")
    threshold = quantile_values(scores, {"score": [wanted]})["score", *wanted]
    return scores.where(F.col("score") > threshold)


def isolation_summary(df: DataFrame, columns: Sequence[str], key: Sequence[str],
                      contamination: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """(count, pct, note): how many rows of the table the forest flags."""
    if len(columns) < MIN_COLUMNS:
        rows = [(0, None, "need at least 2 numeric columns")]
        return local_table(df.sparkSession, rows, "count long, pct double, note string")
    flagged = isolation_forest(df, columns, key, contamination, seed)
    n = df.count()
    note = F.when(F.lit(n < MIN_ROWS), "not enough valid rows")
    return flagged.agg(F.count(F.lit(1)).alias("count")).select(
        "count", F.round(F.col("count") / max(n, 1) * 100, 2).alias("pct"), note.alias("note")
    )
