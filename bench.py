"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabscope.plans import all_queries  # noqa: E402
from tabscope.session import build_session  # noqa: E402

HEADLINE = (
    "profile_dataset", "profile_columns", "column_types", "value_counts", "n_unique", "null_counts",
    "duplicate_rows", "top_values", "quantile_nearest", "profile_numeric", "pii_flags", "pearson_matrix",
    "cramers_v", "chi_square", "anderson_darling", "shapiro_wilk", "iqr_outliers", "iqr_outlier_rows",
    "isolation_forest", "trend", "autocorrelation", "timeseries_report", "findings_report", "chart_histogram",
    "chart_box", "split_sections", "extract_json", "vector_topk_each", "sql_join_inner", "sql_window_rank",
    "asof_join", "analyze_summary", "categorical_associations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    queries = all_queries()
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()  # start the workers
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
