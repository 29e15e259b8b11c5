"""Compare registered queries with their SQL: python tests/check.py [folder] [name...]"""

import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402

from tabscope.session import build_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    connection = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started, took = time.time(), 0.0
        try:
            df = queries[name](spark, folder)
            df.write.format("noop").mode("overwrite").save()
            took = time.time() - started
            if name in sql:
                problem = difference(df, connection, sql[name])
                verdict = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                rows = df.collect()
                verdict = f"rows only: {len(rows)} {str(rows[:2])[:200]}"
        except Exception as error:
            verdict = f"FAILED {type(error).__name__} {str(error)[:600]}"
            if wanted:
                traceback.print_exc()
        if not verdict.startswith(("ok", "rows")):
            bad += 1
        print(f"{name:28s} {took:6.2f}s {verdict}", flush=True)
    print("problems:", bad)
