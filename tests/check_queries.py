"""Compare registered queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from shuffleworks.session import get_session  # noqa: E402
from tests.checking import difference, duckdb_tables  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duckdb_tables(sf_dir), oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            problem = difference(df, con, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
            if name not in sql:
                print(f"rows  {name} {problem}", flush=True)
                continue
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
