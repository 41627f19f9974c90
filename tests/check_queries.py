"""``python -m tests.check_queries [sf_dir] [name ...]``: all queries against their SQL."""

import sys
import time

from quaymaster.session import local_session
from tests.compare import difference, duck
import __spark_entry__ as entry


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session()
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = difference(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001 - report every query
            found = f"ERROR {type(e).__name__} {str(e)[:500]}"
        ok = found is None or found.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - start:6.2f}s {found or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
