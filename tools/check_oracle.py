"""Compare every registered query with its DuckDB oracle.

    python tools/check_oracle.py [--exact] [sf_dir] [names...]

``--exact`` compares floats bit for bit (as a value hash would) instead of
rounded to 6 decimals.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"))

import oracle_compare  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402
from supplylens.session import get_session  # noqa: E402
from supplylens.plans import registry  # noqa: E402


def _exact(v):
    import datetime as dt
    import decimal
    import math
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v.hex()
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def main():
    args = sys.argv[1:]
    if "--exact" in args:
        args.remove("--exact")
        oracle_compare._canon = _exact
    sf = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sql = registry.queries(), registry.oracle_sql()
    bad = 0
    for n in (names or qs):
        t = time.time()
        try:
            r = compare(spark, con, n, qs[n], sql.get(n), sf)
        except Exception as e:  # report and continue
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("ok", "rows-only")
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:28s} {time.time()-t:6.2f}s {r}", flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} bad")


if __name__ == "__main__":
    main()
