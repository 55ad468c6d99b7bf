"""Run every registered query (or the named ones) against its DuckDB oracle.

    python tests/run_oracle.py [sf_dir] [name ...]
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from claimwise.session import build_session  # noqa: E402
from tests import harness as H  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    qs, oq = E.queries(), E.oracle_sql()
    names = args or sorted(qs)
    con = H.duck(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(json.dumps({"q": n, "spark_error": str(e)[:400]})); bad += 1; continue
        ts = round(time.time() - t0, 2)
        if n not in oq:
            print(json.dumps({"q": n, "rows": len(sdf), "oracle": None, "sec": ts})); continue
        try:
            ddf = con.execute(oq[n]).df()
        except Exception as e:  # noqa: BLE001
            print(json.dumps({"q": n, "duck_error": str(e)[:600]})); bad += 1; continue
        r = H.compare(sdf, ddf)
        r.update({"q": n, "sec": ts})
        ok = r.get("hash_match")
        if not ok:
            bad += 1
            if r["cols_match"]:
                cols, a, b = H.diff_rows(sdf, ddf, n=3)
                r["cols"] = cols; r["spark_only"] = a; r["duck_only"] = b
        print(json.dumps(r, default=str)[:3000])
    print("FAILED", bad, "of", len(names))


if __name__ == "__main__":
    main()
