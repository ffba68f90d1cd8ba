"""Run every registered query against its SQL oracle and print a report.

usage: python tests/run_oracle.py [sf_dir] [name ...]"""

import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from wearcast.plans.check import compare, duck  # noqa: E402
from wearcast.session import local_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
con = duck(sf_dir)
qs, sql = E.queries(), E.oracle_sql()
bad = 0
for name in names or list(qs):
    t0 = time.time()
    try:
        sp = qs[name](spark, sf_dir).toPandas()
        t1 = time.time()
        if name in sql:
            od = con.sql(sql[name]).df()
            r = compare(sp, od)
            ok = r["cols_match"] and r["rows_match"] and r["values_match"]
        else:
            r, ok = {"rows_spark": len(sp)}, True
        bad += not ok
        print(json.dumps({"q": name, "ok": ok, "spark_s": round(t1 - t0, 2), **{
            k: v for k, v in r.items() if k in ("rows_spark", "rows_oracle", "first_diff")
            or (not ok and k.startswith("cols"))}}, default=str), flush=True)
    except Exception as e:  # report and go on
        bad += 1
        print(json.dumps({"q": name, "ok": False, "error": str(e)[:600]}), flush=True)
print("FAILED", bad)
