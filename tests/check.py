"""Command line check: python tests/check.py [name-prefix ...] [--sf DIR]."""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]
import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

from fairlake.session import local_session  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = local_session("8", int(__import__("os").environ.get("CHECK_PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - start
            if name not in sqls:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            diff = differences(got, con.execute(sqls[name]).df())
            sql_took = time.time() - start
        except Exception as e:
            bad += 1
            text = str(e) if "-v" not in sys.argv else traceback.format_exc()
            print(f"FAIL {name}: {type(e).__name__} {text[:900]}", flush=True)
            continue
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok  '} {name} {len(got)} {took:.1f}s sql {sql_took:.1f}s {diff}", flush=True)
    print("bad:", bad)
