"""Compare every (or the named) registered query with its oracle.

usage: python tests/run_compare.py [sf_dir] [name ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from mirage.session import get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_spark(os.environ.get("COMPARE_MASTER", "local[8]"), shuffle_partitions=8)
Q, O = E.queries(), E.oracle_sql()
bad = 0
for n in (names or sorted(Q)):
    t = time.time()
    if n not in O:
        rows = Q[n](spark, sf).count()
        print(f"{n:28s} NO-ORACLE rows={rows} {time.time()-t:.1f}s", flush=True)
        continue
    try:
        ok, msg = compare(spark, n, sf, Q, O)
    except Exception as e:  # report and continue
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:600]}"
    bad += not ok
    print(f"{n:28s} {'OK ' if ok else 'BAD'} {msg} {time.time()-t:.1f}s", flush=True)
print("mismatches:", bad)
