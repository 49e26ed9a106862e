"""Run registered queries beside their SQL on one scale: python -m catalog._run [sf] [name ...]"""

import sys
import time

import duckdb

from catalog.base import ORACLE, QUERIES
from catalog.compare import connect, same
from revgauge.session import local_session


def main(argv):
    import catalog  # noqa: F401

    sf = argv[0] if argv else "0.01"
    d = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark = local_session("catalog")
    con = connect(d)
    bad = 0
    for name in names:
        t = time.time()
        try:
            got = QUERIES[name](spark, d).toPandas()
            took = time.time() - t
            if name in ORACLE:
                t = time.time()
                want = con.execute(ORACLE[name]).df()
                problem = same(got, want)
                print(f"{name:32s} {took:6.2f}s sql {time.time() - t:5.2f}s rows {len(got):6d} {problem or 'same'}", flush=True)
                bad += bool(problem)
            else:
                print(f"{name:32s} {took:6.2f}s rows {len(got):6d} (no sql)", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
