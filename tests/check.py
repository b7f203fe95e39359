"""python tests/check.py DIRECTORY [name ...]: every query against its SQL, timed."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract
from basketlens.session import local_session
from tests.compare import compare, duck

if __name__ == "__main__":
    directory, only = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(directory)
    statements = contract.oracle_sql()
    bad = 0
    for name, fn in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, directory)
            if name in statements:
                problems = compare(df, con, statements[name])
                verdict = "ok" if not problems else "FAIL " + "; ".join(problems)
            else:
                verdict = f"rows={len(df.collect())} {df.columns}"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += verdict.startswith(("FAIL", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print("problems:", bad)
