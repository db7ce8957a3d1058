"""Compare every registered query with its SQL: python tests/check_all.py [sf] [name ...]"""

import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import TESTDATA, compare  # noqa: E402
from tracewell.plans import registry  # noqa: E402
from tracewell.session import local_session  # noqa: E402


def run_one(spark, name: str, sf_dir: str) -> tuple[str, str, float, str]:
    """(name, kind, seconds, problem); queries without SQL must give rows."""
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    start = time.time()
    try:
        if sql is not None:
            kind, problem = "sql", compare(spark, name, query, sql, sf_dir)
        else:
            kind, problem = "rows", "" if query(spark, sf_dir).collect() else "no rows"
    except Exception as e:  # noqa: BLE001
        kind, problem = "error", f"{type(e).__name__}: {str(e)[:600]}"
    return name, kind, time.time() - start, problem


def run_all(spark, names, sf_dir: str, threads: int = 6):
    """Spark runs the jobs of several queries at once; results come in order."""
    with ThreadPoolExecutor(threads) as pool:
        yield from pool.map(lambda n: run_one(spark, n, sf_dir), names)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    names = [n for n in registry.queries() if not wanted or n in wanted]
    bad = 0
    for name, kind, seconds, problem in run_all(local_session(), names, f"{TESTDATA}/{sf}"):
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {kind:5} {seconds:6.2f}s {name} {problem}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
