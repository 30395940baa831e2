"""Command line: `python tests/check.py [--dir=folder] [name ...]` compares the named queries (default all) with their SQL."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as contract  # noqa: E402
from oracle import connect, difference  # noqa: E402

from loanstrata.session import local_session  # noqa: E402


def main(names: list[str], folder: str) -> int:
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                found = difference(df, con, oracles[name]) or "ok"
            else:
                found = f"ok (rows only: {len(df.collect())})"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += not found.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s  {found}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    folder = next((a.removeprefix("--dir=") for a in sys.argv if a.startswith("--dir=")), "/root/testdata/sf0.01")
    sys.exit(min(1, main([a for a in sys.argv[1:] if not a.startswith("-")], folder)))
