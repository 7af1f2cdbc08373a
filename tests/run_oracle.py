"""Command-line check: python -m tests.run_oracle [sf] [query ...]"""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry_module
from pairgauge.session import local_session
from tests import compare


def main() -> None:
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = local_session(8)
    connection = compare.duck(sf)
    oracles = entry_module.oracle_sql()
    for name, make in entry_module.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = make(spark, sf)
            columns, rows = compare.spark_rows(df)
        except Exception as error:
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            continue
        took = time.time() - started
        if name not in oracles:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s", flush=True)
            continue
        try:
            started = time.time()
            expected_columns, expected = compare.duck_rows(connection, oracles[name])
            duck_took = time.time() - started
        except Exception as error:
            print(f"FAIL {name}: oracle {str(error)[:600]}", flush=True)
            continue
        kinds, duck_kinds = compare.spark_kinds(df), compare.duck_kinds(connection, oracles[name])
        types = {c: (kinds[c], duck_kinds.get(c)) for c in kinds if kinds[c] != duck_kinds.get(c)}
        good = columns == expected_columns and rows == expected
        print(
            f"{'ok  ' if good else 'DIFF'} {name}: {len(rows)} rows {took:.1f}s duck "
            f"{duck_took:.1f}s {'types ' + str(types) if types else ''}",
            flush=True,
        )
        if not good:
            print("   columns", columns, expected_columns)
            here, there = set(rows), set(expected)
            print("   only spark", len(here - there), sorted(here - there)[:3])
            print("   only duck", len(there - here), sorted(there - here)[:3], flush=True)


if __name__ == "__main__":
    main()
