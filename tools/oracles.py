"""Run the oracles alone: python tools/oracles.py [pattern ...]."""

from __future__ import annotations

import fnmatch
import sys
import time

import compare

if __name__ == "__main__":
    con = compare.connect("/root/testdata/sf0.01")
    for name, sql in compare.entry.oracle_sql().items():
        if not any(fnmatch.fnmatch(name, p) for p in sys.argv[1:] or ["*"]):
            continue
        start = time.time()
        try:
            rows = con.execute(sql).fetchall()
            print(f"{name:40s} {time.time() - start:6.2f}s {len(rows)} rows", rows[0] if rows else "")
        except Exception as error:  # noqa: BLE001
            print(f"{name:40s} ERROR {error}")
