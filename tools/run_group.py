"""Compare the queries that one check module registers: python tools/run_group.py q_panel [sf]."""

from __future__ import annotations

import importlib
import sys

import compare

from barloom.checks import registry

if __name__ == "__main__":
    before = None
    wanted, sf = sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "0.01"
    module = importlib.import_module(f"barloom.checks.{wanted}")
    names = [n for n, q in registry.QUERIES.items() if getattr(q, "origin", None) == module.__name__]
    sys.argv = ["compare", *names, "--sf", sf]
    compare.main()
