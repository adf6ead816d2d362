"""Query and oracle pairs.

A query is a Spark callable ``(spark, sf_dir) -> DataFrame``; its oracle is independent SQL over the
same tables.  Both sides bring their double columns to the same number of decimals, because the two
engines add floating-point numbers in different orders; the step boundary lies off the half, since
short decimals often fall exactly on a half and the engines break such ties differently.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


STEP_OFFSET = 0.4371


def stepped(x, digits: int):
    return F.floor(x * float(10**digits) + F.lit(STEP_OFFSET)) / float(10**digits)


def rounded_query(run: Query, digits: int, special: dict[str, int]) -> Query:
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(*[
            stepped(F.col(f"`{name}`"), special.get(name, digits)).alias(name)
            if dtype == "double" else F.col(f"`{name}`")
            for name, dtype in df.dtypes
        ])

    return wrapped


def add(
    name: str,
    run: Query,
    sql: str | None = None,
    doubles: list[str] | None = None,
    digits: int = 6,
    special: dict[str, int] | None = None,
) -> None:
    """Register a query; ``doubles`` lists the double columns of its oracle."""
    if name in QUERIES:
        raise ValueError(f"query already registered: {name}")
    special = special or {}
    QUERIES[name] = rounded_query(run, digits, special)
    QUERIES[name].origin = sys._getframe(1).f_globals["__name__"]
    if sql is not None:
        if doubles:
            parts = ", ".join(
                f'floor(CAST("{c}" AS DOUBLE) * 1e{special.get(c, digits)} + {STEP_OFFSET})'
                f' / 1e{special.get(c, digits)} AS "{c}"'
                for c in doubles
            )
            # The WITH clause stays in front; the final SELECT becomes a subquery.
            sql = f"SELECT * REPLACE ({parts}) FROM (\n{sql.strip()}\n) AS q"
        ORACLES[name] = sql
