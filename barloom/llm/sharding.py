"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Every input block deals its rows to the shards in counts drawn from the multivariate hypergeometric law, so shard sizes
are exact and the deal is that of a uniform permutation.  Rows are permuted inside the block, exchanged, and permuted
again inside the shard.

The matrix is never built: blocks are leaves of a binary tree, each node splits its shard counts between its two halves
by draws seeded with the node, and a task walks only the path to its own block.  The driver holds one row count per
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.work import Workspace, free_name

_BLOCK_BITS = 33  # of monotonically_increasing_id(): the partition above, the row within it below
ROWS_PER_CELL = 250_000


def hypergeometric(rng: np.random.Generator, drawn: int, good: int, total: int) -> int:
    """How many of ``drawn`` rows out of ``total`` are good; inversion over all values within 14 deviations.

    Works on ratios of neighbouring probabilities, so it holds beyond the 10**9 rows of numpy's own sampler.
    """
    low, high = max(0, drawn - (total - good)), min(drawn, good)
    if low == high:
        return low
    mean = drawn * (good / total)
    spread = (mean * (1 - good / total) * ((total - drawn) / max(total - 1, 1))) ** 0.5
    first, last = max(low, int(mean - 14 * spread - 30)), min(high, int(mean + 14 * spread + 30))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(total - good - drawn + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, last - first))


def split_counts(rng: np.random.Generator, left: int, capacity: np.ndarray) -> np.ndarray:
    """Of ``left`` rows drawn from shards with these capacities, the number from each."""
    out, total = np.zeros_like(capacity), int(capacity.sum())
    for s, room in enumerate(capacity.tolist()):
        out[s] = hypergeometric(rng, left, room, total) if left else 0
        left, total = left - int(out[s]), total - room
    return out


def block_row(sizes: np.ndarray, block: int, capacity: np.ndarray, seed: int) -> np.ndarray:
    """The communication matrix's row of one block: its rows for each shard."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, low, high]), int(sums[middle] - sums[low]), capacity)
        if block < middle:
            high, capacity = middle, left
        else:
            low, capacity = middle, capacity - left
    return capacity


def shard_sizes(rows: int, n_shards: int) -> np.ndarray:
    return np.array([rows // n_shards + (s < rows % n_shards) for s in range(n_shards)], np.int64)


def shuffle_into_shards(spark: SparkSession, df: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in the shard).

    Shard sizes differ by one row at most.  Any columns, nulls, empty texts and repeated rows are carried as they are:
    each row is dealt on its own, and equal rows may part.  An empty table gives an empty result; with more shards than
    rows the last shards stay empty.  Columns of ``df`` called shard or slot keep their values under the name with a
    leading underscore.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    for name in ("shard", "slot"):
        for have in [c for c in df.columns if c.lower() == name]:
            df = df.withColumnRenamed(have, free_name(df, f"_{name}"))
    columns = df.columns
    number, dest, cell, key = (free_name(df, x) for x in ("_number", "_dest", "_cell", "_key"))
    # The blocks are written down once: their numbering must outlive lost executors and changed splits.
    stored = Workspace(spark, "sharding").store("rows", df.withColumn(number, F.monotonically_increasing_id()))
    block = F.shiftright(F.col(number), _BLOCK_BITS)
    counts = {r[0]: r[1] for r in stored.groupBy(block.alias("b")).count().collect()}  # a row per block
    blocks = {b: i for i, b in enumerate(sorted(counts))}
    sizes = np.array([counts[b] for b in sorted(counts)], np.int64)
    shared = spark.sparkContext.broadcast((blocks, sizes, shard_sizes(int(sizes.sum()), n_shards)))

    @F.pandas_udf("int")
    def deal(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        blocks, sizes, capacity = shared.value
        last, order, ends = None, None, None
        for series in numbers:
            number = series.to_numpy()
            out = np.empty(len(number), np.int32)
            of = number >> _BLOCK_BITS
            for b in np.unique(of).tolist():
                if b != last:
                    last, at = b, blocks[b]
                    ends = np.cumsum(block_row(sizes, at, capacity, seed))
                    order = np.random.default_rng([seed, at, 1]).permutation(int(sizes[at]))
                mine = of == b
                out[mine] = np.searchsorted(ends, order[number[mine] & ((1 << _BLOCK_BITS) - 1)], side="right")
            yield pd.Series(out)

    # Second permutation: a uniform key per row; its leading part names the cell, the rest orders the rows in it.
    cells = int(max(1, -(-int(sizes.sum()) // (n_shards * ROWS_PER_CELL)),
                    -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards)))
    dealt = (stored.withColumn(dest, deal(number)).withColumn(key, F.xxhash64(F.lit(seed), F.col(number)))
             .withColumn(cell, F.pmod(F.shiftright(F.col(key), 20), F.lit(cells)).cast("int")))
    placed = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(dest, cell).orderBy(key, number)))
    per_cell = stored.select(number).withColumn(dest, deal(number)).select(
        F.col(dest).alias("_d"), F.pmod(F.shiftright(F.xxhash64(F.lit(seed), F.col(number)), 20), F.lit(cells)).cast("int").alias("_c"),
    ).groupBy("_d", "_c").count()
    # n_shards x cells rows: bounded by the layout, one per ROWS_PER_CELL rows.
    before = per_cell.select("_d", "_c", (F.sum("count").over(Window.partitionBy("_d").orderBy("_c")) - F.col("count")).alias("_before"))
    return placed.join(F.broadcast(before), (F.col(dest) == F.col("_d")) & (F.col(cell) == F.col("_c"))).select(
        *[F.col(f"`{c}`") for c in columns], F.col(dest).alias("shard"),
        (F.col("_before") + F.col("_rank") - 1).alias("slot"))
