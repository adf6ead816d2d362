"""Exact top-k by inner product: tiles of queries times tiles of rows, partial selection per tile, lists merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE_BITS = 12  # rows of a candidate tile: 4,096
QUERY_BLOCK = 8192  # queries of one grid column
CELL_ROWS = 1 << 20  # candidates of one grid cell
SCORE_CELLS = 1 << 22  # entries of one score tile
MERGE_FAN = 8
_LONG = (1 << 63) - 1


def best_of_tile(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and row positions of each query's k best rows, ties to the earlier row; int64, exact.

    Rows of more than 2**51 in a score take Python integers and end at the limits of a 64-bit number.
    """
    n = len(rows)
    bound = max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(rows.shape[1], 1)
    if bound < 2.0**50:
        scores = (queries @ rows.T).astype(np.int64)
        keys = (scores << TILE_BITS) | np.arange(n - 1, -1, -1)
        keys = np.partition(keys, n - k, axis=1)[:, n - k:] if n > k else keys
        keys = -np.sort(-keys, axis=1)
        return keys >> TILE_BITS, n - 1 - (keys & ((1 << TILE_BITS) - 1))
    exact = [[int(x) for x in row] for row in rows.tolist()]
    scores = np.array([[max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(map(int, q), row, strict=True)))) for row in exact]
                       for q in queries.tolist()], object).reshape(len(queries), n)
    order = np.array([sorted(range(n), key=lambda i: (-row[i], i))[:k] for row in scores], np.int64)
    return np.take_along_axis(scores, order, 1).astype(np.int64), order


def merge_lists(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two lists per query (scores, ids) to one, best first, ties to the smaller id."""
    scores, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted cells: first the queries of a block, then the rows it meets, in id order."""
        cell, queries, pending, best = None, [], [], None

        def matrix(found: list) -> tuple[np.ndarray, np.ndarray]:
            ids = np.concatenate([x[0] for x in found])
            return ids, np.concatenate([x[1] for x in found])

        def flush():
            nonlocal best, pending, queries
            if not pending:
                return
            if not len(queries):  # vectors of a length that no query has
                pending = []
                return
            if isinstance(queries, list):
                queries = matrix(queries)
            ids, rows = matrix(pending)
            pending = []
            tile, width = 1 << TILE_BITS, rows.shape[1]
            for r in range(0, len(ids), tile):
                lists = []
                # A query meets at most so many rows of its own id.
                own_rows = int(np.unique(ids[r:r + tile], return_counts=True)[1].max())
                step = max(1, SCORE_CELLS // tile)
                for q in range(0, len(queries[0]), step):
                    own_id = queries[0][q:q + step]
                    scores, at = best_of_tile(queries[1][q:q + step], rows[r:r + tile], min(k + own_rows, len(rows[r:r + tile])))
                    found = ids[r:r + tile][at]
                    # Rows of a query's own id drop behind every other.
                    own = found == own_id[:, None]
                    scores, found = np.where(own, -_LONG - 1, scores), np.where(own, _LONG, found)
                    order = np.argsort(own, axis=1, kind="stable")[:, :k]
                    lists.append((np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)))
                one = tuple(np.concatenate(x) for x in zip(*lists, strict=True))
                best = one if best is None else merge_lists(best, one, k)
            assert width == queries[1].shape[1]

        def result():
            flush()
            if best is None:
                return None
            n = best[0].shape[1]
            keep = (best[1] != _LONG).ravel()
            block, dim, part = cell
            return pa.RecordBatch.from_pydict({
                "query_id": np.repeat(queries[0], n)[keep], "vec_id": best[1].ravel()[keep], "score": best[0].ravel()[keep],
                "part": np.full(int(keep.sum()), part, np.int32)})

        waiting = 0
        for batch in batches:
            block, dim, part, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "dim", "part", "kind", "vec_id"))
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dim) - dim
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(dim) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(ids)], strict=True):
                if a == b:
                    continue
                here = (int(block[a]), int(dim[a]), int(part[a]))
                if here != cell:
                    if cell is not None and (done := result()) is not None:
                        yield done
                    cell, queries, pending, best, waiting = here, [], [], None, 0
                rows = values[ends[a]:ends[b - 1] + dim[b - 1]].reshape(b - a, dim[a])
                (queries if kind[a] == 0 else pending).append((ids[a:b], rows))
                waiting += (b - a) * (kind[a] == 1)
                if waiting >= 1 << TILE_BITS:
                    flush()
                    waiting = 0
        if cell is not None and (done := result()) is not None:
            yield done

    return run


def top_k(df: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0) -> DataFrame:
    """Each query's ``k`` highest inner products over quantised vectors: query_id, rank (from 1), vec_id, score.

    ``df`` has vec_id (integer) and embedding (array of float or double); other columns are ignored.  A component x
    counts as floor(scale * x).  Queries are the rows whose id is divisible by ``query_every``; candidates are all rows
    with another id.  Rows with a null id, null vector, or null or non-finite component take no part; vectors meet only
    vectors of their own length (empty ones score 0).  Ties go to the smaller id.  Rows of a repeated id are
    candidates of their own, and as queries they fill one list together.  With fewer than ``k`` candidates all are returned; an empty table gives none.

    Queries are cut into blocks and rows into parts of at most about a million; a task holds one block and streams its
    part, so neither memory nor a task's reading grows.  Rows are copied once per query block: that is the least a stated query set against all rows takes.
    """
    if k < 1 or query_every < 1:
        raise ValueError("k and query_every must be positive")
    spark = df.sparkSession
    quantised = F.transform("embedding", lambda x: F.when(
        x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(x.cast("double") * scale).cast("double")))
    # floor() of a double gives a long; what lies beyond it is a whole number already.
    quantised = F.when(F.exists("embedding", lambda x: F.abs(x.cast("double") * scale) >= 2.0**62),
                       F.transform("embedding", lambda x: x.cast("double") * scale)).otherwise(quantised)
    vectors = (df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
               .where(~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)))
               .select(F.col("vec_id").cast("long").alias("vec_id"), quantised.alias("values"))
               .withColumn("dim", F.size("values")))
    is_query = F.pmod(F.col("vec_id"), F.lit(query_every)) == 0
    n_rows, n_queries = vectors.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, -(-tasks // blocks), -(-n_rows // CELL_ROWS))
    hashed = F.xxhash64("vec_id", "values")  # of a repeated id too, the rows go to different cells
    queries = vectors.where(is_query).select(
        F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), "dim", F.lit(0).alias("kind"), "vec_id", "values",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dim", F.lit(1).alias("kind"), "vec_id", "values",
        F.pmod(F.xxhash64(F.lit(1), "vec_id", "values"), F.lit(parts)).cast("int").alias("part"))
    cells = (queries.unionByName(rows).repartition(blocks * parts, "block", "dim", "part")
             .sortWithinPartitions("block", "dim", "part", "kind", "vec_id"))
    lists = cells.mapInArrow(_search(k), "query_id long, vec_id long, score long, part int")
    level = parts
    while True:
        level = -(-level // MERGE_FAN)
        group = ["query_id"] if level == 1 else ["query_id", "part"]
        lists = (lists.withColumn("part", F.floor(F.col("part") / MERGE_FAN).cast("int"))
                 .withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")))
                 .where(F.col("rank") <= k))
        if level == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
