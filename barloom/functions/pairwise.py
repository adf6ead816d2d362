"""Correlation of every pair of columns in one pass, and the greedy filter that uses it.

Each task folds its rows into centred moments of column pairs, a strip of columns against all later ones, so that a task's
memory is bounded whatever the number of columns.  The moments leave in packed square tiles; tiles of one place are added
up in a stream, and only there do they become rows, of strong pairs alone if a limit is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 128  # columns of a square tile
STRIP_CELLS = 1 << 21  # pairs that a task holds at a time: six numbers each, some 100 MB
MOMENTS = 6
TILES = "grp string, a int, b int, height int, width int, moments binary"
PAIRS = "grp string, a int, b int, overlap long, corr double"


class PairMoments:
    """Counts, means and centred second moments of the columns ``first`` to ``last`` with all from ``first`` on, over rows where both are finite."""

    def __init__(self, first: int, last: int, width: int):
        self.first, self.last = first, min(last, width)
        self.total = np.zeros((MOMENTS, self.last - first, width - first))

    def add(self, values: np.ndarray) -> None:
        values = values[:, self.first:]
        mask = np.isfinite(values)
        # A shift near the data keeps the sums small; equal columns shift to exact zeros.
        known = np.argmax(mask, axis=0)
        shift = np.where(mask.any(axis=0), values[known, np.arange(values.shape[1])], 0.0)
        y, my = np.where(mask, values - shift, 0.0), mask.astype(float)
        height = self.last - self.first
        x, mx = y[:, :height], my[:, :height]
        n = mx.T @ my
        with np.errstate(divide="ignore", invalid="ignore"):
            mean_x, mean_y = np.where(n > 0, (x.T @ my) / n, 0.0), np.where(n > 0, (mx.T @ y) / n, 0.0)
        here = n > 0
        self.total = merged(self.total, np.stack([
            n, mean_x + shift[:height, None] * here, mean_y + shift[None, :] * here,
            (x * x).T @ my - n * mean_x**2, mx.T @ (y * y) - n * mean_y**2, x.T @ y - n * mean_x * mean_y]))

    def tiles(self, group: str | None) -> Iterator[dict]:
        """Packed tiles on and above the diagonal."""
        height, width = self.total.shape[1:]
        for a in range(0, height, TILE):
            for b in range(a, width, TILE):
                part = self.total[:, a:a + TILE, b:b + TILE]
                if part[0].any():
                    yield {"grp": group, "a": self.first + a, "b": self.first + b, "height": part.shape[1], "width": part.shape[2], "moments": part.tobytes()}


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows: n, mean x, mean y, and the centred sums of xx, yy and xy."""
    total = one[0] + other[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(total > 0, one[0] * other[0] / total, 0.0)
        part = np.where(total > 0, other[0] / total, 0.0)
    dx, dy = other[1] - one[1], other[2] - one[2]
    return np.stack([
        total, one[1] + dx * part, one[2] + dy * part,
        one[3] + other[3] + weight * dx * dx, one[4] + other[4] + weight * dy * dy, one[5] + other[5] + weight * dx * dy])


def pair_correlations(
    wide: DataFrame, group: str, columns: Sequence[str], signals: Callable[[str | None, np.ndarray], np.ndarray] | None = None,
    signed: bool = False, widths: Mapping[str | None, int] | None = None, limit: float | None = None, min_overlap: int = 0,
) -> DataFrame:
    """Absolute (or signed) correlation and overlap of every pair of ``columns`` per group.

    ``signals`` may turn the column matrix of a group's rows into another matrix, ``widths`` columns wide, whose columns
    are paired instead; groups without a width are left out.  Output: group, a, b (column positions, a < b), overlap,
    abs_corr (null if undefined).  With a ``limit`` only pairs at or above it in size, over ``min_overlap`` rows or more.

    Rows are read once for each strip of columns; up to some 1,400 columns that is one.
    """
    columns, tile = list(columns), TILE
    widest = max(widths.values(), default=0) if widths is not None else len(columns)
    strip = max(TILE, STRIP_CELLS // max(widest, 1) // TILE * TILE)
    strips = max(1, -(-widest // strip))
    tasks = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), wide.sparkSession.sparkContext.defaultParallelism)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, moments = None, None
        for batch in batches:
            frame = batch.to_pandas()
            names = [None if pd.isna(x) else str(x) for x in frame[group]]
            runs = [(k, n) for k, n in zip(frame["_strip"].tolist(), names, strict=True)]
            cuts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)] if runs else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key != runs[a]:
                    yield from _batches(moments.tiles(key[1]) if moments is not None else (), TILES)
                    key, moments = runs[a], None
                name = key[1]
                width = len(columns) if widths is None else widths.get(name, 0)
                if key[0] * strip >= width:
                    continue
                if moments is None:
                    moments = PairMoments(key[0] * strip, (key[0] + 1) * strip, width)
                step = max(1, STRIP_CELLS // width)  # rows whose signals are held at a time
                for r in range(a, b, step):
                    values = frame[columns].iloc[r:min(r + step, b)].to_numpy(dtype=float)
                    moments.add(signals(name, values) if signals else values)
        if moments is not None:
            yield from _batches(moments.tiles(key[1]), TILES)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles of one place come one after another."""
        key, total = None, None
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                here = (row["grp"], row["a"], row["b"])
                part = np.frombuffer(row["moments"]).reshape(MOMENTS, row["height"], row["width"])
                if here == key:
                    total = merged(total, part)
                    continue
                if total is not None:
                    yield from _pairs(key, total, limit, min_overlap)
                key, total = here, part
        if total is not None:
            yield from _pairs(key, total, limit, min_overlap)

    rows = wide.select(group, *columns, F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("_strip"))
    if strips > 1:
        rows = rows.repartition(tasks, "_strip", *columns[:1])
    tiles = rows.sortWithinPartitions("_strip", group).mapInArrow(fold, TILES)
    spread = max(1, min(tasks, (-(-widest // tile)) ** 2))
    found = tiles.repartition(spread, "grp", "a", "b").sortWithinPartitions("grp", "a", "b").mapInArrow(add_up, PAIRS)
    value = F.col("corr") if signed else F.abs("corr").alias("abs_corr")
    return found.select(F.col("grp").alias(group), "a", "b", "overlap", value)


def _batches(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], fields)


def _pairs(key: tuple, total: np.ndarray, limit: float | None, min_overlap: int) -> Iterator[pa.RecordBatch]:
    group, first_a, first_b = key
    n, _, _, sxx, syy, sxy = total
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = sxy / np.sqrt(sxx * syy)
    defined = (n >= 2) & (sxx > 0) & (syy > 0)
    a, b = np.nonzero(n > 0)
    keep = first_a + a < first_b + b
    if limit is not None:
        keep &= defined[a, b] & (np.abs(corr[a, b]) >= limit) & (n[a, b] >= min_overlap)
    a, b = a[keep], b[keep]
    yield pa.RecordBatch.from_pydict({
        "grp": pa.array([group] * len(a), pa.string()), "a": pa.array(first_a + a, pa.int32()), "b": pa.array(first_b + b, pa.int32()),
        "overlap": pa.array(n[a, b].astype(np.int64)), "corr": pa.array(corr[a, b], pa.float64(), mask=~defined[a, b])})


DECISION = "position int, rejected boolean, reference int, abs_corr double, overlap long"


def greedy_decisions(pairs: DataFrame, candidates: DataFrame, group: str, limit: float, min_overlap: int) -> DataFrame:
    """Walk candidates by position; reject one that correlates at ``limit`` or more with an accepted one.

    ``candidates`` has the group and ``position``.  A group holds at most one row per pair of
    candidates, so its size is bounded by the candidate list, not by the data.
    """
    strong = pairs.filter((F.col("abs_corr") >= limit) & (F.col("overlap") >= min_overlap)).select(
        group, F.col("b").alias("position"), F.col("a").alias("reference"), "abs_corr", "overlap"
    )
    rows = candidates.select(group, "position").join(strong, [group, "position"], "left")
    kind = dict(candidates.dtypes)[group]

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        accepted: set[int] = set()
        out = []
        for position, part in frame.sort_values(["position", "reference"]).groupby("position", sort=True):
            hits = part[part["reference"].isin(accepted)]
            if len(hits):
                # The first accepted factor in rank order that is too close.
                hit = hits.iloc[0]
                out.append((position, True, int(hit["reference"]), hit["abs_corr"], int(hit["overlap"])))
            else:
                accepted.add(int(position))
                out.append((position, False, None, None, None))
        result = pd.DataFrame(out, columns=["position", "rejected", "reference", "abs_corr", "overlap"])
        result["reference"] = result["reference"].astype("Int32")
        result["overlap"] = result["overlap"].astype("Int64")
        result["abs_corr"] = result["abs_corr"].astype("float64")
        result.insert(0, group, frame[group].iloc[0])
        return result

    return rows.groupBy(group).applyInPandas(walk, f"{group} {kind}, {DECISION}")
