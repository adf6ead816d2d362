"""Hard negatives by exact inner products: several candidates ride in one wide number, multiplied once per anchor component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.work import Workspace

TILE_BITS = 12  # rows of a candidate tile: 4,096
ANCHOR_BLOCK = 8192  # anchors of one grid column
CELL_ROWS = 1 << 20  # candidates of one grid cell
SCORE_CELLS = 1 << 22  # entries of one score tile
EXACT_BITS = 53  # whole numbers below 2**53 are exact in a matrix product of doubles
WIDE_FIELDS = 8  # candidates in one Python integer, where not even one field fits
MERGE_FAN = 8
_LONG = (1 << 63) - 1
_NONE = np.int64(-_LONG - 1)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered vectors, exact; one column per row.

    Components are shifted to be non-negative, so that a field is never negative and no carry leaves it.  A field is as
    wide as the largest product sum; as many rows as fit share one number: field j of a lane holds row j * lanes + lane.
    One product sum per anchor and lane then holds a score per field, and the shifts are taken out again.
    Numbers too large for one field of a double, or for 64 bits with their shifts, are packed in Python integers; their
    scores end at 64 bits.
    """
    n, width = rows.shape
    if not n or not len(anchors) or not width:
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_r, high_a, high_r = int(anchors.min()), int(rows.min()), int(anchors.max()), int(rows.max())
    bits = max(1, (width * (high_a - low_a) * (high_r - low_r)).bit_length())
    fields = EXACT_BITS // bits
    exact = fields > 0 and width * max(-low_a, high_a) * max(-low_r, high_r) < 1 << 61  # the shifts fit 64 bits too
    if exact:
        a, r = (anchors - low_a).astype(float), (rows - low_r).astype(float)
    else:
        fields = WIDE_FIELDS
        whole = np.frompyfunc(int, 1, 1)
        a, r = whole(anchors) - low_a, whole(rows) - low_r
    lanes = -(-n // fields)
    packed = np.zeros((lanes, width), a.dtype)
    for j in range(-(-n // lanes)):
        field = r[j * lanes:(j + 1) * lanes]
        packed[:len(field)] += field * ((2.0 ** (j * bits)) if exact else 1 << (j * bits))
    sums = a @ packed.T
    if exact:
        sums = sums.astype(np.int64)
    mask = (1 << bits) - 1
    scores = np.concatenate([(sums >> (j * bits)) & mask for j in range(-(-n // lanes))], 1)[:, :n]
    own_a, own_r = (a.astype(np.int64).sum(1), r.astype(np.int64).sum(1)) if exact else (a.sum(1), r.sum(1))
    # (A - la)(R - lr) summed is score - lr * sum A - la * sum R + width * la * lr, and sum A is own_a + width * la.
    scores = scores + low_r * own_a[:, None] + low_a * own_r[None, :] + width * low_a * low_r
    return scores if exact else np.frompyfunc(lambda x: max(-_LONG - 1, min(_LONG, x)), 1, 1)(scores).astype(np.int64)


def _keys(scores: np.ndarray, take: np.ndarray) -> np.ndarray | None:
    """Score and position in one number, the earlier position higher; None if a score is too large for that."""
    if np.abs(scores.astype(float)).max(initial=0) >= 2.0 ** (62 - TILE_BITS):
        return None
    return np.where(take, (scores << TILE_BITS) | np.arange(scores.shape[1] - 1, -1, -1), _NONE)


def _opened(keys: np.ndarray, n: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(ok, keys >> TILE_BITS, _NONE), np.where(ok, n - 1 - (keys & ((1 << TILE_BITS) - 1)), -1)


def best(scores: np.ndarray, take: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and positions of each line's k highest scores among those to take, ties to the earlier; -1 where there is none."""
    n, keys = scores.shape[1], _keys(scores, take)
    if keys is not None:
        keys = np.partition(keys, n - k, axis=1)[:, n - k:] if n > k else keys
        keys = -np.sort(-np.maximum(keys, -_LONG), axis=1)
        return _opened(keys, n, keys != -_LONG)
    order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~take), axis=1)[:, :k]
    found = np.take_along_axis(take, order, 1)
    return np.where(found, np.take_along_axis(scores, order, 1), _NONE), np.where(found, order, -1)


def first_below(scores: np.ndarray, take: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line and each of its bands, the k highest scores from low to high, ties to the earlier; position -1 where there is none."""
    n, keys = scores.shape[1], _keys(scores, take)
    if keys is None:
        lists = [best(scores, take & (scores >= low[:, [b]]) & (scores <= high[:, [b]]), k) for b in range(low.shape[1])]
        pad = ((0, 0), (0, k - lists[0][0].shape[1]))
        return (np.stack([np.pad(s, pad, constant_values=_NONE) for s, _ in lists], 1),
                np.stack([np.pad(p, pad, constant_values=-1) for _, p in lists], 1))
    limit = 1 << (62 - TILE_BITS)
    keys = np.sort(keys, axis=1)
    top = (np.clip(high, -limit, limit - 1) + 1) << TILE_BITS  # the first key above the band
    ends = np.stack([(keys < top[:, [b]]).sum(1) for b in range(high.shape[1])], 1)
    at = ends[:, :, None] - 1 - np.arange(k)
    key = np.take_along_axis(keys[:, None, :], np.maximum(at, 0), 2)
    return _opened(key, n, (at >= 0) & (key != _NONE) & (key >> TILE_BITS >= low[:, :, None]))


def band(score: np.ndarray, least: int = 50, most: int = 95) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole n with least * score <= 100 * n <= most * score, without overflow."""
    whole, rest = score // 100, score % 100
    return least * whole - (-least * rest) // 100, most * whole + (most * rest) // 100


def _matrix(batch: pa.RecordBatch, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of a batch one after another (64-bit if all are small, else double) and each row's first place."""
    small, wide = batch.column("small"), batch.column("wide")
    starts = np.cumsum(dims) - dims
    if not wide.null_count == len(wide):
        values = np.empty(int(dims.sum()), float)
        for k, (s, w) in enumerate(zip(small, wide, strict=True)):
            values[starts[k]:starts[k] + dims[k]] = (w if w.is_valid else s).values.to_numpy(zero_copy_only=False)
        return values, starts
    return small.flatten().to_numpy(zero_copy_only=False).astype(np.int64), starts


class _Cell:
    """The anchors of a block, and what its rows have given so far."""

    def __init__(self, key: tuple, k: int, same: bool):
        self.key, self.k, self.same = key, k, same
        self.pieces: list[dict] = []
        self.pending: list[dict] = []
        self.anchors: dict | None = None
        self.lists: tuple | None = None

    @staticmethod
    def joined(pieces: list[dict]) -> dict:
        return {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}

    def flush(self) -> None:
        if not self.pending or not self.pieces and self.anchors is None:
            self.pending = []
            return
        if self.anchors is None:
            self.anchors = self.joined(self.pieces)  # in the order of their labels
            self.low, self.high = band(self.anchors["positive"].reshape(len(self.anchors["vec_id"]), -1)) if not self.same else (None, None)
        rows, self.pending = self.joined(self.pending), []
        for start in range(0, len(rows["vec_id"]), 1 << TILE_BITS):
            tile = {c: v[start:start + (1 << TILE_BITS)] for c, v in rows.items()}
            order = np.argsort(tile["vec_id"], kind="stable")
            tile = {c: v[order] for c, v in tile.items()}
            labels = self.anchors["label"]
            first, last = 0, len(labels)
            if self.same:  # rows come in the order of their labels: only anchors of those labels can meet them
                first, last = np.searchsorted(labels, tile["label"].min()), np.searchsorted(labels, tile["label"].max(), side="right")
            step = max(1, SCORE_CELLS // len(tile["vec_id"]))
            for a in range(first, last, step):
                self.meet(slice(a, min(a + step, last)), tile)

    def meet(self, part: slice, tile: dict) -> None:
        n = len(self.anchors["vec_id"])
        anchors = {c: self.anchors[c][part] for c in ("vec_id", "label", "values")}
        take = (anchors["label"][:, None] == tile["label"]) == self.same
        take &= anchors["vec_id"][:, None] != tile["vec_id"]
        scores = packed_scores(anchors["values"], tile["values"])
        if self.same:
            found, at = (x[:, None, :] for x in best(scores, take, self.k))
        else:
            found, at = first_below(scores, take, self.low[part], self.high[part], self.k)
        ids = np.where(at < 0, _LONG, tile["vec_id"][at])
        if self.lists is None:
            slots = 1 if self.same else self.low.shape[1]
            self.lists = np.full((n, slots, self.k), _NONE), np.full((n, slots, self.k), _LONG)
        scores = np.concatenate([self.lists[0][part], found], 2)
        ids = np.concatenate([self.lists[1][part], ids], 2)
        order = np.lexsort((ids, ~scores), axis=2)[:, :, :self.k]
        self.lists[0][part] = np.take_along_axis(scores, order, 2)
        self.lists[1][part] = np.take_along_axis(ids, order, 2)

    def result(self, part: int) -> pa.RecordBatch | None:
        self.flush()
        if self.lists is None:
            return None
        scores, ids = self.lists
        anchor, slot, at = np.nonzero(ids != _LONG)
        return pa.RecordBatch.from_pydict({
            "anchor": self.anchors["anchor"][anchor], "slot": slot.astype(np.int32), "vec_id": ids[anchor, slot, at],
            "score": scores[anchor, slot, at], "part": np.full(len(anchor), part, np.int32)})


LISTS = "anchor long, slot int, vec_id long, score long, part int"


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted cells: first the anchors of a block, then the rows that they meet, both in the order of their labels."""
        cell: _Cell | None = None
        waiting = 0
        names = ("block", "dim", "part", "kind", "anchor", "vec_id", "label", "slots")
        for batch in batches:
            block, dim, part, kind, anchor, vec_id, label, slots = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            values, starts = _matrix(batch, dim)
            positive = batch.column("positive").flatten().to_numpy(zero_copy_only=False)
            slot_starts = np.cumsum(slots) - slots
            change = np.flatnonzero(reduce(np.logical_or, (np.diff(x) != 0 for x in (block, dim, part, kind, slots)))) + 1 if len(dim) > 1 else []
            for a, b in zip([0, *change], [*change, len(dim)], strict=True):
                if a == b:
                    continue
                # Anchors with fewer positives have fewer bands: they form a cell of their own.
                key = (int(block[a]), int(dim[a]), int(part[a]))
                if cell is None or cell.key != key:
                    if cell is not None:
                        yield from _given(cell)
                    cell, waiting = _Cells(key, k, same), 0
                piece = {"vec_id": vec_id[a:b], "label": label[a:b], "values": values[starts[a]:starts[a] + (b - a) * dim[a]].reshape(b - a, dim[a])}
                if kind[a] == 0:
                    piece |= {"anchor": anchor[a:b], "positive": positive[slot_starts[a]:slot_starts[a] + (b - a) * slots[a]].reshape(b - a, slots[a])}
                    cell.add_anchors(int(slots[a]), piece)
                else:
                    cell.add_rows(piece)
                    waiting += b - a
                    if waiting >= 1 << TILE_BITS:
                        cell.flush()
                        waiting = 0
        if cell is not None:
            yield from _given(cell)

    return run


class _Cells:
    """One cell for each number of positives that anchors of the block have."""

    def __init__(self, key: tuple, k: int, same: bool):
        self.key, self.k, self.same = key, k, same
        self.cells: dict[int, _Cell] = {}

    def add_anchors(self, slots: int, piece: dict) -> None:
        self.cells.setdefault(slots, _Cell(self.key, self.k, self.same)).pieces.append(piece)

    def add_rows(self, piece: dict) -> None:
        for cell in self.cells.values():
            cell.pending.append(piece)

    def flush(self) -> None:
        for cell in self.cells.values():
            cell.flush()


def _given(cells: _Cells) -> Iterator[pa.RecordBatch]:
    for cell in cells.cells.values():
        found = cell.result(cells.key[2])
        if found is not None:
            yield found


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Every block of anchors with every part of the rows, one cell a task, each sorted for ``_search``."""
    spread = F.xxhash64(F.lit(1), "vec_id", "label", "small", "wide")  # rows of a repeated id go to different cells
    block = F.pmod(F.xxhash64(F.lit(2), "anchor"), F.lit(blocks)).cast("int")
    columns = ["block", "part", "dim", "kind", "anchor", "vec_id", "label", "slots", "positive", "small", "wide"]
    left = anchors.withColumns({"block": block, "kind": F.lit(0)}).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumns({
        "part": F.pmod(spread, F.lit(parts)).cast("int"), "kind": F.lit(1), "anchor": F.lit(0).cast("long"), "slots": F.lit(0),
        "positive": F.array().cast("array<long>")}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (left.select(*columns).unionByName(right.select(*columns))
            .repartitionById(blocks * parts, F.col("block") * parts + F.col("part"))
            .sortWithinPartitions("block", "dim", "part", "kind", "slots", "label", "vec_id"))


def _merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """The parts' lists of each (anchor, slot) to one, in a tree: place (from 1), vec_id, score."""
    level = parts
    while True:
        level = -(-level // MERGE_FAN)
        group = ["anchor", "slot"] if level == 1 else ["anchor", "slot", "part"]
        lists = (lists.withColumn("part", F.floor(F.col("part") / MERGE_FAN).cast("int"))
                 .withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")))
                 .where(F.col("place") <= k))
        if level == 1:
            return lists.select("anchor", "slot", "place", "vec_id", "score")


def hard_negatives(df: DataFrame, n_positives: int = 5, n_negatives: int = 3, anchor_every: int = 50, scale: float = 256.0) -> DataFrame:
    """Rows of another label that score between 50 % and 95 % of an anchor's positive: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``df`` has vec_id and label (integers) and embedding (array of float or double); other columns are ignored.  A
    component x counts as floor(scale * x), a score is the inner product.  Anchors are rows whose id is divisible by
    ``anchor_every``; an anchor's positives are its ``n_positives`` best other rows of its label, and for each of them come
    the ``n_negatives`` best rows of other labels in the band.  Ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part; vectors meet only those of
    their own length (empty ones score 0).  Rows of a repeated id are candidates of their own, though never of an anchor
    with that id; equal rows (id, label and vector) are one anchor.  An anchor without positives, or a positive without
    negatives, gives no row; so does an empty table.  Scores beyond 64 bits end there.

    Anchors are cut into blocks and rows into parts of about a million; a task holds one block and streams its part.
    Every row is copied once per block, the least that a stated query set against all rows takes.  Each product is
    made once: rows of an anchor's own label in the first pass, all others in the second, where the bands are known.
    """
    if min(n_positives, n_negatives, anchor_every) < 1:
        raise ValueError("n_positives, n_negatives and anchor_every must be positive")
    spark = df.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    # floor() of a double gives a long; what lies beyond it is a whole number already.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x))
    small = ~F.exists("whole", lambda x: F.abs(x) > 32767)
    vectors = (df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
               .where(~F.coalesce(bad, F.lit(True)))
               .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("whole"))
               .select("vec_id", "label", F.size("whole").alias("dim"),
                       F.when(small, F.col("whole").cast("array<smallint>")).alias("small"), F.when(~small, F.col("whole")).alias("wide")))
    is_anchor = F.pmod(F.col("vec_id"), F.lit(anchor_every)) == 0
    n_rows, n_anchors = vectors.select(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    blocks = max(1, -(-n_anchors // ANCHOR_BLOCK))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, -(-tasks // blocks), -(-n_rows // CELL_ROWS))
    anchors = (vectors.where(is_anchor).withColumn("anchor", F.xxhash64("vec_id", "label", "small", "wide"))
               .groupBy("anchor").agg(*[F.first(c).alias(c) for c in ("vec_id", "label", "dim", "small", "wide")]))

    alone = anchors.withColumns({"slots": F.lit(0), "positive": F.array().cast("array<long>")})
    found = _grid(alone, vectors, blocks, parts).mapInArrow(_search(n_positives, True), LISTS)
    positives = _merged(found, parts, n_positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))  # n_positives entries at most

    banded = Workspace(spark, "negatives").store("anchors", anchors.join(positives, "anchor").withColumns(
        {"slots": F.size("best"), "positive": F.col("best.score")}))
    found = _grid(banded, vectors, blocks, parts).mapInArrow(_search(n_negatives, False), LISTS)
    own = F.col("best")[F.col("slot")]
    return (_merged(found, parts, n_negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
            .join(banded.select("anchor", F.col("vec_id").alias("anchor_id"), "best"), "anchor")
            .select("anchor_id", own["vec_id"].alias("positive_id"), F.col("place").cast("int").alias("rank"), "negative_id",
                    own["score"].alias("positive_score"), "negative_score"))


def moved_labels(df: DataFrame) -> DataFrame:
    """The table with wrong labels planted: label becomes (label + 1) % 10 where vec_id is divisible by 7."""
    return df.withColumn("label", F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
