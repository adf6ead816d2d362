"""Rolling expressions over time series.

A :class:`Series` gathers the window columns that a set of formulas needs, level by level, so that
all formulas of a stage run off one shuffle and one sort, and each rolling aggregate is computed
once however many formulas use it.  A formula is a function ``(Series) -> Column``; it asks for
rolling columns by name and combines them with ordinary column arithmetic.

Rolling results are null until the window holds ``n`` non-null values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES_KEYS = ("symbol", "timeframe", "year")
EWM_BLOCK = 256
EWM_GROUP = 64  # blocks whose end values are carried into one group value


class Series:
    """Collects the intermediate columns of formulas over one series layout."""

    def __init__(self, keys: Iterable[str] = SERIES_KEYS, order: str = "open_time"):
        self.keys = tuple(keys)
        self.order = order
        self._level: dict[str, int] = {}
        self._window: dict[int, dict[str, Column]] = {}
        self._row: dict[int, dict[str, Column]] = {}

    # -- window frames -----------------------------------------------------------------
    @property
    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def frame(self, n: int, end: int = 0):
        return self.ordered.rowsBetween(end - n + 1, end)

    @property
    def running(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # -- registration ------------------------------------------------------------------
    def _depth(self, names: Iterable[str]) -> int:
        return max((self._level.get(name, 0) for name in names), default=0)

    def let(self, name: str, expr: Column, *uses: str) -> str:
        """Name a row-wise expression over columns or earlier intermediates."""
        if name not in self._level:
            depth = self._depth(uses)
            self._level[name] = depth
            self._row.setdefault(depth, {})[name] = expr
        return name

    def over(self, name: str, expr: Column, *uses: str) -> Column:
        """Name a window expression over columns or earlier intermediates."""
        if name not in self._level:
            depth = self._depth(uses) + 1
            self._level[name] = depth
            self._window.setdefault(depth, {})[name] = expr
        return F.col(name)

    # -- rolling vocabulary ------------------------------------------------------------
    def index(self) -> Column:
        return self.over("_t", F.row_number().over(self.ordered))

    def lag(self, x: str, n: int = 1) -> Column:
        return self.over(f"_lag{n}_{x}", F.lag(x, n).over(self.ordered), x)

    def full(self, x: str, n: int, end: int = 0) -> Column:
        name = f"_full{n}_{x}" + (f"_to{-end}" if end else "")
        return self.over(name, F.count(x).over(self.frame(n, end)) == n, x)

    def _rolling(self, tag: str, agg: Column, x: str, n: int, end: int = 0) -> Column:
        name = f"_{tag}{n}_{x}" + (f"_to{-end}" if end else "")
        return F.when(self.full(x, n, end), self.over(name, agg.over(self.frame(n, end)), x))

    def mean(self, x: str, n: int) -> Column:
        return self._rolling("mean", F.avg(x), x, n)

    def sum(self, x: str, n: int) -> Column:
        return self._rolling("sum", F.sum(x), x, n)

    def max(self, x: str, n: int, end: int = 0) -> Column:
        return self._rolling("max", F.max(x), x, n, end)

    def min(self, x: str, n: int) -> Column:
        return self._rolling("min", F.min(x), x, n)

    def std_pop(self, x: str, n: int) -> Column:
        return self._rolling("sdp", F.stddev_pop(x), x, n)

    def std_samp(self, x: str, n: int) -> Column:
        return self._rolling("sds", F.stddev_samp(x), x, n)

    def median(self, x: str, n: int) -> Column:
        return self._rolling("med", F.percentile(x, F.lit(0.5)), x, n)

    def slope(self, x: str, n: int) -> Column:
        """Least-squares slope of x on the bar index over the last n bars."""
        self.index()
        value = self.over(f"_slope{n}_{x}", F.regr_slope(F.col(x), F.col("_t")).over(self.frame(n)), x, "_t")
        return F.when(self.full(x, n), value)

    def sum_squares_about_mean(self, x: str, n: int) -> Column:
        return F.when(self.full(x, n), self.over(f"_varp{n}_{x}", F.var_pop(x).over(self.frame(n)), x) * n)

    def covariance(self, x: str, y: str, n: int) -> Column:
        both = self.full(x, n) & self.full(y, n)
        return F.when(both, self.over(f"_cov{n}_{x}_{y}", F.covar_pop(x, y).over(self.frame(n)), x, y))

    def zscore(self, x: str, n: int) -> Column:
        """Deviation from the rolling mean in population deviations; 0.0 in a constant window."""
        sd = self.std_pop(x, n)
        return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(x) - self.mean(x, n), sd))

    def mean_abs_deviation(self, x: str, n: int) -> Column:
        values = self.over(f"_win{n}_{x}", F.collect_list(x).over(self.frame(n)), x)
        centre = self.mean(x, n)
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v - centre))
        return F.when(self.full(x, n), total / n)

    def running_sum(self, x: str) -> Column:
        """Cumulative sum; null where x itself is null."""
        total = self.over(f"_cum_{x}", F.sum(x).over(self.running), x)
        return F.when(F.col(x).isNotNull(), total)

    def ewm(self, x: str, alpha: float, min_samples: int) -> Column:
        """Recursive exponentially weighted mean, ``y = (1-alpha)*y + alpha*x``, seeded by the first value.

        x may be null at the start of a series, not inside it.  The recurrence is unrolled in
        blocks: a scaled running sum inside the block, plus what the earlier blocks of its group
        carry, plus what all earlier groups carry.  No history is dropped; each window holds one
        block, the block ends of one group, or the group ends of the series.
        """
        keep = 1.0 - alpha
        # Inside a block values are scaled by up to keep ** -block, which must stay a finite double.
        block_rows = max(1, min(EWM_BLOCK, int(250 / max(-math.log10(keep), 1e-9)))) if keep > 0 else 1
        tag = f"{x}_{alpha:.6f}".replace(".", "_")
        self.index()
        seen = self.over(f"_seen_{x}", F.count(x).over(self.running), x)
        block = self.let(f"_ewm_block{block_rows}", F.floor((F.col("_t") - 1) / block_rows), "_t")
        group = self.let(f"_ewm_group{block_rows}", F.floor(F.col(block) / EWM_GROUP), block)
        place = self.let(f"_ewm_place{block_rows}", F.pmod(F.col("_t") - 1, F.lit(block_rows)), "_t")
        slot = self.let(f"_ewm_slot{block_rows}", F.pmod(F.col(block), F.lit(EWM_GROUP)), block)
        scaled = F.when(seen == 1, F.col(x)).when(seen > 1, F.col(x) * alpha).otherwise(0.0)
        feed = self.let(f"_feed_{tag}", scaled * F.pow(F.lit(keep), -F.col(place)) if block_rows > 1 else scaled, x, f"_seen_{x}", place)
        in_block = Window.partitionBy(*self.keys, block).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        self.over(f"_local_raw_{tag}", F.sum(feed).over(in_block), feed, block)
        local = self.let(
            f"_local_{tag}", F.col(f"_local_raw_{tag}") * F.pow(F.lit(keep), F.col(place)), f"_local_raw_{tag}", place
        )
        # Only the last bar of a block carries its local value; nulls drop out of collect_list.
        end = self.let(f"_end_{tag}", F.when(F.col(place) == block_rows - 1, F.col(local)), local, place)
        in_group = Window.partitionBy(*self.keys, group).orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
        self.over(f"_ends_{tag}", F.collect_list(end).over(in_group), end, block, group)

        def carried(values: Column, factor: float) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda acc, v: acc * F.lit(factor) + v)

        near = self.let(f"_near_{tag}", carried(F.col(f"_ends_{tag}"), keep**block_rows), f"_ends_{tag}")
        whole = self.let(
            f"_whole_{tag}",
            F.when(F.col(slot) == EWM_GROUP - 1, F.col(end) + F.col(near) * F.lit(keep**block_rows)), near, end, slot)
        over_groups = Window.partitionBy(*self.keys).orderBy(group).rangeBetween(Window.unboundedPreceding, -1)
        self.over(f"_wholes_{tag}", F.collect_list(whole).over(over_groups), whole, group)
        far = carried(F.col(f"_wholes_{tag}"), keep ** (block_rows * EWM_GROUP)) * F.pow(F.lit(keep), F.col(slot) * block_rows)
        value = F.col(local) + (F.col(near) + far) * F.pow(F.lit(keep), F.col(place) + 1)
        name = self.let(f"_ewm_{tag}", value, local, near, f"_wholes_{tag}", place, slot)
        return F.when((seen >= min_samples) & F.col(x).isNotNull(), F.col(name))

    # -- evaluation --------------------------------------------------------------------
    def attach(self, df: DataFrame) -> DataFrame:
        """Add every registered intermediate, lowest level first."""
        for depth in sorted(set(self._window) | set(self._row)):
            if self._window.get(depth):
                df = df.select("*", *[e.alias(n) for n, e in self._window[depth].items()])
            # Row-wise names of one level may build on each other.
            for name, expr in self._row.get(depth, {}).items():
                df = df.withColumn(name, expr)
        return df


Formula = Callable[[Series], Column]


def evaluate(df: DataFrame, formulas: dict[str, Formula], keep: Iterable[str], keys=SERIES_KEYS) -> DataFrame:
    """Evaluate named formulas side by side; returns ``keep`` plus one double column per formula."""
    series = Series(keys)
    values = {name: formula(series) for name, formula in formulas.items()}
    staged = series.attach(df)
    return staged.select(*keep, *[v.cast("double").alias(n) for n, v in values.items()])


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def split_series(df: DataFrame, reach: int, rows_per_part: int, keys: Iterable[str] = SERIES_KEYS) -> DataFrame:
    """Cut every series into parts of ``rows_per_part`` rows, each led by the ``reach`` rows before it.

    Adds ``_part`` and ``_carried`` (true on the leading copies).  A row lands in at most two parts.
    """
    from barloom.functions.clock import timeframe_ms
    from barloom.functions.stats import with_row_index

    if reach > rows_per_part:
        raise ValueError("a part must hold at least as many rows as windows reach back")
    bucket = F.floor(F.col("open_time") / (timeframe_ms(F.col("timeframe")) * rows_per_part))
    indexed = with_row_index(df.withColumn("_bucket", bucket), list(keys), "_bucket", ["open_time"], "_row")
    part = F.floor(F.col("_row") / rows_per_part)
    near_end = F.pmod(F.col("_row"), F.lit(rows_per_part)) >= rows_per_part - reach
    places = F.when(
        near_end,
        F.array(F.struct(part.alias("_part"), F.lit(False).alias("_carried")), F.struct((part + 1).alias("_part"), F.lit(True).alias("_carried"))),
    ).otherwise(F.array(F.struct(part.alias("_part"), F.lit(False).alias("_carried"))))
    return indexed.withColumn("_place", F.explode(places)).select(*df.columns, "_place.*")


def across_parts(df: DataFrame, keys: Iterable[str], part: str, x: str, name: str, order: str = "open_time", ahead: bool = False) -> DataFrame:
    """``x`` of the row before (``ahead``: after) in the series, also where that row is in another part.

    A window covers one part of a series, a stored year for instance; over a border goes one value per part.  A row
    with a null key has no neighbour in another part.
    """
    keys = list(keys)
    move, edge = (F.lead, F.min_by(x, order)) if ahead else (F.lag, F.max_by(x, order))
    own = Window.partitionBy(*keys, part).orderBy(order)
    edges = df.groupBy(*keys, part).agg(edge.alias("_edge")).withColumn("_edge", move("_edge").over(Window.partitionBy(*keys).orderBy(part)))
    inside = df.select("*", move(x).over(own).alias("_inside"), move(F.lit(True)).over(own).isNull().alias("_border"))
    return inside.join(edges, [*keys, part], "left").select(
        *[F.col(c) for c in df.columns], F.when(F.col("_border"), F.col("_edge")).otherwise(F.col("_inside")).alias(name))


def total_across_parts(df: DataFrame, keys: Iterable[str], part: str, x: str, name: str, order: str = "open_time") -> DataFrame:
    """Running sum of ``x`` over a whole series, null where ``x`` is; each part adds to the total that the ones before hand over."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    handed = df.groupBy(*keys, part).agg(F.sum(x).alias("_total")).select(*keys, part, F.sum("_total").over(before).alias("_before"))
    own = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = df.withColumn("_inside", F.sum(x).over(own))
    total = F.when(F.col(x).isNotNull(), F.coalesce("_before", F.lit(0.0)) + F.col("_inside"))
    return inside.join(handed, [*keys, part], "left").select(*[F.col(c) for c in df.columns], total.alias(name))
