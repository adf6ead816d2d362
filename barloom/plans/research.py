"""The research pipeline: bars and companions to a validated, selected, combined alpha table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barloom.functions.clock import with_year
from barloom.operators import combination, factor_tests, folds, selection
from barloom.operators.asof import factor_inputs
from barloom.operators.cleaning import clean
from barloom.operators.factors import CATALOG, factor_frame, factor_long
from barloom.operators.labels import label_frame
from barloom.operators.panel import evaluation_panel, validation_panel

from .stages import StageStore


@dataclass
class ResearchTables:
    """Raw inputs of a run."""

    bars: DataFrame
    funding: DataFrame
    open_interest: DataFrame
    taker_volume: DataFrame
    long_short: DataFrame


@dataclass
class ResearchRun:
    """Every stage as a stored table; a stage is computed when it is first asked for."""

    store: StageStore
    raw: ResearchTables
    factors: list[str] = field(default_factory=lambda: list(CATALOG))
    top_n: int = selection.TOP_N
    candidate_n: int = selection.CANDIDATE_N

    def bars(self) -> DataFrame:
        return self.store.table("bars", lambda: with_year(clean(self.raw.bars, "ohlcv")))

    def inputs(self) -> DataFrame:
        r = self.raw
        parts = [clean(df, name) for name, df in (
            ("funding", r.funding), ("open_interest", r.open_interest), ("taker_volume", r.taker_volume), ("long_short", r.long_short))]
        return self.store.table("inputs", lambda: factor_inputs(self.bars(), *parts))

    def panel(self) -> DataFrame:
        chosen = [CATALOG[n] for n in self.factors]
        return self.store.table("panel", lambda: factor_long(factor_frame(self.inputs(), chosen)))

    def labelled(self) -> DataFrame:
        return self.store.table("labelled", lambda: validation_panel(self.panel(), label_frame(self.bars())))

    def validation(self) -> DataFrame:
        return self.store.table("validation", lambda: factor_tests.factor_validation(self.labelled()))

    def selection(self) -> DataFrame:
        def build() -> DataFrame:
            scored = selection.factor_selection(self.validation(), self.top_n, self.candidate_n)
            return selection.redundancy_filter(scored, self.panel(), self.top_n, self.candidate_n)

        return self.store.table("selection", build)

    def combinations(self) -> DataFrame:
        return self.store.table("combinations", lambda: combination.combinations(selection.timeframe_analysis(self.selection())))

    def orthogonal(self) -> DataFrame:
        return self.store.table("orthogonal", lambda: combination.orthogonal_combinations(self.combinations(), self.panel()))

    def alpha(self) -> DataFrame:
        return self.store.table("alpha", lambda: combination.alpha_scores(self.orthogonal(), self.panel()))

    def fold_rows(self) -> DataFrame:
        return self.store.table("fold_rows", lambda: folds.indexed(evaluation_panel(self.labelled(), self.selection())))

    def walk_forward(self) -> DataFrame:
        return self.store.table("walk_forward", lambda: folds.walk_forward(folds.fold_metrics(self.fold_rows())))

    def purged(self) -> DataFrame:
        return self.store.table("purged", lambda: folds.purged_folds(folds.purged_membership(self.walk_forward())))
