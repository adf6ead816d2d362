"""What a factor is: a named window formula with declared inputs and look-back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.series import Series

Rule = Callable[..., Column]


@dataclass(frozen=True)
class Factor:
    """``rule(series, lookback, *inputs)`` returns the factor value; inputs are column names."""

    name: str
    category: str
    inputs: tuple[str, ...]
    lookback: int
    rule: Rule
    version: str = "1.0.0"
    group: str = "alpha"
    prediction_horizon: int = 1
    enabled: bool = True
    status: str = "ACTIVE"

    def formula(self, series: Series, inputs: tuple[str, ...] | None = None) -> Column:
        return self.rule(series, self.lookback, *(inputs or self.inputs))


def simple_return(s: Series, close: str) -> str:
    s.lag(close)
    return s.let(f"_ret_{close}", F.try_divide(F.col(close), s.lag(close)) - 1, close, f"_lag1_{close}")


def log_of(s: Series, x: str) -> str:
    return s.let(f"_ln_{x}", F.ln(x), x)


def true_range(s: Series, high: str, low: str, close: str) -> str:
    previous = s.lag(close)
    return s.let(
        f"_tr_{close}",
        F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - previous), F.abs(F.col(low) - previous)),
        high, low, close, f"_lag1_{close}",
    )


def difference(s: Series, a: str, b: str) -> str:
    return s.let(f"_diff_{a}_{b}", F.col(a) - F.col(b), a, b)
