"""Staged column formulas: SQL text that Catalyst plans, and that any ANSI engine can run as a check.

A formula is a list of stages; a stage adds columns that the next may use. Stages keep window expressions
out of one another, so each axis (a symbol's history, a timestamp's cross-section) is sorted once for all
expressions of a stage. ``apply`` adds the columns to a DataFrame; ``sql`` renders the same stages as
nested queries.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    stages: tuple[Mapping[str, str], ...]
    outputs: tuple[str, ...]
    keys: tuple[str, ...] = ("timestamp", "symbol")
    digits: Mapping[str, int] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = df.select("*", *[F.expr(text).alias(name) for name, text in stage.items()])
        return df

    def result(self, df: DataFrame, default: int = 6) -> DataFrame:
        """Keys and rounded outputs."""
        return self.apply(df).select(*self.keys, *[F.expr(f"round({c}, {self.digits.get(c, default)})").alias(c) for c in self.outputs])

    def sql(self, source: str, default: int = 6) -> str:
        query = f"SELECT * FROM {source}"
        for stage in self.stages:
            query = f"SELECT *, {', '.join(f'{text} AS {name}' for name, text in stage.items())} FROM ({query})"
        query = query.replace("weekday(timestamp)", "(isodow(timestamp) - 1)")  # Monday is 0
        return f"SELECT {', '.join(self.keys)}, {', '.join(f'round({c}, {self.digits.get(c, default)}) AS {c}' for c in self.outputs)} FROM ({query})"

    def __add__(self, other: Formula) -> Formula:
        """Both formulas, stage by stage; a column that both define is defined once."""
        depth, known, stages = max(len(self.stages), len(other.stages)), set(), []
        for i in range(depth):
            merged: dict[str, str] = {}
            for f in (self, other):
                if i < len(f.stages):
                    merged |= {k: v for k, v in f.stages[i].items() if k not in known}
            known |= set(merged)
            stages.append(merged)
        return Formula(tuple(stages), tuple(dict.fromkeys(self.outputs + other.outputs)), self.keys, {**self.digits, **other.digits})


def over(frame: str, by: str = "symbol", order: str = "timestamp") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} {frame})"


def rows(w: int) -> str:
    return f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW"


def roll(call: str, counted: str, w: int, m: int | None = None, by: str = "symbol") -> str:
    """An aggregate over the last ``w`` rows, NULL with fewer than ``m`` values of ``counted``."""
    o = over(rows(w), by)
    return f"CASE WHEN count({counted}) {o} >= {w if m is None else m} THEN {call} {o} END"


def mean(x: str, w: int, m: int | None = None, by: str = "symbol") -> str:
    return roll(f"avg({x})", x, w, m, by)


def total(x: str, w: int, m: int | None = None, by: str = "symbol") -> str:
    return roll(f"sum({x})", x, w, m, by)


def least(x: str, w: int, m: int | None = None) -> str:
    return roll(f"min({x})", x, w, m)


def most(x: str, w: int, m: int | None = None) -> str:
    return roll(f"max({x})", x, w, m)


def std(x: str, w: int, m: int | None = None, by: str = "symbol") -> str:
    return roll(f"stddev_samp({x})", x, w, m, by)


def var(x: str, w: int, m: int | None = None) -> str:
    return roll(f"var_samp({x})", x, w, m)


def both(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END"


def corr(x: str, y: str, w: int, m: int | None = None) -> str:
    """Pairwise correlation; ``m`` counts rows where both are there. NULL where either does not vary."""
    o = over(rows(w))
    spread = " * ".join(f"stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) {o}" for a, b in ((x, y), (y, x)))
    return f"CASE WHEN count({both(x, y)}) {o} >= {w if m is None else m} THEN covar_pop({x}, {y}) {o} / nullif({spread}, 0) END"


def cov(x: str, y: str, w: int, m: int | None = None) -> str:
    return roll(f"covar_samp({x}, {y})", both(x, y), w, m)


def beta(y: str, x: str, w: int, m: int | None = None, eps: str = "1e-18") -> str:
    """Pairwise covariance over the variance of all values of ``x``."""
    return f"({cov(y, x, w, m)}) / (({var(x, w, m)}) + {eps})"


def lag(x: str, k: int = 1, by: str = "symbol") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {by} ORDER BY timestamp)"


def forward_sum(x: str, p: int) -> str:
    """Sum of the next ``p`` rows; NULL unless all have values."""
    o = over(f"ROWS BETWEEN 1 FOLLOWING AND {p} FOLLOWING")
    return f"CASE WHEN count({x}) {o} = {p} THEN sum({x}) {o} END"


def running(call: str, by: str = "symbol") -> str:
    return f"{call} {over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', by)}"


def change(x: str, k: int = 1) -> str:
    return f"{x} / nullif({lag(x, k)}, 0) - 1"


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def root(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"


def clip(x: str, low: str | None = None, high: str | None = None) -> str:
    inner = x
    if low is not None:
        inner = f"greatest({inner}, {low})"
    if high is not None:
        inner = f"least({inner}, {high})"
    return f"CASE WHEN {x} IS NOT NULL THEN {inner} END"


def flag(condition: str) -> str:
    """1 where the condition holds, 0 where it is false or unknown."""
    return f"CASE WHEN {condition} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def across(call: str, by: str = "timestamp") -> str:
    return f"{call} OVER (PARTITION BY {by})"


def average_rank(x: str, by: str = "timestamp") -> str:
    """Rank among the values of a cross-section, ties sharing their mean; NULL for NULL."""
    group = f"{by}, CASE WHEN {x} IS NULL THEN 1 ELSE 0 END"
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / CAST(2 AS DOUBLE) END"


def percent_rank(x: str, by: str = "timestamp") -> str:
    """Average rank over the number of values."""
    return f"({average_rank(x, by)}) / nullif({across(f'count({x})', by)}, 0)"


def cross_z(x: str, by: str = "timestamp", eps: str = "1e-10") -> str:
    return f"({x} - {across(f'avg({x})', by)}) / ({across(f'stddev_samp({x})', by)} + {eps})"


def cross_demean(x: str, by: str = "timestamp") -> str:
    return f"{x} - {across(f'avg({x})', by)}"


def chain(formulas: Iterable[Formula]) -> Formula:
    out = None
    for f in formulas:
        out = f if out is None else out + f
    return out
