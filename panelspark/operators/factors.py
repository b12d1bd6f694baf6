"""Factor returns from cross-sectional ranks, rolling factor loadings, residuals and their checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.evaluation import safe_corr



def market_factor(returns: DataFrame, least: int = 10, x: str = "r") -> DataFrame:
    """Mean return of the members of each bar; null with fewer than ``least``."""
    g = returns.where(F.col(x).isNotNull()).groupBy("timestamp").agg(F.avg(x).alias("_m"), F.count(x).alias("n_members"))
    return g.select("timestamp", F.when(F.col("n_members") >= least, F.col("_m")).alias("market_factor"), "n_members")


def rank_weights(chars: DataFrame, char: str, low_is_long: bool = False, by: str = "date") -> DataFrame:
    """Centred ordinal ranks (ties by symbol), each side scaled to gross one; dates lacking a side give no rows."""
    w = Window.partitionBy(by)
    ranked = chars.where(F.col(char).isNotNull()).withColumn("_n", F.count(char).over(w)).where("_n >= 2")
    sign = -1.0 if low_is_long else 1.0
    raw = sign * (F.row_number().over(w.orderBy(char, "symbol")) - (F.col("_n") + 1) / 2)
    sides = ranked.withColumn("_w", raw).withColumns({"_p": F.sum(F.when(F.col("_w") > 0, F.col("_w"))).over(w), "_q": F.sum(F.when(F.col("_w") < 0, -F.col("_w"))).over(w)})
    return sides.where("_p > 0 and _q > 0").select(by, "symbol", F.when(F.col("_w") > 0, F.col("_w") / F.col("_p")).otherwise(F.col("_w") / F.col("_q")).alias("weight"))


def spread_factor(returns: DataFrame, weights: DataFrame, name: str, by: str = "date", x: str = "r") -> DataFrame:
    """Return of the weighted long side less the short side, each over the names that have a return."""
    j = returns.where(F.col(x).isNotNull()).join(weights, [by, "symbol"])

    def side(long: bool) -> Column:
        on = F.col("weight") > 0 if long else F.col("weight") < 0
        gross = F.sum(F.when(on, F.abs("weight")))
        return F.sum(F.when(on, F.abs("weight") * F.col(x))) / F.when(gross > 0, gross)

    return j.groupBy("timestamp").agg((side(True) - side(False)).alias(name), F.count(x).alias(f"n_{name}"))


def forward_targets(panel: DataFrame, x: str, horizons: dict[str, int]) -> DataFrame:
    """Sums of the next bars of ``x``, null unless all are there."""
    w = Window.partitionBy("symbol").orderBy("timestamp")

    def ahead(p: int) -> Column:
        o = w.rowsBetween(1, p)
        return F.when(F.count(x).over(o) == p, F.sum(x).over(o))

    return panel.withColumns({f"fwd_{x}_{n}": ahead(p) for n, p in horizons.items()})


def exponential_weights(n: int, half_life: float) -> np.ndarray:
    w = np.exp(-np.log(2) / half_life * np.arange(n - 1, -1, -1))
    return w / w.sum()


def weighted_ols(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Loadings (intercept first) and r-squared of a weighted fit, of least norm where it is not unique."""
    w = w * len(w) / w.sum()
    a = np.column_stack([np.ones(len(y)), x])
    s = np.sqrt(w)[:, None]
    b = np.linalg.lstsq(a * s, y * s[:, 0], rcond=None)[0]
    mean = np.average(y, weights=w)
    total = float((w * (y - mean) ** 2).sum())
    r2 = 1 - float((w * (y - a @ b) ** 2).sum()) / total if total > 1e-18 else 0.0
    return b, float(np.clip(r2, 0, 1))


def characteristics(bars: DataFrame, anchors: list[str], x: str = "r", momentum: tuple[int, int, int] = (30, 15, 2), vol: tuple[int, int] = (30, 15), theme: tuple[int, int] = (60, 30)) -> DataFrame:
    """Per (date, symbol), from days strictly before it: momentum, volatility, and likeness to a group of anchor names.

    Momentum sums log returns over a span of days (days, least days with values, days left out before the date);
    volatility is the root of summed squares; likeness correlates market-adjusted daily returns with the anchors' mean.
    Frames count calendar days, so a symbol's gaps hold their place. Without anchors likeness is null.
    """
    c = F.col(x)
    daily = bars.groupBy(F.to_date("timestamp").alias("date"), "symbol").agg(F.sum(F.when(c > -1, F.log1p(c))).alias("_lr"), F.sum(c * c).alias("_sq"))
    across = Window.partitionBy("date")
    daily = daily.withColumns({"_adj": F.col("_lr") - F.avg("_lr").over(across), "_no": F.datediff("date", F.lit("1970-01-01"))})
    daily = daily.withColumn("_anchor", F.avg(F.when(F.col("symbol").isin(anchors), F.col("_adj"))).over(across))

    def before(days: int, skip: int):
        return Window.partitionBy("symbol").orderBy("_no").rangeBetween(-(days + skip - 1), -skip)

    m, v, a = before(momentum[0], max(momentum[2], 1)), before(vol[0], 1), before(theme[0], 1)
    both = F.col("_adj").isNotNull() & F.col("_anchor").isNotNull()
    like = F.corr("_adj", "_anchor").over(a)
    return daily.select(
        "date", "symbol", F.when(F.count("_lr").over(m) >= momentum[1], F.sum("_lr").over(m)).alias("momentum"), F.when(F.count("_sq").over(v) >= vol[1], F.sqrt(F.sum("_sq").over(v))).alias("vol"),
        F.when((F.count(F.when(both, 1)).over(a) >= theme[1]) & ~F.isnan(like), like).alias("likeness"),
    )


def daily_betas(panel: DataFrame, factors: list[str], window: int = 4320, half_life: float = 1440, least: int = 1008, x: str = "r") -> DataFrame:
    """Loadings per (date, symbol) from the ``window`` bars strictly before the date.

    ``panel`` has timestamp, symbol, ``x`` and the factors. Each symbol's history is one group: bars of one
    instrument, never the panel.
    """
    schema = "date date, symbol string, r_squared double, " + ", ".join(f"beta_{f} double" for f in factors)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        y, f = pdf[x].to_numpy(float), pdf[factors].to_numpy(float)
        days = pdf["timestamp"].dt.normalize().to_numpy()
        first = np.flatnonzero(np.concatenate([[True], days[1:] != days[:-1]]))
        out = []
        for i in first:
            lo = max(0, i - window)
            ok = np.isfinite(y[lo:i]) & np.isfinite(f[lo:i]).all(axis=1)
            if i - lo >= least and ok.sum() >= least:
                b, r2 = weighted_ols(y[lo:i][ok], f[lo:i][ok], exponential_weights(i - lo, half_life)[ok])
                out.append((pd.Timestamp(days[i]).date(), pdf["symbol"].iloc[0], r2, *b[1:]))
        return pd.DataFrame(out, columns=["date", "symbol", "r_squared", *[f"beta_{f}" for f in factors]])

    return panel.select("timestamp", "symbol", x, *factors).groupBy("symbol").applyInPandas(fit, schema)


def residuals(panel: DataFrame, betas: DataFrame, factors: list[str], x: str = "r") -> DataFrame:
    """Return less the loadings times the factors; the intercept stays in; null without loadings."""
    dated = panel.withColumn("date", F.to_date("timestamp")).join(betas, ["date", "symbol"], "left")
    explained = sum((F.col(f"beta_{f}") * F.col(f) for f in factors), F.lit(0.0))
    return dated.withColumn("residual_return", F.col(x) - explained)


def acceptance(panel: DataFrame, x: str = "r", residual: str = "residual_return", factor: str = "market_factor") -> DataFrame:
    """Per symbol: residual over raw variance, and the residual's correlation with the factor."""
    return panel.groupBy("symbol").agg((F.var_samp(residual) / F.nullif(F.var_samp(x), F.lit(0.0))).alias("variance_ratio"), safe_corr(residual, factor).alias("factor_corr"), F.count(residual).alias("n"))


def vif(factor_returns: DataFrame, factors: list[str], least: int = 100) -> dict[str, float]:
    """Variance inflation of each factor: the diagonal of the inverse correlation matrix."""
    if len(factors) < 2:
        return {}
    rows = factor_returns.select(*factors).na.drop()
    pairs = [safe_corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(factors) for j, b in enumerate(factors)]
    got = rows.agg(F.count("*").alias("n"), *pairs).first()
    if got["n"] < least:
        return {}
    c = np.array([[got[f"{i}_{j}"] for j in range(len(factors))] for i in range(len(factors))], float)
    try:
        return dict(zip(factors, map(float, np.diag(np.linalg.inv(c)))))
    except np.linalg.LinAlgError:
        return dict.fromkeys(factors, float("inf"))
