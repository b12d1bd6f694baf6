"""Portfolio construction on small matrices, and a sequential backtest as one grouped map per window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def steadied_covariance(returns: np.ndarray, weight: float | None = None, least: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Covariance of the columns with at least ``least`` values, and which these are; gaps count as zero.

    Without ``weight`` the sample (over t rows) is drawn to a multiple of the identity as far as Ledoit and
    Wolf's estimate says; with it, the sample (over t - 1) is drawn to its own diagonal by that share. A
    small ridge keeps it definite.
    """
    keep = np.isfinite(returns).sum(axis=0) >= least
    x = np.where(np.isfinite(returns[:, keep]), returns[:, keep], 0.0)
    t, n = x.shape
    if not n:
        return np.zeros((0, 0)), keep
    x = x - x.mean(axis=0)
    if weight is None:
        s = x.T @ x / t
        level = np.trace(s) / n
        gap = ((s - level * np.eye(n)) ** 2).sum()
        noise = (((x**2).sum(axis=1) ** 2).sum() / t - (s**2).sum()) / t
        share = min(max(noise, 0.0), gap) / gap if gap > 0 else 0.0
        out = (1 - share) * s + share * level * np.eye(n)
    else:
        s = x.T @ x / max(t - 1, 1)
        out = (1 - weight) * s + weight * np.diag(np.diag(s))
    return out + np.eye(n) * (1e-12 + 1e-6 * np.trace(out) / n), keep


def project_out(w: np.ndarray, loadings: np.ndarray, bands: np.ndarray | float = 0.0) -> np.ndarray:
    """Nearest weights whose exposure to each column of ``loadings`` lies within its band."""
    if not loadings.size:
        return w
    now = loadings.T @ w
    over = now - np.clip(now, -np.abs(bands), np.abs(bands))
    return w - loadings @ np.linalg.lstsq(loadings.T @ loadings, over, rcond=None)[0]


def _limited(w: np.ndarray, loadings: np.ndarray, bands: np.ndarray | float, cap: float, gross: float, rounds: int) -> np.ndarray:
    """Weights of ``gross`` in all, drawn into the cap (a share of gross) and then into the bands, in turn.

    Clipping stops a little inside the cap, so the last scaling to ``gross`` does not leave it.
    """
    inside = 0.999 * cap * gross
    for _ in range(rounds):
        size = np.abs(w).sum()
        if size < 1e-15:
            return np.zeros_like(w)
        before = w * gross / size
        w = project_out(np.clip(before, -inside, inside), loadings, bands)
        if np.abs(w - before).max() < 1e-10:
            break
    size = np.abs(w).sum()
    return w * gross / size if size > 1e-15 else w


def _columns(loadings: np.ndarray, bands) -> tuple[np.ndarray, np.ndarray]:
    """Columns that load on anything, gaps as zero, and their bands."""
    a = np.nan_to_num(np.asarray(loadings, float))
    live = np.sqrt((a**2).sum(axis=0)) > 1e-12 if a.size else np.zeros(a.shape[1] if a.ndim == 2 else 0, bool)
    b = np.zeros(len(live)) if bands is None else np.broadcast_to(np.abs(np.asarray(bands, float)), len(live))
    return a[:, live], b[live]


def mean_variance(alpha: np.ndarray, cov: np.ndarray, loadings: np.ndarray, cap: float, gross: float, rounds: int = 10, bands=None) -> np.ndarray:
    """Weights for ``alpha`` with exposures within bands (neutral without them), a cap per name, and ``gross``.

    The neutral optimum has a closed form; cap and bands are then imposed in turn.
    """
    a, b = _columns(loadings, bands)
    inv = np.linalg.solve(cov, np.column_stack([alpha, a]))
    w = inv[:, 0]
    if a.shape[1]:
        w = w - inv[:, 1:] @ np.linalg.lstsq(a.T @ inv[:, 1:], a.T @ w, rcond=None)[0]
    return _limited(w, a, b, cap, gross, rounds) if np.abs(w).sum() >= 1e-15 else np.zeros(len(alpha))


def rank_book(alpha: np.ndarray, loadings: np.ndarray, cap: float, gross: float, rounds: int = 10, bands=None) -> np.ndarray:
    """Centred ranks, ties sharing theirs, under the limits of ``mean_variance``; names without alpha get nothing."""
    known = np.isfinite(alpha)
    out = np.zeros(len(alpha))
    if known.any():
        a, b = _columns(np.asarray(loadings, float)[known], bands)
        rank = pd.Series(alpha[known]).rank().to_numpy()
        out[known] = _limited(rank - rank.mean(), a, b, cap, gross, rounds)
    return out


def clusters(corr: np.ndarray, cut: float = 0.3, least: int = 3) -> np.ndarray:
    """Average-linkage clusters of names joined while their mean correlation is at least ``cut``; -1 for small ones."""
    n = len(corr)
    groups = {i: [i] for i in range(n)}
    total = np.where(np.isfinite(corr), corr, 0.0).astype(float)
    size = np.ones(n)
    alive = list(range(n))
    while len(alive) > 1:
        a = np.array(alive)
        means = total[np.ix_(a, a)] / np.outer(size[a], size[a])
        np.fill_diagonal(means, -np.inf)
        i, j = np.unravel_index(np.argmax(means), means.shape)
        if means[i, j] < cut:
            break
        p, q = sorted((alive[i], alive[j]))
        total[p] += total[q]
        total[:, p] += total[:, q]
        size[p] += size[q]
        groups[p] += groups.pop(q)
        alive.remove(q)
    out = np.full(n, -1)
    for k, members in enumerate(sorted((g for g in groups.values() if len(g) >= least), key=min)):
        out[members] = k
    return out


def cluster_penalty(labels: np.ndarray, scale: float) -> np.ndarray:
    """Positive semi-definite penalty on each cluster's net weight."""
    out = np.zeros((len(labels), len(labels)))
    for k in set(labels[labels >= 0].tolist()):
        one = (labels == k).astype(float)
        out += scale * np.outer(one, one) / one.sum()
    return out


def trade_rate(cost_bps: float, urgency: float | None, reference_bps: float | None = None, half_life: float = 6.0) -> float:
    """Share of the gap to the aim that is traded per bar: omega / (1 + omega), omega falling with the cost.

    Without an urgency, the rate whose gap halves every ``half_life`` bars.
    """
    if urgency is None:
        return float(1 - 0.5 ** (1 / max(half_life, 1e-9)))
    omega = urgency * (cost_bps if reference_bps is None else reference_bps) / max(cost_bps, 1e-9)
    return float(omega / (1 + omega))


def captured_share(ks: Sequence[int], curve: Sequence[float | None], peak: int | None, rate: float) -> float | None:
    """Share of a measured response that a book filling at ``rate`` a bar earns, up to the peak.

    Each increment of the curve is earned with the exposure reached midway to it. None if nothing can be said.
    """
    if not len(ks) or len(ks) != len(curve) or not 0 < rate <= 1:
        return None
    last = int(peak or ks[-1])
    points = [(0, 0.0), *((int(k), float(a)) for k, a in zip(ks, curve) if a is not None and np.isfinite(a) and k <= last)]
    top = points[-1][1]
    if len(points) == 1 or top <= 0:
        return None
    earned = sum((1 - (1 - rate) ** max((k + j) / 2, 1.0)) * (a - b) for (j, b), (k, a) in zip(points, points[1:]))
    return float(min(1.0, max(0.0, earned / top)))


def holding_bars(lag: float, turnover: float | None, most: float = 1008.0) -> float:
    """Bars that a position is held: the lag over the turnover per lag (2 at most), up to ``most``."""
    lag = max(float(lag), 1.0)
    if turnover is None or not np.isfinite(turnover) or turnover <= 0:
        return lag
    return float(min(lag / min(turnover, 2.0), max(most, lag / 2)))


def edge_gross(edge: Column, cost: Column, times: float = 1.0, least: float = 0.0) -> Column:
    """Gross multiplier: edge over ``times`` the round-trip cost, within 0 and 1, and 0 below ``least``; 1 where trading is free."""
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.0), edge / (cost * times)))
    return F.when(cost <= 0, F.lit(1.0)).when(m >= least, m).otherwise(F.lit(0.0))


def liquidity_multipliers(adv: Column, *by: str, impact: float = 0.25, cost: tuple[float, float] = (0.5, 3.0), power: float = 0.5, speed: tuple[float, float] = (0.25, 2.0)) -> tuple[Column, Column]:
    """Multipliers of a name's cost and trading speed from its volume beside the cross-section's median; 1 where there is none."""
    traded = F.when(adv > 0, adv)
    middle = F.median(traded).over(Window.partitionBy(*by))

    def held(x: Column, low: float, high: float) -> Column:
        return F.when(traded.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))).otherwise(F.lit(1.0))

    return held(1 + impact * (middle / traded - 1), *cost), held(F.pow(traded / middle, F.lit(power)), *speed)


def participation_cap(volume: Column, share: float, book: float) -> Column:
    """Largest weight change in a bar that stays within a share of the name's volume."""
    return F.coalesce(F.greatest(volume, F.lit(0.0)) * share / book, F.lit(0.0))


def controlled(scores: DataFrame, control: str, x: str = "score", seed: int = 0) -> DataFrame:
    """Null controls: negated scores, scores dealt anew within each stamp, or noise."""
    if control == "sign_flip":
        return scores.withColumn(x, -F.col(x))
    draw = F.xxhash64(F.lit(seed), "timestamp", "symbol")
    if control == "random":
        u = (F.pmod(draw, F.lit(1 << 24)) + 0.5) / (1 << 24)
        v = (F.pmod(F.xxhash64(F.lit(seed + 1), "timestamp", "symbol"), F.lit(1 << 24)) + 0.5) / (1 << 24)
        return scores.withColumn(x, F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v))
    if control != "shuffle":
        raise ValueError(f"unknown control: {control}")
    w = Window.partitionBy("timestamp")
    tagged = scores.withColumns({"_a": F.row_number().over(w.orderBy("symbol")), "_b": F.row_number().over(w.orderBy(draw, "symbol"))})
    dealt = tagged.select("timestamp", F.col("_b").alias("_a"), F.col(x).alias("_x"))
    return tagged.drop("_b", x).join(dealt, ["timestamp", "_a"]).withColumnRenamed("_x", x).drop("_a").select(*scores.columns)


def composite(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of signals (a missing one adds nothing unless all are missing), standardised per stamp, clipped at 3."""
    some = F.coalesce(*[F.col(c) for c in weights]).isNotNull()
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    t = signals.withColumn("_s", F.when(some, total)).where(F.col("_s").isNotNull())
    w = Window.partitionBy("timestamp")
    z = (F.col("_s") - F.avg("_s").over(w)) / (F.stddev_samp("_s").over(w) + 1e-10)
    return t.withColumn("score", F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))).select("timestamp", "symbol", "score")


@dataclass(frozen=True)
class BookConfig:
    """Limits and rates of a book. ``loadings`` are panel columns whose exposures stay within ``bands`` (the first band is the net's)."""

    cap: float = 0.1
    gross: float = 1.0
    cost_bps: float = 5.0
    reference_bps: float = 5.0
    urgency: float | None = 0.5
    half_life: float = 6.0
    covariance_bars: int = 144
    least_bars: int = 100
    rebalance: int = 6
    edge_times: float = 0.0
    edge_least: float = 0.0
    participation: float = 0.1
    book: float = 1e6
    volume_bars: int = 144
    impact: float = 0.0
    speed_power: float = 0.0
    cluster_scale: float = 0.0
    cluster_cut: float = 0.3
    loadings: tuple[str, ...] = ()
    bands: tuple[float, ...] = (0.0,)


BACKTEST = "window long, timestamp timestamp_ntz, gross_return double, funding double, cost double, net_return double, turnover double, gross_exposure double, net_exposure double, n_positions long"


def _ratio_to_middle(volume: np.ndarray) -> np.ndarray:
    ok = volume > 0
    return np.where(ok, volume / (np.median(volume[ok]) if ok.any() else 1.0), np.nan)


def _aim(score: np.ndarray, past: np.ndarray, loadings: np.ndarray, dear: np.ndarray, config: BookConfig) -> np.ndarray:
    """Aimed weights at one bar: mean-variance under the limits, scaled down where the edge does not pay for trading."""
    out = np.zeros(len(score))
    live = np.flatnonzero(np.isfinite(score))
    if len(live) < 3:
        return out
    cov, kept = steadied_covariance(past[:, live], least=config.least_bars)
    names = live[kept]
    if len(names) < 3:
        return out
    if config.cluster_scale > 0:
        spread = np.sqrt(np.diag(cov))
        cov = cov + cluster_penalty(clusters(cov / np.outer(spread, spread), config.cluster_cut), config.cluster_scale * float(np.diag(cov).mean()))
    bands = np.resize(np.asarray(config.bands or (0.0,), float), loadings.shape[1])
    w = mean_variance(score[names], cov, loadings[names], config.cap, config.gross, bands=bands)
    if config.edge_times > 0:
        edge, cost = float(w @ score[names]), float(np.abs(w) @ dear[names]) * 2
        m = 1.0 if cost <= 0 else min(1.0, max(0.0, edge / (config.edge_times * cost)))
        w = w * (m if m >= config.edge_least else 0.0)
    out[names] = w
    return out


def backtest(panel: DataFrame, config: BookConfig = BookConfig()) -> DataFrame:
    """Bar-by-bar book per ``window``: rows with window, timestamp, symbol, score, r and volume.

    State passes from bar to bar, so a window is one group, whose size is its bars times its names; windows
    run side by side. At bar t the book aims at weights for the scores as ``_aim`` says, trades a share of the
    gap (by ``trade_rate``, slower for thinly traded names) within caps and participation, pays costs (more
    for thinly traded names) on what it traded, earns the returns of bar t + 1 and, where the panel has
    ``funding_rate``, pays the funding that settles there.
    """
    extra = [c for c in ("funding_rate", *config.loadings) if c in panel.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = {c: pdf.pivot(index="timestamp", columns="symbol", values=c) for c in ("score", "r", "volume", *extra)}
        score, r, vol = (wide[c].to_numpy(float) for c in ("score", "r", "volume"))
        rates = np.nan_to_num(wide["funding_rate"].to_numpy(float)) if "funding_rate" in wide else np.zeros_like(r)
        betas = [wide[c].to_numpy(float) for c in config.loadings if c in wide]
        w, aim, out, stamps = np.zeros(score.shape[1]), np.zeros(score.shape[1]), [], wide["r"].index
        rate = trade_rate(config.cost_bps, config.urgency, config.reference_bps, config.half_life)
        for t in range(len(score) - 1):
            seen = vol[max(0, t - config.volume_bars + 1) : t + 1]
            adv = np.divide(np.nansum(seen, axis=0), np.maximum(np.isfinite(seen).sum(axis=0), 1))
            relative = _ratio_to_middle(adv)
            dear = config.cost_bps / 1e4 * np.nan_to_num(np.clip(1 + config.impact * (1 / relative - 1), 0.5, 3.0), nan=1.0)
            pace = np.nan_to_num(np.clip(relative**config.speed_power, 0.25, 2.0), nan=1.0)
            if t % config.rebalance == 0:
                loadings = np.column_stack([np.ones(len(w)), *(b[t] for b in betas)])
                aim = _aim(score[t], r[max(0, t - config.covariance_bars + 1) : t + 1], loadings, dear, config)
            step = np.clip(rate * pace, 0, 1) * (aim - w)
            most = np.nan_to_num(adv) * config.participation / config.book
            moved = np.clip(w + np.clip(step, -most, most), -config.cap * config.gross, config.cap * config.gross)
            step, w = moved - w, moved
            earned, paid, cost = float(np.nansum(w * r[t + 1])), float(w @ rates[t + 1]), float(np.abs(step) @ dear)
            out.append((pdf["window"].iloc[0], stamps[t + 1], earned, -paid, cost, earned - paid - cost, float(np.abs(step).sum()), float(np.abs(w).sum()), float(w.sum()), int((np.abs(w) > 1e-9).sum())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in BACKTEST.split(", ")])

    return panel.select("window", "timestamp", "symbol", "score", "r", "volume", *extra).groupBy("window").applyInPandas(run, BACKTEST)


def old_enough(panel: DataFrame, history: DataFrame, days: int) -> DataFrame:
    """Rows of names whose first row in ``history`` is at least ``days`` old; unknown names go."""
    first = history.groupBy("symbol").agg(F.min("timestamp").alias("_first"))
    return panel.join(first, "symbol").where(F.col("timestamp") >= F.col("_first") + F.expr(f"INTERVAL {int(days)} DAYS")).select(*panel.columns)


def funding_accrual(weights: DataFrame, rates: DataFrame, bar_seconds: int = 600) -> DataFrame:
    """Funding paid per stamp by the book held over the bar that ends at the settlement: minus weight times rate."""
    paid = rates.select(F.col("timestamp"), "symbol", "funding_rate")
    held = weights.select((F.col("timestamp") + F.expr(f"INTERVAL {bar_seconds} SECONDS")).alias("timestamp"), "symbol", "weight")
    return held.join(paid, ["timestamp", "symbol"]).groupBy("timestamp").agg((-F.sum(F.col("weight") * F.col("funding_rate"))).alias("funding_pnl"))


def month_book(signals: DataFrame) -> DataFrame:
    """Weights of signals in their bucket, which is their lag, by absolute ``ic``, and the bucket's figures.

    An unknown ic counts as none; where all are none, weights are equal. ``bucket_ic`` and
    ``bucket_turnover`` (unknown: 1) are weighted means, ``bucket_half_life`` that of the signals that have
    one. Needs lag, ic, turnover and half_life; all columns stay.
    """
    w = Window.partitionBy("lag")
    size = F.abs(F.when(F.isnan("ic"), None).otherwise(F.col("ic")))
    q = F.coalesce(size, F.lit(0.0))
    total = F.sum(q).over(w)
    weighed = signals.withColumn("weight", F.when(total > 1e-12, q / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))
    known = F.when(F.col("half_life") > 0, F.col("weight"))
    turned = F.coalesce(F.when(F.isnan("turnover"), None).otherwise(F.col("turnover")), F.lit(1.0))
    return weighed.withColumns({
        "bucket_ic": F.sum(q * F.col("weight")).over(w),
        "bucket_turnover": F.sum(turned * F.col("weight")).over(w),
        "bucket_half_life": F.sum(known * F.col("half_life")).over(w) / F.greatest(F.sum(known).over(w), F.lit(1e-12)),
    })
