"""Signal evaluation: rank correlation, quintile spreads, screening backtests, response curves, robust t."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def safe_corr(a: str, b: str) -> Column:
    """Correlation over complete pairs; null, rather than an error, where one side does not vary."""
    pair = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(pair, F.col(a))) * F.stddev_pop(F.when(pair, F.col(b)))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def average_rank(x: Column, *by: str) -> Column:
    """Rank with ties sharing their mean; rows with a null ``x`` must be gone."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def percent_rank(x: Column, *by: str) -> Column:
    return average_rank(x, *by) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def rank_ic(panel: DataFrame, signal: str = "signal", target: str = "tgt", least: int = 10, by: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Spearman correlation per stamp; stamps with fewer than ``least`` names or without spread are null or left out."""
    ok = panel.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least)
    ranked = ok.select(*by, average_rank(F.col(signal), *by).alias("a"), average_rank(F.col(target), *by).alias("b"))
    return ranked.groupBy(*by).agg(safe_corr("a", "b").alias("ic"), F.count("a").alias("n"))


def quintile_spread(panel: DataFrame, signal: str = "signal", target: str = "tgt", least: int = 10) -> DataFrame:
    """Mean target of the top fifth less that of the bottom fifth, per stamp."""
    ok = panel.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("timestamp"))).where(F.col("_n") >= least)
    p = ok.withColumn("_p", percent_rank(F.col(signal), "timestamp"))
    return p.groupBy("timestamp").agg((F.avg(F.when(F.col("_p") >= 0.8, F.col(target))) - F.avg(F.when(F.col("_p") <= 0.2, F.col(target)))).alias("spread"), F.count("_p").alias("n"))


def bucket_ic(panel: DataFrame, bucket: str, signal: str = "signal", target: str = "tgt", least: int = 3) -> DataFrame:
    """Rank correlation inside each (stamp, bucket), then its mean per bucket."""
    each = rank_ic(panel.where(F.col(bucket).isNotNull()), signal, target, least, ("timestamp", bucket))
    return each.groupBy(bucket).agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n_stamps"))


def decile(x: Column, *by: str, n: int = 10) -> Column:
    """ceil(percent rank x n), within 1..n."""
    return F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(percent_rank(x, *by) * n).cast("int")))


def book_weights(panel: DataFrame, signal: str = "signal") -> DataFrame:
    """Demeaned signal scaled to gross one at each stamp; stamps without gross are left out."""
    w = Window.partitionBy("timestamp")
    d = panel.where(F.col(signal).isNotNull()).withColumn("_d", F.col(signal) - F.avg(signal).over(w)).withColumn("_g", F.sum(F.abs("_d")).over(w))
    return d.where("_g > 1e-12").withColumn("weight", F.col("_d") / F.col("_g")).drop("_d", "_g")


def turnover(weights: DataFrame) -> DataFrame:
    """Sum over names of the weight's change since the stamp before; an absent name has weight zero.

    A row meets its name's neighbours only: what was not there at the stamp before comes in whole, and what
    is not there at the next goes out whole.
    """
    stamps = weights.select("timestamp").distinct()
    placed = stamps.withColumn("_pos", F.row_number().over(Window.orderBy("timestamp")))  # one row a stamp
    own = Window.partitionBy("symbol").orderBy("_pos")
    held = weights.select("timestamp", "symbol", "weight").join(placed, "timestamp")
    near = held.withColumns({"_was": F.when(F.lag("_pos").over(own) == F.col("_pos") - 1, F.lag("weight").over(own)), "_stays": F.coalesce(F.lead("_pos").over(own) == F.col("_pos") + 1, F.lit(False))})
    moved = near.select("_pos", F.abs(F.col("weight") - F.coalesce("_was", F.lit(0.0))).alias("_m"))
    gone = near.where(~F.col("_stays")).select((F.col("_pos") + 1).alias("_pos"), F.abs("weight").alias("_m"))
    return moved.union(gone).groupBy("_pos").agg(F.sum("_m").alias("turnover")).join(placed, "_pos").select("timestamp", "turnover")


def screening_backtest(panel: DataFrame, signal: str = "signal", target: str = "tgt", cost_bps: float = 5.0, least: int = 10) -> DataFrame:
    """Gross, turnover and net of the demeaned book of gross one, at each stamp with at least ``least`` names.

    A stamp whose signals are all alike holds no book, and stays with weights of zero.
    """
    w = Window.partitionBy("timestamp")
    ok = panel.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    d = ok.withColumn("_d", F.col(signal) - F.avg(signal).over(w)).withColumn("_g", F.sum(F.abs("_d")).over(w))
    book = d.select("timestamp", "symbol", F.col(target).alias("_y"), F.when(F.col("_g") > 0, F.col("_d") / F.col("_g")).otherwise(0.0).alias("weight"))
    gross = book.groupBy("timestamp").agg(F.sum(F.col("weight") * F.col("_y")).alias("gross"))
    return gross.join(turnover(book), "timestamp").withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)


def hac_tstat(series: DataFrame, x: str = "x", order: str = "timestamp") -> DataFrame:
    """Newey-West t of the mean with Bartlett weights and floor(4 (n/100)^(2/9)) lags; one row.

    Only sums leave the series: one aggregate for the mean, one for all lagged products.
    """
    s = series.where(F.col(x).isNotNull())
    n, mean = s.agg(F.count(x), F.avg(x)).first()
    spark = series.sparkSession
    if n < 3:
        return spark.createDataFrame([(n, mean, 0.0)], "n long, mean double, tstat double")
    lags = int(np.floor(4 * (n / 100) ** (2 / 9)))
    d = s.select(order, (F.col(x) - F.lit(mean)).alias("d"))
    w = Window.orderBy(order)
    sums = d.select("d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)]).agg(F.sum(F.col("d") * F.col("d")), *[F.sum(F.col("d") * F.col(f"l{k}")) for k in range(1, lags + 1)]).first()
    variance = (sums[0] + sum(2 * (1 - k / (lags + 1)) * (sums[k] or 0.0) for k in range(1, lags + 1))) / n
    t = mean / np.sqrt(variance / n) if variance > 0 else 0.0
    return spark.createDataFrame([(n, float(mean), float(t))], "n long, mean double, tstat double")


def response_curve(signal: DataFrame, residuals: DataFrame, ks: Sequence[int], stride: int = 6, least: int = 3) -> DataFrame:
    """Mean outcome of a unit-gross entry ``k`` bars later, for sampled ``k``: one row per k.

    Positions count the stamps that any symbol has. A missing residual is zero. Entries are taken every
    ``stride`` stamps where the whole horizon lies ahead and at least ``least`` names have a signal.
    """
    horizon = max(ks)
    stamps = residuals.select("timestamp").distinct().withColumn("pos", F.row_number().over(Window.orderBy("timestamp")) - 1)
    last = stamps.agg(F.max("pos")).first()[0]
    grid = stamps.join(residuals.select("symbol").distinct(), how="cross").join(residuals, ["timestamp", "symbol"], "left").na.fill(0.0, ["residual_return"])
    w = Window.partitionBy("symbol").orderBy("pos")
    path = grid.withColumn("_c", F.sum("residual_return").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    path = path.select("timestamp", "symbol", "pos", *[(F.lead("_c", k).over(w) - F.col("_c")).alias(f"a{k}") for k in ks])
    names = signal.where(F.col("signal").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("timestamp"))).where(F.col("_n") >= least)
    entries = book_weights(names).select("timestamp", "symbol", "weight").join(path, ["timestamp", "symbol"]).where((F.col("pos") % stride == 0) & (F.col("pos") + horizon <= F.lit(last)))
    by_entry = entries.groupBy("timestamp").agg(*[F.sum(F.col("weight") * F.col(f"a{k}")).alias(f"a{k}") for k in ks])
    means = by_entry.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"a{k}").alias(f"a{k}") for k in ks])
    pairs = ", ".join(f"{k}, a{k}" for k in ks)
    return means.select("n", F.expr(f"stack({len(ks)}, {pairs}) AS (k, a)")).select(F.col("k").cast("long").alias("k"), "a", F.col("n").alias("n_entries"))


#: Half-lives, in bars, that a response curve is fitted with.
HALF_LIVES = (3, 6, 12, 24, 48, 96, 144, 288, 432, 720, 1008, 2016)


def fit_curve(curve: Sequence[float], half_lives: Sequence[float] = HALF_LIVES, entries: dict[int, Sequence[float]] | None = None, n_eff: float = 1.0) -> dict[str, float]:
    """What a response curve A(1..H) says of a bet: where and how high it peaks, how fast, and what it gives back.

    ``a0`` is the height, and ``peak_k`` the place, of the peak of the curve smoothed over five bars;
    ``half_life`` fits the curve itself up to there by least squares over the grid, with positive amplitudes;
    ``rev_frac`` is the share of the peak lost at the end, 0 unless the peak is positive. ``entries``, single
    outcomes by bar, give ``se_peak`` (over ``n_eff`` independent ones) and ``median_peak`` at the bar nearest
    the peak.
    """
    raw = np.asarray(list(curve), float)
    if not len(raw) or not np.isfinite(raw).any():
        return {}
    smooth = pd.Series(raw).rolling(5, center=True, min_periods=1).mean().to_numpy()
    top = int(np.nanargmax(smooth))
    height, seen = float(smooth[top]), raw[: top + 1]
    shapes = 1 - 0.5 ** (np.arange(1, top + 2)[None, :] / np.asarray(half_lives, float)[:, None])
    amplitude = shapes @ seen / (shapes**2).sum(axis=1)
    misfit = np.where(amplitude > 0, ((seen - amplitude[:, None] * shapes) ** 2).sum(axis=1), np.inf)
    best = int(np.argmin(misfit)) if np.isfinite(misfit).any() else 0
    out = {"a0": height, "half_life": float(half_lives[best]), "peak_k": top + 1, "rev_frac": float(1 - smooth[-1] / height) if height > 0 else 0.0, "se_peak": float("nan"), "median_peak": float("nan")}
    if entries:
        at = np.asarray(entries[min(entries, key=lambda k: abs(k - top - 1))], float)
        at = at[np.isfinite(at)]
        if len(at) > 1:
            out |= {"se_peak": float(at.std(ddof=1) / np.sqrt(max(n_eff, 1.0))), "median_peak": float(np.median(at))}
    return out


def flipped_curve(ks: Sequence[int], curve: Sequence[float | None]) -> dict[str, float]:
    """Peak of the negated curve on its sampled bars, and the share of it lost at the last one."""
    a = np.array([np.nan if v is None else -float(v) for v in curve])
    if not np.isfinite(a).any():
        return {}
    top = int(np.nanargmax(a))
    return {"a0": float(a[top]), "peak_k": int(ks[top]), "rev_frac": float(1 - a[-1] / a[top]) if a[top] > 0 and np.isfinite(a[-1]) else 0.0}


def thirds_agree(outcomes: Sequence[float]) -> bool:
    """Whether the means of the first, middle and last third of outcomes in time have one sign; true if there are under three."""
    x = np.asarray(list(outcomes), float)
    x = x[np.isfinite(x)]
    if len(x) < 3:
        return True
    signs = {int(np.sign(part.mean())) for part in np.array_split(x, 3)}
    return signs in ({1}, {-1})


def persistence(half_life: float | None, turnover: float | None) -> float | None:
    """Bars that an edge lasts: the shorter of its half-life and the time in which the book turns over."""
    known = [x for x in (half_life, 1 / turnover if turnover and turnover > 0 else None) if x]
    return min(known) if known else None


def capture(half_life: float | None, rate: float) -> float:
    """Share of an edge that decays by half in ``half_life`` bars which a book filling at ``rate`` a bar earns."""
    return 1.0 if not half_life or half_life <= 0 else float(1 / (1 + np.log(2) / half_life / max(rate, 1e-12)))


def signal_correlation(a: DataFrame, b: DataFrame, least: int = 10) -> DataFrame:
    """Correlation of two signals on their common rows; zero on fewer than ``least``."""
    j = a.select("timestamp", "symbol", F.col("signal").alias("x")).join(b.select("timestamp", "symbol", F.col("signal").alias("y")), ["timestamp", "symbol"])
    return j.agg(F.when(F.count(F.lit(1)) >= least, safe_corr("x", "y")).otherwise(0.0).alias("corr"), F.count(F.lit(1)).alias("n"))


def smoothed(panel: DataFrame, x: str, half_life: float) -> DataFrame:
    """Exponential mean per symbol with weights by row distance, normalised over the rows that have values."""
    schema = panel.select("timestamp", "symbol", F.col(x).cast("double").alias("ewm")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        return pdf[["timestamp", "symbol"]].assign(ewm=pdf[x].ewm(halflife=half_life, adjust=True, min_periods=1).mean())

    return panel.select("timestamp", "symbol", F.col(x).cast("double").alias(x)).groupBy("symbol").applyInPandas(run, schema)


def false_discovery(tests: DataFrame, p: str = "p", rate: float = 0.1, arbitrary: bool = False) -> DataFrame:
    """Adds ``discovered`` by Benjamini-Hochberg, or under arbitrary dependence by Benjamini-Yekutieli; nulls never are.

    Distinct values are ranked in 4096 ranges of p; only the ranges' counts are added up in one place.
    """
    values = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    values = values.withColumn("_range", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p"))) * 4096))
    ranges = values.groupBy("_range").agg(F.sum("_n").alias("_m"))
    before = ranges.select("_range", F.coalesce(F.sum("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.sum("_n").over(Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.join(before, "_range").withColumn("_r", rank)
    n = ranges.agg(F.sum("_m")).first()[0] or 0
    c = float(np.sum(1 / np.arange(1, n + 1))) if arbitrary and n else 1.0
    cut = ranked.where(F.col("_p") <= rate * F.col("_r") / (max(n, 1) * c)).agg(F.max("_p")).first()[0]
    return tests.withColumn("discovered", F.coalesce(F.col(p) <= F.lit(cut), F.lit(False)))


def targets_panel(panel: DataFrame, lags: dict[str, int], x: str = "residual_return", volume: str = "quote_asset_volume", w: int = 144, least: int = 36) -> DataFrame:
    """Forward sums of ``x`` at several lags, the liquid half by trailing volume, and its decile, per row."""
    own = Window.partitionBy("symbol").orderBy("timestamp")

    def ahead(p: int) -> Column:
        o = own.rowsBetween(1, p)
        return F.when(F.count(x).over(o) == p, F.sum(x).over(o))

    back = own.rowsBetween(-(w - 1), 0)
    t = panel.withColumns({f"fwd_{n}": ahead(p) for n, p in lags.items()} | {"_adv": F.when(F.count(volume).over(back) >= least, F.avg(volume).over(back))})
    known = t.where(F.col("_adv").isNotNull()).withColumn("_p", percent_rank(F.col("_adv"), "timestamp"))
    flagged = known.select("timestamp", "symbol", (F.col("_p") >= 0.5).alias("is_liquid"), F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("_p") * 10).cast("int"))).alias("liq_decile"))
    return t.drop("_adv").join(flagged, ["timestamp", "symbol"], "left").withColumn("is_liquid", F.coalesce("is_liquid", F.lit(False)))


def smoothing_half_life(lag_bars: int, buckets: Sequence[tuple[int, float]] = ((12, 3.0), (48, 12.0), (144, 72.0), (432, 108.0)), floor: float = 1.0) -> float:
    """Half-life for the first bucket that reaches the lag; the last one beyond."""
    return max(floor, next((h for top, h in buckets if lag_bars <= top), buckets[-1][1]))


def binned_response(panel: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """Mean target by cross-sectional bin of a feature."""
    ok = panel.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    pct = percent_rank(F.col(feature), "timestamp")
    return ok.withColumn("bin", F.least(F.lit(bins - 1), F.floor(pct * bins).cast("int"))).groupBy("bin").agg(F.avg(target).alias("mean"), F.count(target).alias("n"))
