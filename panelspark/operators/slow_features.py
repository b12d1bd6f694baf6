"""Feature families over daily and event data, and two that need more than one pass over a symbol's bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.features import same_bucket_seasonality
from panelspark.operators.joins import asof, event_windows, neighbours
from panelspark.operators.panels import bucket_end
from panelspark.plans.formula import Formula, beta, change, corr, lag, mean, most, percent_rank, std, total

DAY = 144


def macro_state(z: int = 365, least: int = 91) -> Formula:
    """Daily macro columns: changes, slope, stress, liquidity. Rows are days of one series per symbol."""
    s1 = {
        "mx_2y_change_1d": f"rates2y - {lag('rates2y')}", "mx_2y_change_5d": f"rates2y - {lag('rates2y', 5)}", "mx_slope": "rates10y - rates2y", "mx_dollar_5d": change("dollar", 5), "mx_vix_change_1d": f"vix - {lag('vix')}",
        "mx_vix_z": f"(vix - ({mean('vix', z, least)})) / (({std('vix', z, least)}) + 1e-10)", "mx_breakeven_5d": f"breakeven10 - {lag('breakeven10', 5)}", "net_liq": "fed_bs / 1000 - rrp", "mx_stables_7d": change("stables_mcap", 7),
        "mx_fear_greed": "fear_greed", "mx_dominance_7d": f"dominance - {lag('dominance', 7)}",
    }
    s2 = {"mx_net_liquidity_28d": f"net_liq - {lag('net_liq', 28)}", "mx_event_shock": f"CASE WHEN {lag('is_event')} = 1 THEN abs(mx_2y_change_1d) ELSE 0 END"}
    return Formula((s1, s2), (*[k for k in s1 if k != "net_liq"], *s2))


def stablecoins() -> Formula:
    """Thirty-day change of the total supply and seven-day changes by chain, a day late."""
    s1 = {"all_supply": "coalesce(usdt, 0) + coalesce(usdc, 0) + coalesce(dai, 0)"}
    s2 = {"total_30": change("all_supply", 30), **{f"{c}_7": change(c, 7) for c in ("eth", "sol", "tron")}}
    s3 = {"sc_total_30d": lag("total_30"), **{f"sc_{c}_7d": lag(f"{c}_7") for c in ("eth", "sol", "tron")}}
    return Formula((s1, s2, s3), tuple(s3))


#: Impulses taken as shares of the day before, where the others are differences; names of loadings.
RELATIVE = ("dollar", "stables_mcap", "dominance")
LOADING = {"rates2y": "rates", "stables_mcap": "stables"}


def macro_betas(impulses: tuple[str, ...] = ("rates2y", "dollar", "vix", "stables_mcap", "dominance"), w: int = 90, least: int = 45) -> Formula:
    """Loadings of a daily residual ``res`` on macro impulses, a day late."""
    s1 = {f"d_{x}": change(x) if x in RELATIVE else f"{x} - {lag(x)}" for x in impulses}
    s2 = {f"b_{x}": beta("res", f"d_{x}", w, least) for x in impulses}
    s3 = {f"mb_beta_{LOADING.get(x, x)}": lag(f"b_{x}") for x in impulses}
    return Formula((s1, s2, s3), tuple(s3))


def seasonality(bars: DataFrame, weeks: int = 8, least_weeks: int = 2, least_rows: int = 100, **how) -> DataFrame:
    """Each symbol's profile by hour, by hour of the funding cycle and by weekday (see ``same_bucket_seasonality``).

    A weekday's value is the mean of the sums of whole days, the last ``weeks`` same weekdays before this one.
    """
    daily = bars.groupBy("symbol", F.to_date("timestamp").alias("_day")).agg(F.sum("residual_return").alias("_sum"))
    before = Window.partitionBy("symbol", F.weekday("_day")).orderBy("_day").rowsBetween(-weeks, -1)
    daily = daily.select("symbol", "_day", F.when(F.count("_sum").over(before) >= least_weeks, F.avg("_sum").over(before)).alias("_mean"))
    f = same_bucket_seasonality(least_rows=least_rows, **how)
    out = f.apply(bars).withColumn("_day", F.to_date("timestamp")).join(daily, ["symbol", "_day"], "left")
    return out.select("timestamp", "symbol", *f.outputs, F.when(F.col("known") >= least_rows, F.col("_mean")).alias("sn_dow_res"))


def trailing(x: str, keys: list, order: str, w: int, least: int) -> Column:
    o = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(w - 1), 0)
    return F.when(F.count(x).over(o) >= least, F.avg(x).over(o))


def event_reactions(bars: DataFrame, events: DataFrame, x: str = "residual_return", volume: str = "quote_asset_volume", k: int = 12, least: int = 4, base: tuple[int, int] = (60, 20), own: tuple[int, int] = (20, 10), hours: int = 24, least_rows: int = 100) -> DataFrame:
    """How each symbol has met the last ``k`` events (rows with ``event_time``): timestamp, symbol and three columns.

    ``mb_event_vol_ratio`` and ``mb_event_volume_ratio`` are the mean sum of absolute ``x``, and the mean relative
    volume, of event days over that of all days, a day late; ``mb_event_drift`` is the mean sum of ``x`` in the
    ``hours`` after an event, known once they are over. Events at one time count one by one; an event after which a
    symbol has no bar does not count for it. Symbols with fewer than ``least_rows`` values have nulls.
    """
    times = events.where("event_time IS NOT NULL").groupBy("event_time").agg(F.count(F.lit(1)).alias("_same"))
    days = times.select(F.to_date("event_time").alias("_day")).distinct().withColumn("_event", F.lit(True))
    daily = bars.groupBy("symbol", F.to_date("timestamp").alias("_day")).agg(F.sum(F.abs(x)).alias("_abs"), F.sum(volume).alias("_v"))
    daily = daily.withColumn("_rel", F.col("_v") / (trailing("_v", ["symbol"], "_day", *own) + 1e-10)).join(days, "_day", "left")
    path = Window.partitionBy("symbol").orderBy("_day")
    for s in ("_abs", "_rel"):
        hit = F.col("_event").isNotNull() & F.col(s).isNotNull()
        daily = daily.withColumn("_hit", hit).withColumn("_at", F.when(F.col("_hit"), trailing(s, ["symbol", "_hit"], "_day", k, least)))
        daily = daily.withColumn("_ratio", F.last("_at", ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, 0)) / (trailing(s, ["symbol"], "_day", *base) + 1e-18))
        daily = daily.withColumn(f"_ratio{s}", F.lag("_ratio").over(path))
    after = event_windows(times, bars.select("symbol", "timestamp", x), [], hours * 3600).groupBy("symbol", "event_time", "_same").agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("_p"))
    after = after.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))))
    last = Window.partitionBy("symbol").orderBy("event_time", "_i").rowsBetween(-(k - 1), 0)
    drift = after.withColumn("mb_event_drift", F.when(F.count("_p").over(last) >= least, F.avg("_p").over(last))).where("_i = _same")
    drift = drift.select("symbol", (F.col("event_time") + F.expr(f"INTERVAL {hours} HOURS")).alias("timestamp"), "mb_event_drift")
    known = F.count(x).over(Window.partitionBy("symbol")) >= least_rows
    rows = bars.select("timestamp", "symbol", known.alias("_known"), F.to_date("timestamp").alias("_day")).join(daily.select("symbol", "_day", "_ratio_abs", "_ratio_rel"), ["symbol", "_day"], "left")
    out = asof(rows, drift, ["symbol"], "timestamp", ["mb_event_drift"])
    return out.select("timestamp", "symbol", *[F.when(F.col("_known"), F.col(c)).alias(n) for c, n in (("_ratio_abs", "mb_event_vol_ratio"), ("_ratio_rel", "mb_event_volume_ratio"), ("mb_event_drift", "mb_event_drift"))])


def cap_rank(bars: DataFrame, caps: DataFrame, limit: int = 7) -> DataFrame:
    """Percentile rank of a name's market capitalisation among all names that have one, a day late.

    ``caps`` has date, symbol and market_cap; a value stands for at most ``limit`` days after its own. Each value is
    spread over the days it stands for, so no calendar of all names and days is made.
    """
    following = F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))
    known = caps.where("market_cap IS NOT NULL").select("symbol", "market_cap", "date", following.alias("_next"))
    until = F.least(F.date_add("date", 1 + limit), "_next")
    stands = known.select("symbol", "market_cap", F.explode(F.sequence(F.date_add("date", 1), until)).alias("date"))
    ranks = stands.select("symbol", F.col("date").alias("_day"), F.expr(percent_rank("market_cap", "date")).alias("cs_mcap_rank"))
    return bars.select("timestamp", "symbol", F.to_date("timestamp").alias("_day")).join(ranks, ["symbol", "_day"], "left").select("timestamp", "symbol", "cs_mcap_rank")


def unlocks(cliff: float = 0.001, days: int = 30) -> Formula:
    """Days to the next and since the last cliff, its size, and the trailing unlocked share; the schedule is known ahead."""
    ahead = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    behind = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    s1 = {"day_no": "row_number() OVER (PARTITION BY symbol ORDER BY timestamp)"}
    s2 = {"cliff_no": f"CASE WHEN daily_pct >= {cliff} THEN day_no END", "un_trailing_30d_pct": total("daily_pct", days, 1)}
    s3 = {"next_no": f"min(cliff_no) {ahead}", "last_no": f"max(cliff_no) {behind}"}
    s4 = {"un_days_to_next": "CAST(next_no - day_no AS DOUBLE)", "un_days_since_last": "CAST(day_no - last_no AS DOUBLE)", "un_next_pct": f"CASE WHEN next_no IS NOT NULL THEN min(CASE WHEN cliff_no IS NOT NULL THEN daily_pct END) OVER (PARTITION BY symbol, next_no) END"}
    return Formula((s1, s2, s3, s4), ("un_trailing_30d_pct", *s4))


def developers(delay: int = 30, span: int = 90) -> Formula:
    """Levels, change and shares of developer counts, as known ``delay`` days later."""
    s1 = {x: lag(c, delay) for x, c in (("devs", "all_devs"), ("full_time", "full_time_devs"), ("own", "exclusive_devs"))}
    s2 = {"dv_log_devs": "ln(1 + greatest(devs, 0))", "devs_then": lag("devs", span), "dv_full_time_share": "full_time / nullif(devs, 0)", "dv_exclusive_share": "own / nullif(devs, 0)"}
    s3 = {"dv_change_90d": "(devs - devs_then) / (devs_then + 1)"}
    return Formula((s1, s2, s3), ("dv_log_devs", "dv_full_time_share", "dv_exclusive_share", "dv_change_90d"))


def loadings(short: int = DAY, long: int = 2 * DAY, factors: tuple[str, ...] = ("market",)) -> Formula:
    """Levels and changes of daily loadings joined onto bars."""
    s1 = {f"fl_beta_{f}": f"beta_{f}" for f in factors} | {f"fl_beta_{f}_change_{n}": f"beta_{f} - {lag(f'beta_{f}', k)}" for f in factors for n, k in (("short", short), ("long", long))} | {"fl_r_squared": "r_squared"}
    return Formula((s1,), tuple(s1))


def listing_age(bars: DataFrame, listings: DataFrame, young: int = 30) -> DataFrame:
    """Days since a symbol's first trade (null before it), and whether it is young."""
    days = F.datediff(F.to_date("timestamp"), F.to_date("first_trade"))
    out = bars.select("timestamp", "symbol").join(listings.select("symbol", "first_trade"), "symbol", "left").withColumn("_d", F.when(days >= 0, days.cast("double")))
    return out.select("timestamp", "symbol", F.col("_d").alias("ls_days_listed"), F.when(F.col("_d").isNotNull(), (F.col("_d") <= young).cast("double")).alias("ls_is_young"))


def event_timing(bars: DataFrame, events: DataFrame, cap_hours: float = 168, near_bars: int = 6, bar_seconds: int = 600, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Hours to the next event and since the last, capped, whether either is within a few bars, and days of ``kinds``.

    Where no event follows or went before, the hours are the cap; without any event all columns are null. ``kinds``
    are values of the events' ``event_type``; each gives a column ``ev_<kind>_day``.
    """
    n = neighbours(bars.select("timestamp", "symbol"), events.select("event_time"))

    def hours(a: str, b: str):
        return (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 3.6e9

    cap, near = F.lit(float(cap_hours)), near_bars * bar_seconds / 3600
    some = F.col("next_event").isNotNull() | F.col("previous_event").isNotNull()
    ahead, behind = F.coalesce(hours("next_event", "timestamp"), cap), F.coalesce(hours("timestamp", "previous_event"), cap)
    out = n.select("timestamp", "symbol", some.alias("_some"), F.to_date("timestamp").alias("_day"), F.when(some, F.least(cap, ahead)).alias("ev_hours_to_event"), F.when(some, F.least(cap, behind)).alias("ev_hours_since_event"), F.when(some, ((ahead <= near) | (behind <= near)).cast("double")).alias("ev_event_window"))
    if kinds:
        days = events.where("event_time IS NOT NULL").groupBy(F.to_date("event_time").alias("_day")).agg(*[F.max((F.col("event_type") == kind).cast("double")).alias(f"_{kind}") for kind in kinds])
        out = out.join(days, "_day", "left")
    return out.select("timestamp", "symbol", *[F.when(F.col("_some"), F.coalesce(f"_{kind}", F.lit(0.0))).alias(f"ev_{kind}_day") for kind in kinds], "ev_hours_to_event", "ev_hours_since_event", "ev_event_window")


def intrabar(fine: DataFrame, seconds: int, bars_per_day: int = DAY, rv: int = 6, ac: tuple[int, int] = (60, 30), long: int = 144) -> DataFrame:
    """Features of bars from the finer bars inside them: timestamp, symbol, close and volume.

    One window over the fine bars, one aggregation into buckets, one window over the buckets.
    """
    first = Formula(({"lr": f"CASE WHEN close > 0 THEN ln(close / nullif({lag('close')}, 0)) END", "pv": "close * volume", "day": "CAST(timestamp AS DATE)"}, {"lr_1": lag("lr"), "cum_pv": "sum(pv) OVER (PARTITION BY symbol, day ORDER BY timestamp)", "cum_v": "sum(volume) OVER (PARTITION BY symbol, day ORDER BY timestamp)"}, {"ac": corr("lr", "lr_1", *ac)}), ())
    f = first.apply(fine)
    last = lambda c: F.max_by(c, "timestamp")
    g = f.groupBy(bucket_end(F.col("timestamp"), seconds).alias("bucket"), "symbol").agg(
        F.coalesce(F.sum(F.col("lr") * F.col("lr")), F.lit(0.0)).alias("rv"), F.max(F.abs("lr")).alias("max_abs"), F.sum("volume").alias("v"), F.sum(F.col("volume") * F.col("volume")).alias("v2"), F.sum((F.col("volume") <= 0).cast("double")).alias("zero"),
        F.count(F.lit(1)).cast("double").alias("n"), last("close").alias("close"), last("cum_pv").alias("pv"), last("cum_v").alias("cv"), last("ac").alias("ib_autocorr_1m"),
    )
    return INTRABAR(bars_per_day, rv, long).result(g.withColumnRenamed("bucket", "timestamp"))


def INTRABAR(bars_per_day: int = DAY, rv: int = 6, long: int = 144) -> Formula:  # noqa: N802
    scale = float(np.sqrt(bars_per_day / rv * 365))
    s1 = {"rv_sum": total("rv", rv), "r": f"CASE WHEN close > 0 THEN ln(close / nullif({lag('close')}, 0)) END", "max_roll": most("max_abs", rv, 1), "max_mean": mean("max_abs", long, 12), "v_sum": total("v", rv), "v2_sum": total("v2", rv), "ib_vwap_dev": "close / (pv / (cv + 1e-10) + 1e-10) - 1"}
    s2 = {"rr": "r * r"}
    s3 = {"ib_rv_1h": f"sqrt(rv_sum) * {scale!r}", "ib_rv_cc_ratio": f"sqrt(rv_sum / (({total('rr', rv)}) + 1e-18))", "ib_max_move_1m": "max_roll / (max_mean + 1e-10)", "ib_zero_vol_share": f"({total('zero', long, 12)}) / nullif({total('n', long, 12)}, 0)", "ib_volume_herf_1h": "v2_sum / (v_sum * v_sum + 1e-18)"}
    return Formula((s1, s2, s3), ("ib_autocorr_1m", "ib_vwap_dev", *s3))


def _wilder(x: np.ndarray, w: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=1 / w, adjust=False, min_periods=w).mean().to_numpy()


TECHNICAL = "timestamp timestamp_ntz, symbol string, rs_rsi double, mc_macd_histogram double, at_atr double, dm_di_plus double, dm_di_minus double, dm_adx double"


def technical(bars: DataFrame, rsi: int = 84, macd: tuple[int, int, int] = (72, 156, 54), atr: int = 84, dmi: int = 84) -> DataFrame:
    """Indicators with recursive smoothing, one grouped map per symbol."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("timestamp", ignore_index=True)
        c, h, low = (p[x].astype(float) for x in ("close", "high", "low"))
        d = c.diff().fillna(0.0)
        up, down = _wilder(d.clip(lower=0), rsi), _wilder(-d.clip(upper=0), rsi)
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
            strength[np.isnan(up)] = np.nan
            line = c.ewm(span=macd[0], adjust=False, min_periods=macd[0]).mean() - c.ewm(span=macd[1], adjust=False, min_periods=macd[1]).mean()
            tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
            plus, minus = h.diff(), -low.diff()
            dp, dm = plus.where((plus > minus) & (plus > 0), 0.0), minus.where((minus > plus) & (minus > 0), 0.0)
            t = _wilder(tr, dmi)
            di_p, di_m = 100 * _wilder(dp, dmi) / t, 100 * _wilder(dm, dmi) / t
            dx = 100 * np.abs(di_p - di_m) / (di_p + di_m)
        out = pd.DataFrame({"timestamp": p.timestamp, "symbol": p.symbol, "rs_rsi": strength, "mc_macd_histogram": line - line.ewm(span=macd[2], adjust=False, min_periods=macd[2]).mean(), "at_atr": _wilder(tr, atr) / (c + 1e-10), "dm_di_plus": di_p, "dm_di_minus": di_m, "dm_adx": _wilder(dx, dmi)})
        return out.replace([np.inf, -np.inf], np.nan)

    return bars.select("timestamp", "symbol", "high", "low", "close").groupBy("symbol").applyInPandas(run, TECHNICAL)


def cluster_relative(panel: DataFrame, x: str, labels: DataFrame, cap: float = 4.0) -> DataFrame:
    """Value standardised within (timestamp, cluster) and clipped; clusters come as (symbol, cluster)."""
    w = Window.partitionBy("timestamp", "cluster")
    z = (F.col(x) - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-10)
    return panel.join(labels, "symbol").withColumn("cs_cluster_z", F.when(F.col(x).isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), z)))).select("timestamp", "symbol", "cluster", "cs_cluster_z")


def residual_clusters(residuals: DataFrame, x: str, cut: float = 0.3, least: int = 3) -> DataFrame:
    """(symbol, cluster) from the correlations of symbols' residuals.

    Pairs of symbols are correlated in Spark; the matrix of symbols, an instrument universe and not data,
    is clustered on the driver.
    """
    from panelspark.operators.evaluation import safe_corr
    from panelspark.operators.portfolio import clusters

    a = residuals.select("timestamp", F.col("symbol").alias("a"), F.col(x).alias("x"))
    b = residuals.select("timestamp", F.col("symbol").alias("b"), F.col(x).alias("y"))
    got = a.join(b, "timestamp").where("a < b").groupBy("a", "b").agg(safe_corr("x", "y").alias("c")).collect()
    names = sorted({r.a for r in got} | {r.b for r in got})
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for r in got:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.c if r.c is not None else 0.0
    rows = [(n, int(k)) for n, k in zip(names, clusters(m, cut, least))]
    return residuals.sparkSession.createDataFrame(rows, "symbol string, cluster int")


