"""Feature families as staged formulas over one bar panel: every column at a bar reads that bar and earlier ones.

``df`` has timestamp (bar end), symbol, open, high, low, close, volume, quote_asset_volume,
number_of_trades, taker_buy_base_asset_volume and taker_buy_quote_asset_volume. Windows count the rows
that a symbol has, in bars of ten minutes by default.
"""

from __future__ import annotations

import math

from panelspark.plans.formula import Formula, change, clip, corr, cov, flag, lag, least, ln, mean, most, over, percent_rank, root, rows, running, std, total, var

DAY = 144
ANNUAL = math.sqrt(DAY * 365)
LN2 = math.log(2)
R = {"r": change("close")}


def efficiency(w: int = DAY, reversal: int = 36, q: tuple[int, int] = (6, 36), vr: int = 432, windows: tuple[int, ...] = (36, 144, 432), step: int = 6) -> Formula:
    names = ("short", "medium", "long")
    s2 = {"r_1": lag("r"), "r_2": lag("r", 2), "abs_r": "abs(r)", **{f"r_sum{k}": total("r", k) for k in q}, **{f"ma_{n}": mean("close", x, x // 2) for n, x in zip(names, windows)}}
    s3 = {"rev": flag("r * r_1 < 0"), **{f"ef_mean_deviation_{n}": f"(close - ma_{n}) / nullif(ma_{n}, 0)" for n in names}}
    s4 = {
        "ef_autocorr_lag1": corr("r", "r_1", w, max(10, w // 2)),
        "ef_autocorr_lag2": corr("r", "r_2", w, max(10, w // 2)),
        "ef_reversal_tendency": mean("rev", reversal),
        **{f"ef_variance_ratio{s}": f"({var(f'r_sum{k}', vr, vr // 2)}) / ({k} * ({var('r', vr, vr // 2)}) + 1e-18)" for k, s in zip(q, ("", "_long"))},
        **{f"ef_reversion_momentum_{n}": f"ef_mean_deviation_{n} - {lag(f'ef_mean_deviation_{n}', step)}" for n in names},
        "ef_efficiency_ratio": f"abs({total('r', w)}) / (({total('abs_r', w)}) + 1e-10)",
        "ef_info_processing_speed": corr("volume", "abs_r", reversal),
    }
    return Formula((R, s2, s3, s4), (*[f"ef_mean_deviation_{n}" for n in names], *s4))


def volatility_regime(short: int = 36, medium: int = DAY, long: int = 432) -> Formula:
    s2 = {"vol_s": std("r", short), "vol_l": std("r", long), "vol_x": std("r", 2 * long), "down": "CASE WHEN r < 0 THEN r ELSE 0 END", "up": "CASE WHEN r > 0 THEN r ELSE 0 END"}
    s3 = {"vol_s_half": lag("vol_s", max(2, short // 2)), "vol_s_back": lag("vol_s", short)}
    s4 = {
        "vr_volatility_regime_short": "vol_s / (vol_l + 1e-10)",
        "vr_volatility_regime_long": "vol_l / (vol_x + 1e-10)",
        "vr_vol_breakout_short": flag("vol_s > vol_l * 1.5"),
        "vr_vol_breakout_long": flag("vol_l > vol_x * 1.5"),
        "vr_vol_persistence_short": corr("vol_s", "vol_s_half", medium),
        "vr_vol_persistence_long": corr("vol_s", "vol_s_back", long),
        **{f"vr_semivol_ratio_{n}": f"({std('down', w, w // 2)}) / (({std('up', w, w // 2)}) + 1e-10)" for n, w in (("short", short), ("long", long))},
    }
    return Formula((R, s2, s3, s4), tuple(s4))


def liquidity(w: int = 36, ma: int = DAY) -> Formula:
    s2 = {"amihud": "abs(r) / (quote_asset_volume + 1e-10)", "quote_ma": mean("quote_asset_volume", ma, 2)}
    s3 = {"am_down": "CASE WHEN r < 0 THEN amihud END", "am_up": "CASE WHEN r > 0 THEN amihud END"}
    s4 = {
        "lq_amihud_illiquidity": f"({mean('amihud', w, 2)}) * 1e9",
        "lq_price_impact_proxy": "abs(r) / (quote_asset_volume / (quote_ma + 1e-10) + 1e-10)",
        "lq_amihud_asym": f"({mean('am_down', w, 2)}) / (({mean('am_up', w, 2)}) + 1e-18)",
    }
    return Formula((R, s2, s3, s4), tuple(s4), digits={"lq_amihud_illiquidity": 0, "lq_amihud_asym": 4})


def range_volatility(w: int = DAY, spread: int = DAY) -> Formula:
    s1 = R | {"hl": ln("high / nullif(low, 0)"), "co": ln("close / nullif(open, 0)"), "ho": ln("high / nullif(open, 0)"), "lo": ln("low / nullif(open, 0)"), "h_1": lag("high"), "l_1": lag("low")}
    s2 = {"hl_1": lag("hl"), "park": f"hl * hl / {4 * LN2!r}", "gk": clip(f"(0.5 * hl * hl - {2 * LN2 - 1!r} * co * co)", "0"), "rsv": clip("(ho * (ho - co) + lo * (lo - co))", "0"), "h2": "greatest(high, h_1)", "l2": "least(low, l_1)"}
    denom = 3 - 2 * math.sqrt(2)
    s3 = {"cs_beta": "hl * hl + hl_1 * hl_1", "cs_gamma": f"power({ln('h2 / nullif(l2, 0)')}, 2)"}
    s4 = {"cs_alpha": f"(sqrt(2 * cs_beta) - sqrt(cs_beta)) / {denom!r} - sqrt(cs_gamma / {denom!r})"}
    s5 = {"cs_raw": clip("(2 * (exp(cs_alpha) - 1) / (1 + exp(cs_alpha)))", "0"), "rb_garman_klass_vol": f"sqrt({mean('gk', w, w // 2)}) * {ANNUAL!r}"}
    s6 = {"rb_parkinson_vol": f"sqrt({mean('park', w, w // 2)}) * {ANNUAL!r}", "rb_rogers_satchell_vol": f"sqrt({mean('rsv', w, w // 2)}) * {ANNUAL!r}", "rb_gk_cc_ratio": f"rb_garman_klass_vol / (({std('r', w, w // 2)}) * {ANNUAL!r} + 1e-10)", "rb_cs_spread": mean("cs_raw", spread, 10)}
    return Formula((s1, s2, s3, s4, s5, s6), ("rb_garman_klass_vol", *s6))


def microstructure(long: int = DAY, short: int = 18, flow: tuple[int, int] = (36, 144)) -> Formula:
    s1 = R | {"trades": "greatest(CAST(number_of_trades AS DOUBLE), 1)", "qv": "greatest(quote_asset_volume, 1e-10)"}
    s2 = {"ats": "qv / trades", "ms_buy_ratio": "taker_buy_quote_asset_volume / qv", "abs_r": "abs(r)", "up_v": f"quote_asset_volume * {flag('r > 0')}", "down_v": f"quote_asset_volume * {flag('r < 0')}", "tr_ma": mean("trades", long, short), "qv_ma": mean("qv", long, short)}
    s3 = {"ofi": "(ms_buy_ratio - 0.5) * qv", "ats_ma": mean("ats", long, short)}
    s4 = {
        "ms_trade_intensity": "trades / (tr_ma + 1e-10)",
        "ms_trade_intensity_zscore": f"(trades - tr_ma) / (({std('trades', long, short)}) + 1e-10)",
        "ms_trade_intensity_momentum": f"({mean('trades', short, 2)}) / (tr_ma + 1e-10) - 1",
        "ms_dollar_volume_ratio": "qv / (qv_ma + 1e-10)",
        "ms_dollar_volume_momentum": f"({mean('qv', short, 2)}) / (qv_ma + 1e-10) - 1",
        "ms_avg_trade_size": "ats",
        "ms_avg_trade_size_zscore": f"(ats - ats_ma) / (({std('ats', long, short)}) + 1e-10)",
        "ms_large_trades_flag": flag("ats > ats_ma * 1.5"),
        "ms_buy_pressure_momentum": f"({mean('ms_buy_ratio', short, 2)}) - ({mean('ms_buy_ratio', long, short)})",
        "ms_ofi_cumsum_short": total("ofi", flow[0]),
        "ms_ofi_cumsum_long": total("ofi", flow[1]),
        "ms_ofi_normalized": f"({total('ofi', flow[0])}) / (({total('qv', flow[0])}) + 1e-10)",
        "ms_vol_return_correlation": corr("quote_asset_volume", "abs_r", long),
        "ms_up_down_volume_ratio": f"({total('up_v', long)}) / (({total('down_v', long)}) + 1e-10)",
    }
    # A trade count that never varies in the window has a deviation of zero up to rounding.
    return Formula((s1, s2, s3, s4), ("ms_buy_ratio", *s4), digits={"ms_trade_intensity_zscore": 5})


def order_flow(fast: int = 6, short: int = 18, long: int = DAY) -> Formula:
    s1 = R | {"qv": "greatest(quote_asset_volume, 1e-10)"}
    s2 = {"imb": f"2 * ({clip('(taker_buy_quote_asset_volume / qv)', '0', '1')}) - 1"}
    s3 = {"sf": "imb * qv", "abs_imb": "abs(imb)", "imb_1": lag("imb")}
    s4 = {
        "of_kyle_lambda": f"({cov('r', 'sf', long, short)}) / (({var('sf', long, short)}) + 1e-18)",
        "of_signed_flow_return_corr": corr("r", "sf", long, short),
        "of_toxicity": mean("abs_imb", short, max(2, fast)),
        "of_flow_persistence": corr("imb", "imb_1", long, short),
        "of_flow_imbalance_1d": f"({total('sf', long, short)}) / (({total('qv', long, short)}) + 1e-10)",
        "of_flow_accel": f"({mean('imb', short, 2)}) - ({mean('imb', long, short)})",
    }
    return Formula((s1, s2, s3, s4), tuple(s4))


def momentum_quality(short: int = 6, medium: int = 36, long: int = DAY) -> Formula:
    s2 = {"sg": "CAST(sign(r) AS DOUBLE)", "mom": total("r", medium), "va": f"r / (({std('r', short)}) + 1e-10)"}
    s3 = {
        **{f"mq_trend_consistency_{n}": f"0.5 * (1 + sg * ({mean('sg', w, max(2, w // 2))}))" for n, w in (("short", short), ("medium", medium))},
        "mq_momentum_strength": f"abs({mean('r', long)}) / (({std('r', long)}) + 1e-10)",
        "mq_momentum_acceleration": f"mom - {lag('mom', medium)}",
        "mq_vol_adjusted_momentum": mean("va", short),
    }
    return Formula((R, s2, s3), tuple(s3))


def statistical(w: int = DAY) -> Formula:
    """Sample skewness and excess kurtosis from moments around the window's mean."""
    m = w // 2
    s1 = {"lr": ln(f"close / nullif({lag('close')}, 0)")}
    s2 = {"n": f"CAST(count(lr) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS DOUBLE)", "lr2": "lr * lr", "lr3": "lr * lr * lr", "lr4": "lr * lr * lr * lr"}
    s3 = {f"m{i}": mean(x, w, m) for i, x in enumerate(("lr", "lr2", "lr3", "lr4"), 1)}
    s4 = {"c2": "m2 - m1 * m1", "c3": "m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1", "c4": "m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1"}
    s5 = {
        "st_skew": "CASE WHEN n >= 3 AND c2 > 0 THEN sqrt(n * (n - 1)) / (n - 2) * c3 / power(c2, 1.5) END",
        "st_kurtosis": "CASE WHEN n >= 4 AND c2 > 0 THEN ((n + 1) * (c4 / (c2 * c2) - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) END",
    }
    return Formula((s1, s2, s3, s4, s5), tuple(s5))


def price(periods: tuple[int, int] = (2, 8), days: tuple[int, int] = (DAY, 3 * DAY)) -> Formula:
    s2 = {
        **{f"px_change_pct_{k}periods": change("close", k) for k in periods},
        "px_ret_1d": change("close", days[0]),
        "px_ret_3d": change("close", days[1]),
        "px_volatility_4periods": f"({std('r', 4)}) * {ANNUAL!r}",
        "px_high_low_pct": "(high - low) / nullif(close, 0)",
    }
    return Formula((R, s2), tuple(s2))


def volume(ma: int = DAY) -> Formula:
    s1 = {"v_ma": mean("volume", ma, ma // 4), "dc": f"close - {lag('close')}"}
    s2 = {"vl_volume_ratio": "volume / (v_ma + 1e-10)", "vl_taker_buy_ratio": "taker_buy_base_asset_volume / (volume + 1e-10)"}
    s3 = {"vl_signed_volume_ratio": "sign(dc) * vl_volume_ratio"}
    return Formula((s1, s2, s3), (*s2, *s3))


def moving_average(periods: tuple[int, ...] = (36, 144, 432)) -> Formula:
    s1 = {f"ma_price_vs_sma_{n}": f"close / (({mean('close', w, max(2, w // 2))}) + 1e-10) - 1" for n, w in zip(("short", "medium", "long"), periods)}
    return Formula((s1,), tuple(s1))


def technical_windows(bollinger: int = 120, width: float = 2.0, chandelier: int = 132) -> Formula:
    """The technical indicators that need no recursion: Bollinger position and width, channel distances."""
    s1 = {"bb_mid": mean("close", bollinger), "bb_dev": roll_pop("close", bollinger), "hh": most("high", chandelier, chandelier // 2), "ll": least("low", chandelier, chandelier // 2)}
    s2 = {"bb_position": f"(close - (bb_mid - {width} * bb_dev)) / nullif(2 * {width} * bb_dev, 0)", "bb_width": f"2 * {width} * bb_dev / nullif(bb_mid, 0) * 100", "ch_high_dist": "(close - hh) / (close + 1e-10)", "ch_low_dist": "(ll - close) / (close + 1e-10)"}
    return Formula((s1, s2), tuple(s2))


def roll_pop(x: str, w: int) -> str:
    from panelspark.plans.formula import roll

    return roll(f"stddev_pop({x})", x, w)


def time_of_day(hours: tuple[int, ...] = (0, 8, 16), before: int = 3, bar_minutes: int = 10) -> Formula:
    cycle = 24 * 60 // max(len(hours), 1)
    s1 = {"minute_of_day": "CAST(extract(hour FROM timestamp) * 60 + extract(minute FROM timestamp) AS BIGINT)", "dow": "CAST(weekday(timestamp) AS BIGINT)"}
    near = " OR ".join(f"((({h * 60} - minute_of_day) + 1440) % 1440 BETWEEN 1 AND {before * bar_minutes})" for h in hours)
    s2 = {"since": f"(minute_of_day - {hours[0] * 60} + 1440) % {cycle}"}
    turn = 2 * math.pi
    s3 = {
        "tm_hour_sin": f"sin({turn!r} * minute_of_day / CAST(1440 AS DOUBLE))",
        "tm_hour_cos": f"cos({turn!r} * minute_of_day / CAST(1440 AS DOUBLE))",
        "tm_dow_sin": f"sin({turn!r} * dow / CAST(7 AS DOUBLE))",
        "tm_dow_cos": f"cos({turn!r} * dow / CAST(7 AS DOUBLE))",
        "tm_funding_window": flag(near),
        "tm_funding_dist": f"({cycle} - since) / CAST({bar_minutes} AS DOUBLE)",
        "tm_funding_sin": f"sin({turn!r} * since / CAST({cycle} AS DOUBLE))",
        "tm_funding_cos": f"cos({turn!r} * since / CAST({cycle} AS DOUBLE))",
    }
    return Formula((s1, s2, s3), tuple(s3))


def market_context(w: int = DAY, response: int = 3, long: int = 1008) -> Formula:
    """Needs ``market_factor`` and the daily ``beta_market`` joined onto the bars."""
    s2 = {"mkt_1": lag("market_factor"), "mkt_move": total("market_factor", response), "own_move": total("r", response), "mvol": std("market_factor", w, w // 2)}
    s3 = {
        "mk_corr_market_1d": corr("r", "market_factor", w, w // 2),
        "mk_beta_drift": f"({cov('r', 'market_factor', w, w // 2)}) / (({var('market_factor', w, w // 2)}) + 1e-18) - beta_market",
        "mk_lag_response_gap": "beta_market * mkt_move - own_move",
        "mk_lag_corr_short": corr("r", "mkt_1", w, w // 2),
        "mk_lag_corr_long": corr("r", "mkt_1", long, long // 2),
        "mk_market_ret_1h": total("market_factor", 6),
        "mk_market_vol_1d": f"mvol * {ANNUAL!r}",
        "mk_market_move_z": f"mkt_move / (mvol * {math.sqrt(response)!r} + 1e-18)",
    }
    return Formula((R, s2, s3), tuple(s3))


def capitalisation(w: int = DAY, days: int = 30) -> Formula:
    """Needs ``market_cap`` joined onto the bars."""
    k = days * DAY
    s1 = {"turn": total("quote_asset_volume", w, w // 4), "cap_log_mcap": "ln(greatest(market_cap, 1))", "log_c": ln("close")}
    s2 = {"cap_turnover": "turn / nullif(market_cap, 0)", "cap_supply_inflation": f"(cap_log_mcap - {lag('cap_log_mcap', k)}) - (log_c - {lag('log_c', k)})"}
    return Formula((s1, s2), ("cap_log_mcap", *s2))


def lead_lag(long: int = 1008, gaps: tuple[int, int] = (36, 144), step: int = 6) -> Formula:
    """Needs the leader's return ``leader_r`` joined by timestamp, NULL on the leader's own rows."""
    s2 = {"ll_beta": f"({cov('r', 'leader_r', long, long // 2)}) / (({var('leader_r', long, long // 2)}) + 1e-18)", "leader_step": total("leader_r", step)}
    s3 = {**{f"ll_gap_{g}": f"ll_beta * ({total('leader_r', g)}) - ({total('r', g)})" for g in gaps}, "leader_step_1": lag("leader_step")}
    s4 = {"ll_lag_corr": corr("r", "leader_step_1", long, long // 2)}
    return Formula((R, s2, s3, s4), ("ll_beta", *[f"ll_gap_{g}" for g in gaps], "ll_lag_corr"))


def cumulated(x: str = "residual_return") -> str:
    """Running sum of ``x`` with gaps as zero, NULL before the first value."""
    return f"CASE WHEN {running(f'count({x})')} > 0 THEN {running(f'sum(coalesce({x}, 0))')} END"


def residual_dynamics(lags: tuple[int, ...] = (1, 6, 36, 72, 144), short: int = 36, long: int = DAY, xlong: int = 432, regime: int = 432, calm: float = -0.05) -> Formula:
    """Needs ``residual_return``."""
    x = "residual_return"
    s1 = {**{f"x_{k}": lag(x, k) for k in lags}, "x_mean": mean(x, long), "res_vol_short": std(x, short), "res_vol_long": std(x, long), "up": flag(f"{x} > 0"), "spread": cumulated(x), "x36": total(x, 36)}
    s2 = {"res_zscore": f"({x} - x_mean) / (res_vol_long + 1e-10)", "up_1": lag("up"), **{f"res_autocorr_lag{k}": corr(x, f"x_{k}", max(DAY, 4 * k), max(10, max(DAY, 4 * k) // 2)) for k in lags}, **{f"res_cumsum_{n}": total(x, k) for n, k in (("short", short), ("long", long), ("xlong", xlong))}, "res_ac1_rolling": corr(x, "x_1", regime, regime // 2), "spread_high": most("spread", regime, regime // 2), "spread_low": least("spread", regime, regime // 2), "res_vr": f"({var('x36', regime, regime // 2)}) / (36 * ({var(x, regime, regime // 2)}) + 1e-18)"}
    s3 = {"res_extreme_flag": flag("abs(res_zscore) > 2"), "z_1": lag("res_zscore"), "res_zscore_momentum_4": f"res_zscore - {lag('res_zscore', 4)}", "res_zscore_momentum_8": f"res_zscore - {lag('res_zscore', 8)}", "res_mr_regime": flag(f"res_ac1_rolling < {calm}"), "res_spread_drawdown": "(spread - spread_high) / (res_vol_long + 1e-10)", "res_spread_runup": "(spread - spread_low) / (res_vol_long + 1e-10)", "turn": "CASE WHEN up = up_1 THEN 0 ELSE 1 END", "res_hurst": clip(f"(0.5 + ({ln('res_vr')}) / {2 * math.log(36)!r})", "0", "1")}
    calm_only = lambda v: f"CASE WHEN res_mr_regime = 1 THEN {v} ELSE 0 END"
    s4 = {"dz": "abs(res_zscore - z_1)", "res_zscore_accel": f"res_zscore_momentum_4 - {lag('res_zscore_momentum_4', 4)}", "res_mr_signal": calm_only(f"-{x}"), "res_mr_signal_scaled": calm_only("-res_zscore"), "res_mr_regime_strength": calm_only("-res_ac1_rolling"), "run": running("sum(turn)"), "island": running("sum(res_extreme_flag)")}
    s5 = {"res_reversion_speed": mean("dz", 8), "res_mr_signal_weighted": "res_mr_signal_scaled * res_mr_regime_strength", "res_sign_persistence": "CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY timestamp) AS DOUBLE)", "res_bars_since_extreme": "CASE WHEN island > 0 THEN CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY timestamp) - 1 AS DOUBLE) END"}
    outputs = tuple(c for stage in (s1, s2, s3, s4, s5) for c in stage if c.startswith("res_") and c != "res_vr")
    return Formula((s1, s2, s3, s4, s5), outputs)


def mean_reversion_process(short: int = DAY, long: int = 1008, least_rows: int = 100, x: str = "residual_return", threshold: float = 0.01) -> Formula:
    """Rolling least squares of the change of the cumulated ``x`` on its level, over two windows.

    Speeds are valid in (0, 2]. The long window gives the level it returns to and, from the noise left over,
    the spread it returns with.
    """
    fits = {"short": short, "long": long}
    s1 = {"lv": cumulated(x)}
    s2 = {"lv_1": lag("lv")}
    s3 = {"dv": "lv - lv_1"}
    s4 = {"lv_0": "CASE WHEN dv IS NOT NULL THEN lv_1 END"}
    s5 = {}
    for n, w in fits.items():
        s5 |= {f"b_{n}": f"({cov('dv', 'lv_0', w, least_rows)}) / nullif(({var('lv_0', w, least_rows)}), 0)"}
    s5 |= {"c_l": f"count(dv) {over(rows(long))}", "m_x": mean("lv_0", long, least_rows), "m_y": mean("dv", long, least_rows), "v_y": var("dv", long, least_rows), "v_x": var("lv_0", long, least_rows)}
    s6 = {f"ou_lambda_{n}": f"CASE WHEN -b_{n} > 0 AND -b_{n} <= 2 THEN -b_{n} END" for n in fits}
    s6 |= {"goal": "CASE WHEN abs(b_long) > 1e-12 THEN m_x - m_y / b_long END", "noise": "sqrt(greatest((c_l - 1) * (v_y - b_long * b_long * v_x) / greatest(c_l - 2, 1), 0))"}
    s7 = {f"ou_halflife_{n}": f"CASE WHEN ou_lambda_{n} IS NOT NULL THEN least({LN2!r} / ou_lambda_{n}, {w}) END" for n, w in fits.items()}
    s7 |= {"off": "CASE WHEN ou_lambda_long IS NOT NULL THEN lv - goal END", "ou_regime": flag(f"ou_lambda_long > {threshold}")}
    s8 = {"ou_zscore": "off / (noise / sqrt(2 * ou_lambda_long + 1e-12) + 1e-12)", "ou_expected_change": "-ou_lambda_long * off"}
    s9 = {"ou_signal": "-sign(off) * abs(ou_zscore)"}
    s10 = {"ou_signal_scaled": "ou_signal * ou_lambda_long"}
    outputs = ("ou_lambda_short", "ou_lambda_long", "ou_halflife_short", "ou_halflife_long", "ou_zscore", "ou_expected_change", "ou_signal", "ou_signal_scaled", "ou_regime")
    return Formula((s1, s2, s3, s4, s5, s6, s7, s8, s9, s10), outputs, digits=dict.fromkeys(("ou_halflife_short", "ou_halflife_long", "ou_zscore", "ou_signal", "ou_signal_scaled"), 4))


def space(op: str, a: str, b: str | None = None, k: int = 1) -> str:
    """A signal's raw value: a column, or two columns' spread or ratio, or a column's change over ``k`` rows."""
    if op == "direct":
        return a
    if op == "spread":
        return f"{a} - {b}"
    if op == "ratio":
        return f"{a} / (abs({b}) + 1e-9)"
    if op == "diff":
        return f"{a} - {lag(a, k)}"
    raise ValueError(f"unknown space: {op}")


def same_bucket_seasonality(days: int = 20, least_days: int = 5, bars_per_day: int = DAY, funding_hours: tuple[int, ...] = (0, 8, 16), least_rows: int = 100) -> Formula:
    """Means over the same hour, and over the same hour of the funding cycle, of the last days. Needs ``residual_return``.

    A symbol with fewer than ``least_rows`` values has none.
    """
    x, per_hour, cycle = "residual_return", max(1, bars_per_day // 24), 24 // max(len(funding_hours), 1)
    visits = 24 // cycle * per_hour
    s1 = {"abs_x": f"abs({x})", "hour_no": "extract(hour FROM timestamp)", "known": f"count({x}) OVER (PARTITION BY symbol)"}
    s2 = {"phase_no": f"(hour_no - {funding_hours[0] if funding_hours else 0} + 24) % {cycle}"}
    s3 = {"own_hour": mean(x, days * per_hour, least_days * per_hour, "symbol, hour_no"), "abs_hour": mean("abs_x", days * per_hour, least_days * per_hour, "symbol, hour_no"), "own_phase": mean(x, days * visits, least_days * visits, "symbol, phase_no"), "abs_all": mean("abs_x", days * bars_per_day, least_days * bars_per_day)}
    s4 = {n: f"CASE WHEN known >= {least_rows} THEN {v} END" for n, v in (("sn_tod_res", "own_hour"), ("sn_tod_vol_ratio", "abs_hour / (abs_all + 1e-12)"), ("sn_fph_res", "own_phase"))}
    return Formula((s1, s2, s3, s4), tuple(s4))


def cross_sectional(w: int = DAY, step: int = 6, names: int | None = None) -> Formula:
    """Relative volume, return ranks, dispersion and breadth at each timestamp.

    Breadth is the share of ``names``, all the panel has, that stand above their mean; without that number, of the
    names at the timestamp. Dispersion is averaged over a symbol's own stamps.
    """
    s2 = {"own": f"quote_asset_volume / nullif({mean('quote_asset_volume', w, w // 4)}, 0)", "r6": change("close", step), "r_day": change("close", w), "sma": mean("close", w, w // 2)}
    s3 = {"mid": across_median("own"), "disp": "CASE WHEN count(r) OVER (PARTITION BY timestamp) >= 2 THEN stddev_samp(r) OVER (PARTITION BY timestamp) END", "cs_ret_rank_1h": percent_rank("r6"), "cs_ret_rank_1d": percent_rank("r_day"), "above": flag("close > sma")}
    s4 = {"cs_rel_volume": "own / nullif(mid, 0)", "cs_breadth_sma": "avg(above) OVER (PARTITION BY timestamp)" if names is None else f"sum(above) OVER (PARTITION BY timestamp) / {names}", "cs_dispersion_1h": mean("disp", step, 2)}
    return Formula((R, s2, s3, s4), ("cs_ret_rank_1h", "cs_ret_rank_1d", *s4))


def across_funding() -> Formula:
    """Standing of a name's funding among all names of a timestamp. Needs ``funding_rate``, carried forward."""
    s = {"cs_funding_z": "(funding_rate - avg(funding_rate) OVER (PARTITION BY timestamp)) / nullif(stddev_samp(funding_rate) OVER (PARTITION BY timestamp), 0)"}
    return Formula((s,), tuple(s))


def across_median(x: str) -> str:
    return f"median({x}) OVER (PARTITION BY timestamp)"


def funding(z: int = 1008, low: int = 144, day: int = DAY) -> Formula:
    """Needs ``funding_rate`` on bars, already carried forward from settlement stamps.

    A rate of zero keeps the side of the last one that had a side; before a first flip there is no flip age.
    """
    s1 = {"fr_mean": mean("funding_rate", z, low), "fr_std": std("funding_rate", z, low), "fr_lag_day": lag("funding_rate", day), "own_side": "CASE WHEN funding_rate <> 0 THEN sign(funding_rate) END"}
    s2 = {"fr_zscore": "(funding_rate - fr_mean) / (fr_std + 1e-10)", "fr_ma_7d": "fr_mean", "fr_change_1d": "funding_rate - fr_lag_day", "fr_cum_1d": f"({mean('funding_rate', day, 1)}) * 3", "fr_annual": "funding_rate * 1095", "fr_extreme_high": flag("funding_rate > 0.001"), "fr_extreme_low": flag("funding_rate < -0.0001"), "sided": running("count(own_side)")}
    s3 = {"side": "max(own_side) OVER (PARTITION BY symbol, sided)"}
    s4 = {"side_1": lag("side")}
    s5 = {"flips": running("sum(CASE WHEN side <> side_1 THEN 1 ELSE 0 END)")}
    s6 = {"fr_flip_age": f"CASE WHEN flips > 0 THEN CAST(least({z}, row_number() OVER (PARTITION BY symbol, flips ORDER BY timestamp) - 1) AS DOUBLE) END"}
    return Formula((s1, s2, s3, s4, s5, s6), (*[k for k in s2 if k != "sided"], *s6), digits=dict.fromkeys(["fr_ma_7d", "fr_change_1d", "fr_cum_1d", "fr_zscore"], 10))


def open_interest(z: int = 1008, low: int = 144, w: int = DAY) -> Formula:
    """Needs ``open_interest`` on bars."""
    s1 = R | {"oi_log": "ln(1 + greatest(open_interest, 0))", "oi_mean": mean("open_interest", z, low), "oi_std": std("open_interest", z, low), "oi_change": change("open_interest")}
    s2 = {"oi_zscore": "(open_interest - oi_mean) / (oi_std + 1e-10)", "oi_change_mean": mean("oi_change", z, low), "oi_change_std": std("oi_change", z, low), "oi_relative": "open_interest / (oi_mean + 1e-10)", "r_std": std("r", w)}
    s3 = {"oi_change_z": "(oi_change - oi_change_mean) / (oi_change_std + 1e-10)", "oi_divergence": "CAST(sign(oi_change) * -sign(r) AS DOUBLE)"}
    s4 = {"oi_flush": "greatest(-oi_change_z, 0) * abs(r) / (r_std + 1e-10)"}
    return Formula((s1, s2, s3, s4), ("oi_log", "oi_change", "oi_zscore", "oi_relative", *s3, *s4))


def positioning(z: int = 1008, low: int = 144) -> Formula:
    """Needs ``retail_ls_ratio``, ``toptrader_ls_positions`` and ``taker_buy_sell_ratio`` on bars."""
    names = {"retail": "retail_ls_ratio", "top": "toptrader_ls_positions", "taker": "taker_buy_sell_ratio"}
    s1 = {f"pos_{n}_z": f"({c} - ({mean(c, z, low)})) / (({std(c, z, low)}) + 1e-10)" for n, c in names.items()}
    s2 = {f"pos_{n}": c for n, c in names.items()} | {"pos_retail_minus_top": "retail_ls_ratio - toptrader_ls_positions"}
    return Formula((s1, s2), (*s1, *s2))


def crowding(z: int = 1008, low: int = 144) -> Formula:
    """Funding and open interest both far from their means. Needs ``funding_rate`` and ``open_interest``."""
    both = funding(z, low) + open_interest(z, low)
    return Formula((*both.stages, {"fr_oi_crowding": "fr_zscore * oi_zscore"}), ("fr_oi_crowding",))


FAMILIES = {
    "efficiency": efficiency, "volatility_regime": volatility_regime, "liquidity": liquidity, "range_volatility": range_volatility, "microstructure": microstructure, "order_flow": order_flow,
    "momentum_quality": momentum_quality, "statistical": statistical, "price": price, "volume": volume, "moving_average": moving_average, "technical_windows": technical_windows, "time_of_day": time_of_day, "cross_sectional": cross_sectional,
}
