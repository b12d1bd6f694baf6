"""Books, curves and stores against plain restatements of what they compute."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluation, features, portfolio, reports
from panelspark.plans import formula
from panelspark.plans.formula import Formula
from panelspark.sources.tables import Store


def panel_of(rng, n=700, names=("a", "b", "c")):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=10 * i), s) for s in names for i in range(n)]
    df = pd.DataFrame(rows, columns=["timestamp", "symbol"])
    df["x"] = rng.normal(0, 1e-3, len(df))
    df["y"] = 0.5 * df.x + rng.normal(0, 1e-3, len(df))
    df.loc[rng.random(len(df)) < 0.03, "x"] = np.nan
    df.loc[df.groupby("symbol").cumcount() < 5, "x"] = np.nan
    return df


def spark_panel(spark, df):
    plain = lambda v: v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if isinstance(v, float) and math.isnan(v) else v
    rows = [tuple(map(plain, r)) for r in df.itertuples(index=False)]
    kinds = {"timestamp": "timestamp_ntz", "symbol": "string"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in df.columns))


def result(f, sdf, df):
    got = f.apply(sdf).select("timestamp", "symbol", *f.outputs).toPandas().sort_values(["symbol", "timestamp"], ignore_index=True)
    return got, df.sort_values(["symbol", "timestamp"], ignore_index=True)


def same(got, want, name, atol=1e-7):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-5, atol=atol, equal_nan=True, err_msg=name)


def test_windows_equal_pandas(spark):
    df = panel_of(np.random.default_rng(1), 200)
    w, m = 20, 8
    texts = {"mean": formula.mean("x", w, m), "sum": formula.total("x", w, m), "std": formula.std("x", w, m), "low": formula.least("x", w, m), "high": formula.most("x", w, m), "corr": formula.corr("x", "y", w, m), "cov": formula.cov("x", "y", w, m), "lagged": formula.lag("x", 3), "ahead": formula.forward_sum("x", 4), "run": formula.running("sum(x)"), "z": formula.cross_z("x"), "pr": formula.percent_rank("x"), "demean": formula.cross_demean("x")}
    got, d = result(Formula((texts,), tuple(texts)), spark_panel(spark, df), df)
    g, at = d.groupby("symbol"), d.groupby("timestamp").x
    roll = lambda f: g.x.transform(lambda s: f(s.rolling(w, min_periods=m)))
    pairs = lambda s: s[["x", "y"]].assign(y=s.y.where(s.x.notna()))
    want = {"mean": roll(lambda r: r.mean()), "sum": roll(lambda r: r.sum()), "std": roll(lambda r: r.std()), "low": roll(lambda r: r.min()), "high": roll(lambda r: r.max()), "lagged": g.x.shift(3), "ahead": g.x.transform(lambda s: s.rolling(4).sum().shift(-4)), "run": g.x.transform(lambda s: s.expanding(1).sum()), "z": (d.x - at.transform("mean")) / (at.transform("std") + 1e-10), "pr": at.rank(pct=True), "demean": d.x - at.transform("mean")}
    for name, call in (("corr", lambda p: p.x.rolling(w, min_periods=m).corr(p.y)), ("cov", lambda p: p.x.rolling(w, min_periods=m).cov(p.y))):
        want[name] = pd.concat([call(pairs(s)) for _, s in g]).sort_index()
    for name in texts:
        same(got[name], want[name], name, 1e-9)


def test_residual_dynamics_equal_pandas(spark):
    df = panel_of(np.random.default_rng(2)).rename(columns={"x": "residual_return"}).drop(columns="y")
    got, d = result(features.residual_dynamics(), spark_panel(spark, df), df)
    assert sum(c.startswith("res_") for c in got.columns) == 27
    for _, s in d.groupby("symbol"):
        r, g = s.residual_return.reset_index(drop=True), got.loc[s.index].reset_index(drop=True)
        ac = lambda w, k: r.rolling(w, min_periods=max(10, w // 2)).corr(r.shift(k))
        for k in (1, 6, 36, 72, 144):
            same(g[f"res_autocorr_lag{k}"], ac(max(144, 4 * k), k), f"ac{k}", 1e-6)
        vol = r.rolling(144).std()
        z = (r - r.rolling(144).mean()) / (vol + 1e-10)
        same(g.res_zscore, z, "z")
        same(g.res_cumsum_xlong, r.rolling(432).sum(), "cumsum")
        same(g.res_reversion_speed, z.diff().abs().rolling(8).mean(), "speed")
        up = (r > 0).astype(int)
        runs = (up != up.shift(1)).cumsum()
        same(g.res_sign_persistence, runs.groupby(runs).cumcount() + 1, "persistence")
        ac1 = ac(432, 1)
        calm = ac1 < -0.05
        same(g.res_mr_signal_weighted, np.where(calm, -z * -ac1, 0.0), "weighted")
        same(g.res_mr_signal, np.where(calm, -r, 0.0), "signal")
        spread = r.fillna(0).cumsum().where(r.notna().cumsum() > 0)
        same(g.res_spread_drawdown, (spread - spread.rolling(432, min_periods=216).max()) / (vol + 1e-10), "drawdown")
        far = (z.abs() > 2).cumsum()
        same(g.res_bars_since_extreme, far.groupby(far).cumcount().where(far > 0), "since")
        vr = r.rolling(36).sum().rolling(432, min_periods=216).var() / (36 * r.rolling(432, min_periods=216).var() + 1e-18)
        same(g.res_hurst, (0.5 + np.log(vr) / (2 * np.log(36))).clip(0, 1), "hurst", 1e-6)


def test_mean_reversion_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    df = panel_of(rng, 420, ("a",)).rename(columns={"x": "residual_return"}).drop(columns="y")
    level, steps = 0.0, []
    for _ in range(420):
        step = -0.1 * level + rng.normal(0, 1e-3)
        level += step
        steps.append(step)
    df["residual_return"] = np.where(df.residual_return.isna(), np.nan, steps)
    got, d = result(features.mean_reversion_process(short=120, long=200), spark_panel(spark, df), df)
    x = d.residual_return.fillna(0).cumsum().where(d.residual_return.notna().cumsum() > 0).to_numpy()
    seen = 0
    for t in range(1, 420):
        for name, w in (("short", 120), ("long", 200)):
            at = [i for i in range(max(1, t - w + 1), t + 1) if np.isfinite(x[i - 1]) and np.isfinite(x[i])]
            lam = got[f"ou_lambda_{name}"][t]
            if len(at) < 100:
                assert np.isnan(lam)
                continue
            a, b = x[np.array(at) - 1], np.diff(x)[np.array(at) - 1]
            slope, icpt = np.polyfit(a, b, 1)
            if not 0 < -slope <= 2:
                assert np.isnan(lam)
                continue
            same([lam, got[f"ou_halflife_{name}"][t]], [-slope, min(math.log(2) / -slope, w)], f"lambda {t}", 1e-6)
            if name == "long":
                sigma = math.sqrt(((b - slope * a - icpt) ** 2).sum() / (len(a) - 2))
                off = x[t] + icpt / slope
                z = off / (sigma / math.sqrt(2 * -slope + 1e-12) + 1e-12)
                same([got.ou_zscore[t], got.ou_expected_change[t], got.ou_signal[t], got.ou_signal_scaled[t]], [z, slope * off, -z, -z * -slope], f"z {t}", 1e-6)
                seen += 1
    assert seen > 200


def test_covariance_shrinks_to_the_identity():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5)) @ rng.normal(size=(5, 5))
    x[:60, 4] = np.nan
    got, keep = portfolio.steadied_covariance(x, least=100)
    assert keep.tolist() == [True] * 4 + [False]
    c = x[:, :4] - x[:, :4].mean(axis=0)
    s = c.T @ c / 150
    level = np.trace(s) / 4
    gap = np.linalg.norm(s - level * np.eye(4)) ** 2
    noise = min(gap, sum(np.linalg.norm(np.outer(r, r) - s) ** 2 for r in c) / 150**2)
    want = (1 - noise / gap) * s + noise / gap * level * np.eye(4)
    np.testing.assert_allclose(got, want + np.eye(4) * (1e-12 + 1e-6 * np.trace(want) / 4), rtol=1e-9)
    mixed, _ = portfolio.steadied_covariance(x[:, :4], 0.3)
    assert mixed[0, 1] == pytest.approx(0.7 * np.cov(c.T)[0, 1])


def test_books_hold_their_limits():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 40
        cov, _ = portfolio.steadied_covariance(rng.normal(size=(300, n)))
        loadings = np.column_stack([np.ones(n), rng.normal(1, 0.3, n), np.full(n, np.nan)])
        bands = np.array([0.0, 0.05, 0.0])
        for w in (portfolio.mean_variance(rng.normal(size=n), cov, loadings, 0.08, 1.0, 50, bands), portfolio.rank_book(rng.normal(size=n), loadings, 0.08, 1.0, 50, bands)):
            assert np.abs(w).sum() == pytest.approx(1) and np.abs(w).max() <= 0.0801
            assert abs(w.sum()) < 1e-3 and abs(loadings[:, 1] @ w) <= 0.0515
    tied = portfolio.rank_book(np.array([1.0, 1.0, 2.0, np.nan]), np.ones((4, 1)), 1.0, 1.0)
    np.testing.assert_allclose(tied, [-0.25, -0.25, 0.5, 0], atol=1e-9)


def test_rates_and_captures():
    assert portfolio.trade_rate(10, 1.0, 5.0) == pytest.approx(1 / 3) and portfolio.trade_rate(5, None, half_life=1) == 0.5
    assert portfolio.holding_bars(144, 0.5) == 288 and portfolio.holding_bars(144, 5) == 72 and portfolio.holding_bars(144, None) == 144 and portfolio.holding_bars(144, 1e-6) == 1008
    want = ((1 - 0.9**1) * 1 + (1 - 0.9**3.5) * 2) / 3
    assert portfolio.captured_share([1, 6, 24], [1.0, 3.0, 2.0], 6, 0.1) == pytest.approx(want)
    assert portfolio.captured_share([1], [-1.0], None, 0.1) is None and portfolio.captured_share([], [], None, 0.1) is None
    assert evaluation.persistence(10, 0.5) == 2 and evaluation.capture(None, 0.1) == 1 and evaluation.capture(10, 0.1) == pytest.approx(1 / (1 + math.log(2)))
    assert [evaluation.smoothing_half_life(k) for k in (6, 12, 13, 144, 400, 2000)] == [3, 3, 12, 72, 108, 108]


def test_curves():
    k = np.arange(1, 101)
    fit = evaluation.fit_curve(2 * (1 - 0.5 ** (k / 24)), entries={90: [1.0, 2.0, 4.0]}, n_eff=4)
    assert fit["half_life"] == 24 and fit["peak_k"] >= 98 and fit["a0"] == pytest.approx(1.88, abs=0.02) and fit["median_peak"] == 2 and fit["se_peak"] == pytest.approx(np.std([1, 2, 4], ddof=1) / 2)
    hump = evaluation.fit_curve(np.concatenate([np.linspace(0.1, 1, 20), np.linspace(1, 0.5, 30)]))
    assert 19 <= hump["peak_k"] <= 22 and 0.4 < hump["rev_frac"] < 0.55
    assert evaluation.fit_curve([-1.0, -2.0])["rev_frac"] == 0 and evaluation.fit_curve([]) == {}
    assert evaluation.flipped_curve([1, 6, 24], [-1.0, -4.0, -2.0]) == {"a0": 4.0, "peak_k": 6, "rev_frac": 0.5}
    assert evaluation.thirds_agree([1, 2, 3]) and not evaluation.thirds_agree([9, -1, 2]) and evaluation.thirds_agree([1]) and not evaluation.thirds_agree([0, 0, 0])


def book_panel(rng, names=30, bars=260):
    df = panel_of(rng, bars, tuple(f"s{i:02}" for i in range(names)))
    df["score"] = df.y.fillna(0) * 100
    df["r"] = rng.normal(0, 1e-3, len(df))
    df["volume"] = np.exp(rng.normal(10, 1, len(df)))
    df["funding_rate"] = np.where(rng.random(len(df)) < 0.1, 1e-4, np.nan)
    df["beta"] = 1 + 0.2 * (df.symbol.str[1:].astype(int) % 5)
    return df.drop(columns=["x", "y"]).assign(window=1.0)


def test_backtest_accounts_and_limits(spark):
    df = book_panel(np.random.default_rng(6))
    config = portfolio.BookConfig(loadings=("beta",), bands=(0.0, 0.02), impact=0.25, speed_power=0.5, cluster_scale=1.0, least_bars=100, participation=10.0)
    sdf = spark_panel(spark, df).withColumn("window", F.lit(1).cast("long"))
    got = portfolio.backtest(sdf, config).toPandas().sort_values("timestamp", ignore_index=True)
    assert len(got) == 259
    np.testing.assert_allclose(got.net_return, got.gross_return + got.funding - got.cost, atol=1e-15)
    assert (got.cost >= 0.5 * got.turnover * 5e-4 - 1e-12).all() and (got.cost <= 3 * got.turnover * 5e-4 + 1e-12).all()
    assert (got.gross_exposure <= 1 + 1e-9).all() and got.gross_exposure.iloc[150:].min() > 0.3 and got.net_exposure.abs().max() < 0.05
    assert (got.turnover.iloc[:96] == 0).all()  # a covariance needs its bars first
    early = portfolio.backtest(sdf.where(F.col("timestamp") <= F.lit(got.timestamp[180].to_pydatetime()).cast("timestamp_ntz")), config).toPandas().sort_values("timestamp", ignore_index=True)
    np.testing.assert_allclose(early.net_return, got.net_return[: len(early)], atol=1e-12)


def test_thin_names_cap_what_is_traded(spark):
    df = book_panel(np.random.default_rng(7))
    sdf = spark_panel(spark, df).withColumn("window", F.lit(1).cast("long"))
    config = portfolio.BookConfig(least_bars=2, participation=0.01, book=1e6)
    got = portfolio.backtest(sdf.withColumn("volume", F.lit(1e4)), config).toPandas()
    assert got.turnover.max() <= 30 * 1e4 * 0.01 / 1e6 + 1e-9 and got.turnover.max() > 0


def test_grouped_median(spark):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"g": rng.integers(0, 6, 300), "v": rng.integers(0, 9, 300).astype(float)})
    got = reports.grouped_median(spark.createDataFrame([*map(tuple, df.values.tolist()), (9.0, None)], "g double, v double"), ["g"], "v", "m").toPandas().set_index("g").m
    assert got.to_dict() == df.groupby("g").v.median().to_dict()


def test_store_rewrites_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(f"s{i % 3}", dt.datetime(2024, 1, 1 + i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, v double")
    store.save(df, "bars")
    store.save(df.drop("symbol"), "plain")
    assert [b.num_rows for b in store.batches("bars", rows=5)] == [5, 5, 2]
    first = next(iter(store.batches("bars", rows=12))).to_pylist()
    assert [(r["symbol"], r["timestamp"]) for r in first] == sorted((r[0], r[1]) for r in rows)
    store.save(df.where("false"), "bars", mode="replace", key="symbol", value="s1")
    assert store.symbols("bars") == ["s0", "s2"]
    assert store.remove_symbol("s2") == {"bars": 4} and store.load("bars").count() == 4
    store.save(store.load("bars").where("v > 3"), "bars", mode="replace", key="v", value=0.0)  # the plan reads what it replaces
    assert sorted(r.v for r in store.load("bars").collect()) == [3, 6, 6, 9, 9]
    (tmp_path / "plain").rename(tmp_path / "plain.old")
    assert not store.exists("plain") and store.recover("plain") and store.load("plain").count() == 12 and not store.recover("plain")
    store.clear("plain")
    assert store.load("plain").count() == 0 and set(store.load("plain").columns) == {"timestamp", "v"}
    assert store.tables() == ["bars", "plain"]
