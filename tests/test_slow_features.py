"""Feature families over daily and event data: exact values on made-up series, and no look-ahead."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalars
from panelspark.operators import features, reports, slow_features
from panelspark.operators.joins import clip_spells
from panelspark.sources.tables import normalise_klines


def fine_bars(spark, n=1200):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"timestamp": pd.date_range("2024-01-01 00:01", periods=n, freq="1min"), "symbol": "A", "close": 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, n))), "volume": rng.integers(0, 5, n).astype(float)})
    p["high"], p["low"] = p.close * 1.001, p.close * 0.999
    return spark.createDataFrame(p).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def daily(spark, **columns):
    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=n), "symbol": "A", **columns}))


@pytest.mark.parametrize("build", [lambda b: slow_features.intrabar(b, 600), slow_features.technical])
def test_no_look_ahead(spark, build):
    bars, cut = fine_bars(spark), pd.Timestamp("2024-01-01 13:20")
    at = F.col("timestamp") == F.lit(cut)
    a, b = build(bars).where(at).toPandas(), build(bars.where(F.col("timestamp") <= F.lit(cut))).where(at).toPandas()
    assert len(a) == 1
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_strength_index_is_bounded(spark):
    rsi = slow_features.technical(fine_bars(spark)).toPandas().rs_rsi.dropna()
    assert len(rsi) == 1200 - 83 and rsi.between(0, 100).all()


def test_unlock_countdown(spark):
    pct = [0.0] * 20
    pct[5], pct[12] = 0.05, 0.10
    got = slow_features.unlocks().result(daily(spark, daily_pct=pct)).orderBy("timestamp").toPandas()
    assert got.un_days_to_next[0] == 5 and got.un_days_to_next[5] == 0 and got.un_next_pct[6] == pytest.approx(0.10)
    assert math.isnan(got.un_days_since_last[4]) and got.un_days_since_last[7] == 2 and math.isnan(got.un_days_to_next[13])
    assert got.un_trailing_30d_pct[19] == pytest.approx(0.15)


def test_stable_supply_growth(spark):
    s = [1000 * 1.001**i for i in range(40)]
    flat = [5.0] * 40
    got = slow_features.stablecoins().result(daily(spark, usdt=s, usdc=[0.0] * 40, dai=[0.0] * 40, eth=flat, sol=flat, tron=flat)).orderBy("timestamp").toPandas()
    assert got.sc_total_30d[35] == pytest.approx(1.001**30 - 1, abs=1e-6) and got.sc_eth_7d[20] == 0
    assert got.sc_total_30d.isna().sum() == 31


def test_macro_beta_is_recovered_a_day_late(spark):
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=120))
    res = np.concatenate([[0.0], 3 * np.diff(x)])
    got = slow_features.macro_betas(("x",), 60, 30).result(daily(spark, x=x, res=res)).orderBy("timestamp").toPandas()
    assert got.mb_beta_x.dropna().sub(3).abs().max() < 1e-6 and got.mb_beta_x.isna().sum() == 31


def test_event_hours(spark):
    bars = spark.createDataFrame(pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=5, freq="h"), "symbol": "A"}))
    events = spark.createDataFrame(pd.DataFrame({"event_time": [pd.Timestamp("2024-01-01 02:00")]}))
    got = slow_features.event_timing(bars, events, near_bars=1, bar_seconds=3600).orderBy("timestamp").toPandas()
    assert got.ev_hours_to_event.tolist() == [2, 1, 0, 168, 168]
    assert got.ev_hours_since_event.tolist() == [168, 168, 168, 1, 2]
    assert got.ev_event_window.tolist() == [0, 1, 1, 1, 0]
    none = slow_features.event_timing(bars, events.where("false")).toPandas()
    assert none[["ev_hours_to_event", "ev_hours_since_event", "ev_event_window"]].isna().all().all()


def test_funding_side_and_flip_age(spark):
    rate = [0.0, 0.1, 0.0, 0.2, -0.1, 0.0, -0.2, 0.3, 0.0]
    got = features.funding(z=3, low=1, day=2).result(daily(spark, funding_rate=rate)).orderBy("timestamp").toPandas()
    assert got.fr_flip_age[:4].isna().all() and got.fr_flip_age.tolist()[4:] == [0, 1, 2, 0, 1]


def test_scalars(spark):
    x = spark.createDataFrame([(float("nan"),), (float("inf"),), (-4.0,), (None,)], "x double")
    c = F.col("x")
    got = x.select(scalars.finite(c).alias("f"), scalars.clip(scalars.finite(c), -1, 1).alias("c"), scalars.signed_sqrt(scalars.finite(c)).alias("s"), scalars.positive(c).alias("p")).collect()
    assert [r.f for r in got] == [None, None, -4.0, None] and got[2].c == -1 and got[2].s == -2 and got[3].c is None and got[2].p is None
    assert scalars.finite_columns(x).where("x is null").count() == 3


def test_klines(spark):
    cols = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume"]
    rows = [("1704067200000", "1", "2", "0.5", "1.5", "10", "1704067259999", "15", "3", "4", "6"), ("1704067260000000", "1", "2", "0.5", "1.6", "10", "1704067319999000", "15", "3", "4", "6"), ("1704067320000", "1", "2", "0.5", "", "10", "1704067379999", "15", "3", "4", "6")]
    got = normalise_klines(spark.createDataFrame(rows, cols)).orderBy("timestamp").collect()
    assert [r.close for r in got] == [1.5, 1.6]
    assert got[1].open_time == pd.Timestamp("2024-01-01 00:01:00") and got[0].number_of_trades == 3


def test_spells_are_clipped_at_the_first_trade(spark):
    s = spark.sql("SELECT 'A' AS symbol, TIMESTAMP_NTZ '2024-01-01' AS valid_from, CAST(NULL AS TIMESTAMP_NTZ) AS valid_to")
    f = spark.sql("SELECT 'A' AS symbol, TIMESTAMP_NTZ '2024-02-01' AS first_trade")
    assert clip_spells(s, f, "2023-01-01").first().valid_from == pd.Timestamp("2024-02-01")


def test_funnel_counts(spark):
    led = spark.createDataFrame([(1, 0.1, 0.6, 30), (1, 0.1, 0.2, 30), (1, -0.1, 0.9, 30), (1, 0.1, 0.9, 5)], "roll_id int, net_rate double, capture double, test_days int")
    assert tuple(reports.funnel(led).first()) == (1, 4, 3, 2, 1)
