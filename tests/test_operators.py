"""Operators held to definitions on small data of their own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluation, events, factors, joins, portfolio
from panelspark.operators.discovery import allocate, net_rate, select_survivors
from panelspark.operators.features import FAMILIES
from panelspark.plans import dsl
from panelspark.sources.tables import Store, apply_filters


def bars(n=260, symbols=3, seed=42):
    rng, rows = np.random.default_rng(seed), []
    for s in range(symbols):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, n)))
        for i in range(n):
            rows.append((pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=10 * i), f"S{s}", close[i] * 0.999, close[i] * 1.002, close[i] * 0.997, close[i], 10.0 + i % 7, 1000.0 + i, 5 + i % 3, 4.0, 400.0))
    names = ["timestamp", "symbol", "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume"]
    return pd.DataFrame(rows, columns=names)


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(bars()).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).cache()


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_no_feature_looks_ahead(panel, family):
    formula = FAMILIES[family]()
    cut = pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=10 * 200)
    whole = formula.result(panel).where(F.col("timestamp") == F.lit(cut)).toPandas().sort_values("symbol", ignore_index=True)
    short = formula.result(panel.where(F.col("timestamp") <= F.lit(cut))).where(F.col("timestamp") == F.lit(cut)).toPandas().sort_values("symbol", ignore_index=True)
    pd.testing.assert_frame_equal(whole, short, check_dtype=False)


def test_formulas_combine(panel):
    both = FAMILIES["price"]() + FAMILIES["volume"]()
    assert set(both.outputs) <= set(both.apply(panel).columns)


def test_rolling_moments_match_pandas(panel):
    got = FAMILIES["statistical"](48).result(panel).toPandas().sort_values(["symbol", "timestamp"], ignore_index=True)
    p = bars().sort_values(["symbol", "timestamp"], ignore_index=True)
    r = p.groupby("symbol").close.transform(lambda c: np.log(c / c.shift(1)))
    want = r.groupby(p.symbol).transform(lambda x: x.rolling(48, min_periods=24).skew())
    np.testing.assert_allclose(got.st_skew.astype(float), want, atol=1e-4, equal_nan=True)


def test_rank_ic_is_spearman(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"timestamp": np.repeat(pd.date_range("2024-01-01", periods=5), 40), "symbol": np.tile([f"s{i}" for i in range(40)], 5), "signal": rng.integers(0, 9, 200).astype(float)})
    p["tgt"] = 0.3 * p.signal + rng.normal(size=200)
    got = evaluation.rank_ic(spark.createDataFrame(p)).toPandas().set_index("timestamp").ic.sort_index()
    want = p.groupby("timestamp").apply(lambda g: g.signal.rank().corr(g.tgt.rank()), include_groups=False)
    np.testing.assert_allclose(got, want, atol=1e-10)


def test_constant_signal_has_no_ic(spark):
    p = pd.DataFrame({"timestamp": pd.Timestamp("2024-01-01"), "symbol": [f"s{i}" for i in range(12)], "signal": 1.0, "tgt": np.arange(12.0)})
    assert evaluation.rank_ic(spark.createDataFrame(p)).first().ic is None


def test_asof_matches_pandas_and_takes_equal_times(spark):
    left = pd.DataFrame({"k": [1, 1, 2, 3], "t": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 03:00", "2024-01-01 01:00", "2024-01-01 00:00"]), "id": [1, 2, 3, 4]})
    right = pd.DataFrame({"k": [1, 1, 2], "t": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 02:00", "2024-01-01 02:00"]), "v": [10.0, 20.0, 30.0]})
    got = joins.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", ["v"]).toPandas().set_index("id").v
    assert got[1] == 10 and got[2] == 20 and pd.isna(got[3]) and pd.isna(got[4])
    strict = joins.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", ["v"], strict=True).toPandas().set_index("id").v
    assert pd.isna(strict[1]) and strict[2] == 20


def test_planted_loadings_are_recovered(spark):
    rng = np.random.default_rng(1)
    n = 20 * 144
    m, s = rng.normal(0, 2e-3, n), rng.normal(0, 2e-3, n)
    p = pd.DataFrame({"timestamp": pd.date_range("2024-01-01", periods=n, freq="10min"), "symbol": "A", "m": m, "s": s, "r": 1.3 * m - 0.5 * s + rng.normal(0, 1e-3, n)})
    b = factors.daily_betas(spark.createDataFrame(p), ["m", "s"]).toPandas()
    assert abs(b.beta_m.mean() - 1.3) < 0.05 and abs(b.beta_s.mean() + 0.5) < 0.08
    assert len(b) == 13


def test_rank_weights_have_gross_one_on_each_side(spark):
    c = spark.createDataFrame([("2024-01-01", f"s{i}", float(i)) for i in range(7)] + [("2024-01-02", "s0", 1.0)], "date string, symbol string, x double")
    w = factors.rank_weights(c, "x").toPandas()
    assert set(w.date) == {"2024-01-01"}
    assert w.weight[w.weight > 0].sum() == pytest.approx(1) and w.weight[w.weight < 0].sum() == pytest.approx(-1)


def test_triggers_and_cooldown(spark):
    d = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=8).date, "symbol": "a", "x": [np.nan, 1, 1, 5, 1, 5, 5, 1.0]})
    df = spark.createDataFrame(d).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    below = events.triggers(df, "x", "below", 3)
    assert [r.date.day for r in below.orderBy("date").collect()] == [2, 5, 8]
    assert [r.date.day for r in events.triggers(df, "x", "cross_below", 3).orderBy("date").collect()] == [5, 8]
    assert [r.date.day for r in events.cooldown(below, 3).orderBy("date").collect()] == [2, 8]


def test_mean_variance_is_neutral_and_capped():
    rng = np.random.default_rng(2)
    cov, keep = portfolio.steadied_covariance(rng.normal(size=(200, 12)))
    assert keep.all() and (np.linalg.eigvalsh(cov) > 0).all()
    w = portfolio.mean_variance(rng.normal(size=12), cov, np.ones((12, 1)), 0.3, 1.0)
    assert abs(w.sum()) < 1e-8 and np.abs(w).max() <= 0.3 + 1e-12
    assert (portfolio.mean_variance(np.zeros(12), cov, np.ones((12, 1)), 0.3, 1.0) == 0).all()


def test_clusters_need_three_members():
    c = np.eye(6)
    c[:3, :3], c[3:5, 3:5] = 0.8, 0.8
    assert portfolio.clusters(c).tolist() == [0, 0, 0, -1, -1, -1]


def test_shuffle_control_deals_the_same_scores(spark):
    s = spark.createDataFrame([(1, f"s{i}", float(i)) for i in range(20)], "timestamp int, symbol string, score double")
    a = portfolio.controlled(s, "shuffle").toPandas()
    assert sorted(a.score) == list(map(float, range(20)))
    assert a.sort_values("symbol").score.tolist() != list(map(float, range(20)))


def test_programs_are_validated_and_round_trip(panel):
    p = dsl.Program(("sub", ("roll_mean", ("col", "close"), 36), ("col", "open")), (("gt", ("col", "volume"), 12.0),))
    assert dsl.Program.from_json(p.to_json()) == p and len(p.identity) == 16
    dsl.validate(p, panel.columns)
    for bad in (("roll_mean", ("col", "close"), 7), ("nope", ("col", "close")), ("col", "missing"), ("add", ("col", "close"))):
        with pytest.raises(dsl.InvalidProgram):
            dsl.validate(dsl.Program(bad), panel.columns)
    assert dsl.causal(panel, p)
    text = "[" + p.to_json() + ", " + p.to_json()[:-5]
    assert dsl.parse_programs(text) == [p]


def test_gate_closes_to_neutral(panel):
    p = dsl.Program(("neg", ("col", "close")), (("gt", ("col", "volume"), 1e9),))
    assert dsl.signals(panel, {"x": p}).agg(F.max(F.abs("x"))).first()[0] == 0


def test_random_programs_are_valid_and_seeded(panel):
    known = ["close", "open", "volume"]
    a, b = (dsl.RandomProposer(3).propose(20, known) for _ in range(2))
    assert [p.identity for p in a] == [p.identity for p in b] and len(a) == 20
    assert len(dsl.RandomProposer(4).propose(10, known, a)) == 10


def test_search_helpers():
    assert net_rate({1: 0.5, 10: 2.0}, 1.0) == pytest.approx(0.1)
    assert allocate({"a": [1.0, 1.0], "b": [0.0]}, ["a", "b", "c"], 3)["c"] >= 1
    c = [{"hash": h, "reward": r, "columns": ["x"]} for h, r in (("p", 3), ("q", 2), ("s", 1))]
    kept = select_survivors(c, lambda a, b: 0.9 if {a, b} == {"p", "q"} else 0.0, 2)
    assert [k["hash"] for k in kept] == ["p", "s"]


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "symbol string, d int, x double")
    assert store.load("t").count() == 0 and not store.exists("t")
    store.save(a, "t")
    store.save(spark.createDataFrame([("A", 2, 7)], "symbol string, d int, y int"), "t", "append")
    assert store.count("t") == 3 and store.has_columns("t", ["x", "y"]) and store.symbols("t") == ["A", "B"]
    store.save(spark.createDataFrame([("A", 9, 9.0)], "symbol string, d int, x double"), "t", "replace", "symbol", "A")
    assert sorted(r.d for r in store.load("t", {"symbol": "A"}).collect()) == [9]
    assert store.delete_rows("t", {"symbol": "B"}) == 1 and store.count("t") == 1
    assert apply_filters(a, {"x": [(">", 0), ("<", 2)]}).count() == 1
    store.drop("t")
    assert store.tables() == []
    with pytest.raises(ValueError):
        store.path("../x")


def test_false_discovery_rates(spark):
    p = spark.createDataFrame([(0.001,), (0.02,), (0.5,), (None,)], "p double")
    assert sorted(r.discovered for r in evaluation.false_discovery(p, rate=0.05).collect()) == [False, False, True, True]
    assert sum(r.discovered for r in evaluation.false_discovery(p, rate=0.05, arbitrary=True).collect()) == 1
