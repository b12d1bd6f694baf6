"""Queries against their SQL on small tables of odd values: what the review of round 2 found."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelspark.queries import QUERIES, SQL


@pytest.fixture
def same(spark, tmp_path):
    """Run a query and its SQL on given events, and hold every value to the other's, infinities and NaN included."""

    def check(name, events, split=1):
        path = tmp_path / "events.parquet"
        frame = pd.DataFrame(events, columns=["ts", "user_id", "event_type", "value"]).assign(event_id=lambda e: range(len(e)))
        frame = frame.assign(ts=pd.to_datetime(frame.ts).astype("datetime64[us]"), value=frame.value.astype(float))
        if split == 1:
            frame.to_parquet(path, index=False)
        else:
            path.mkdir()
            for i, rows in enumerate(np.array_split(np.arange(len(frame)), split)):
                frame.iloc[rows].to_parquet(path / f"{i}.parquet", index=False)
        con = duckdb.connect(config={"threads": 1})  # its sums follow the rows' order
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}{'/*.parquet' if split > 1 else ''}'")
        want = con.execute(SQL[name])
        columns = [c[0] for c in want.description]
        want, got = want.fetchall(), [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        key = lambda r: tuple(repr(float(v) + 0.0) if isinstance(v, (int, float)) else str(v) for v in r)
        assert sorted(map(key, got)) == sorted(map(key, want))
        return sorted(map(key, got))

    return check


def test_supply_of_a_worthless_first_close(same):
    rows = same("constant_supply_mcap", [("2024-01-01 10:00", 1, "click", 0.0), ("2024-01-02 10:00", 1, "click", 5.0), ("2024-01-03 10:00", 1, "click", 0.0), ("2024-01-01 10:00", 2, "click", 8.0), ("2024-01-02 10:00", 2, "click", 0.0), ("2024-01-02 11:00", 2, "click", None), ("2024-01-01 10:00", 3, "click", None), ("2024-01-02 10:00", 3, "click", -0.0)])
    assert {r[2] for r in rows} == {"nan", "inf", "1000000.0", "0.0", "None"}


def hourly(values, symbol="click"):
    """Two events an hour, the bar's lowest and highest price."""
    at = pd.date_range("2024-01-01 00:10", periods=len(values), freq="h")
    return [row for t, (a, b) in zip(at, values, strict=True) for row in ((t, 1, symbol, a), (t + pd.Timedelta(minutes=20), 2, symbol, b))]


def test_loadings_of_bars_with_a_zero_price(same):
    prices = [(2.0, 3.0), (0.0, 4.0), (0.0, 0.0), (5.0, 0.0), (-1.0, 0.0)]
    rows = same("feat_factor_loadings", hourly([prices[i * i % 5 if i % 4 else i % 5] for i in range(60)]))
    assert {r[2] for r in rows} >= {"inf", "nan", "1.5"}


def test_positioning_of_bars_with_a_zero_price(same):
    prices = [(2.0 + i % 7, 3.0 + i % 5) for i in range(200)]
    prices[160], prices[170] = (0.0, 4.0), (5.0, 0.0)
    rows = same("feat_positioning", hourly(prices))
    assert "inf" in {v for r in rows for v in r} and "nan" in {v for r in rows for v in r}


@pytest.mark.parametrize("prices", [(60.0, 55.0, 70.0), (60.0, 60.0), (20.0, 20.0), (60.0, 40.0, 55.0), (60.0, None, 55.0), (60.0,)])
def test_performance_without_loss_or_spread(same, prices):
    same("perf_stats", [(f"2024-01-{i + 1:02d}", 1, "click", p) for i, p in enumerate(prices)])


def equal_totals():
    """Forty users on three days, six values of 200.14 in all each day, so that means, ties and cliffs hang on the order of addition."""
    rng = np.random.default_rng(7)
    cuts = np.sort(rng.integers(1, 20014, size=(3, 40, 5)), axis=-1)
    cents = np.diff(np.concatenate([np.zeros((3, 40, 1), int), cuts, np.full((3, 40, 1), 20014)], axis=-1))
    rest = [(f"2024-01-0{day + 1} 08:00", 40 + user, "view", 7.0 * user + day * day) for day in range(3) for user in range(6)]
    return [(f"2024-01-0{day + 1} 0{part}:00", user, "click", cents[day, user, part] / 100) for part in range(6) for day in range(3) for user in range(40)] + rest


@pytest.mark.parametrize("name", ["factor_attribution", "feat_unlocks", "feature_decile_curve", "cs_decile"])
def test_sums_follow_the_order_of_events_over_several_files(same, name):
    same(name, equal_totals(), split=3)


def test_line_tiles_of_the_same_lines_are_one(spark):
    """op7: lines that share all their buckets are compared once; a line alone in its buckets is in no tile."""
    from panelspark.llm import linededup

    rows = [(h, 70, bytearray(range(72))) for h in (1, 2)] + [(3, 70, bytearray(range(100, 172)))]
    got = linededup.tiles(spark.createDataFrame(rows, "h long, chars long, values binary")).collect()
    assert sorted(r.h for r in got) == [1, 2] and len({r.tile for r in got}) == 1
