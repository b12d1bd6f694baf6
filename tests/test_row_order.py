"""Queries against their SQL in one thread where the order of the rows decides: what the review of round 3 found."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelspark.queries import QUERIES, SQL


@pytest.fixture
def same(spark, tmp_path):
    """Hold a query to its SQL, value by value, on events in the given order over several files."""

    def check(name, events, files):
        path = tmp_path / "events.parquet"
        path.mkdir()
        frame = pd.DataFrame(events, columns=["event_id", "ts", "user_id", "value"])
        frame = frame.assign(ts=pd.to_datetime(frame.ts).astype("datetime64[us]"), value=frame.value.astype(float))
        for i, rows in enumerate(np.array_split(np.arange(len(frame)), files)):
            frame.iloc[rows].to_parquet(path / f"{i}.parquet", index=False)
        con = duckdb.connect(config={"threads": 1})  # meets the rows in their order
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        want = con.execute(SQL[name])
        columns = [c[0] for c in want.description]
        want, got = want.fetchall(), [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        key = lambda r: tuple(repr(float(v) + 0.0) if isinstance(v, (int, float)) else str(v) for v in r)
        assert sorted(map(key, got)) == sorted(map(key, want))
        return sorted(map(key, got))

    return check


@pytest.mark.parametrize("files", [1, 3])
def test_supply_takes_the_first_of_rows_with_one_stamp(same, files):
    """Four rows a stamp, the first two without a value for one user; numbers of events run against the rows."""
    rng = np.random.default_rng(3)
    days = [(f"2024-01-0{day} {hour}:00", user, None if user == 5 and row < 2 else rng.integers(1, 99)) for day in (1, 2, 3) for hour in (10, 11) for row in range(4) for user in range(6)]
    odd = [("2024-01-04 10:00", 1, None), ("2024-01-04 10:00", 1, None), (None, 2, 7.0), (None, 2, 8.0)]
    rows = [(len(days) + len(odd) - i, *e) for i, e in enumerate(days + odd)]
    got = same("constant_supply_mcap", rows, files)
    assert len(got) == 20 and [r[2] for r in got].count("None") == 2


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["factor_attribution", "feature_decile_curve", "cs_decile", "feat_unlocks"])
def test_sums_follow_the_rows_not_the_numbers_of_events(same, name, files):
    """Forty users on three days, six values of 200.14 in all each day; numbers of events run against the rows."""
    rng = np.random.default_rng(7)
    cuts = np.sort(rng.integers(1, 20014, size=(3, 40, 5)), axis=-1)
    cents = np.diff(np.concatenate([np.zeros((3, 40, 1), int), cuts, np.full((3, 40, 1), 20014)], axis=-1))
    rest = [(f"2024-01-0{day + 1} 08:00", 40 + user, 7.0 * user + day * day) for day in range(3) for user in range(6)]
    rows = [(f"2024-01-0{day + 1} 0{part}:00", user, cents[day, user, part] / 100) for part in range(6) for day in range(3) for user in range(40)] + rest
    same(name, [(len(rows) - i, *e) for i, e in enumerate(rows)], files)
