"""Queries of the panel operators for the driver contract, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.functions.scalars import ieee_div
from panelspark.operators import discovery, evaluation, events, factors, features, joins, portfolio, reports, slow_features
from panelspark.operators.panels import DAYS_SQL, bars_sql, calendar, carried, densify, event_bars, event_trades, last_in_bucket, ohlcv, strided, table, table_in_order, user_days, user_days_in_order
from panelspark.plans import dsl
from panelspark.plans.formula import Formula, across, average_rank, beta, change, corr, cross_z, forward_sum, lag, mean, most, percent_rank, running, std, total
from panelspark.sources.tables import apply_filters, complete_days, complete_months, duplicate_keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def formula_query(name: str, formula: Formula, source: Callable[[SparkSession, str], DataFrame], ctes: str, cte: str) -> None:
    query(f"WITH {ctes} {formula.sql(cte)}", name)(lambda spark, d: formula.result(source(spark, d)))


BARS = bars_sql()

# ---- storage -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND l_quantity < 20 AND l_linestatus = 'O'")
def storage_filter_grammar(spark, d):
    kept = apply_filters(table(spark, d, "lineitem"), {"l_returnflag": ("in", ["A", "R"]), "l_quantity": [(">=", 10), ("<", 20)], "l_linestatus": "O"})
    return kept.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment NOT IN ('BUILDING') AND c_nationkey != 3 AND c_acctbal > 0")
def storage_filter_negations(spark, d):
    return apply_filters(table(spark, d, "customer"), {"c_mktsegment": ("not in", ["BUILDING"]), "c_nationkey": ("!=", 3), "c_acctbal": (">", 0)}).select("c_custkey", "c_name")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def storage_duplicate_keys(spark, d):
    return duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_type AS symbol, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2, day(last_day(ts)) HAVING count(*) >= day(last_day(ts)) * 50 * 0.9")
def storage_month_completeness(spark, d):
    return complete_months(table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp")), 50)


@query("SELECT event_type AS symbol, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 80 * 0.75")
def storage_day_completeness(spark, d):
    return complete_days(table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp")), 80)


@query("""SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS extra FROM nation WHERE n_regionkey != 1
UNION ALL SELECT n_nationkey, upper(n_name), n_regionkey, n_nationkey * 2 FROM nation WHERE n_regionkey = 1""")
def storage_replace_partition(spark, d):
    old = table(spark, d, "nation")
    new = old.where("n_regionkey = 1").select("n_nationkey", F.upper("n_name").alias("n_name"), "n_regionkey", (F.col("n_nationkey") * 2).alias("extra"))
    return old.where("n_regionkey != 1").unionByName(new, allowMissingColumns=True)


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def storage_table_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- resampling ----------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT timestamp, symbol, open, high, low, close, volume, round(quote_asset_volume, 4) AS quote_asset_volume, number_of_trades FROM bars")
def resample_ohlc(spark, d):
    return rounded(event_bars(spark, d), "quote_asset_volume", digits=4).select("timestamp", "symbol", "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades")


@query(f"WITH {bars_sql(600)} SELECT timestamp, symbol, open, high, low, close, volume FROM bars")
def resample_ten_minutes(spark, d):
    return ohlcv(event_trades(spark, d), 600).select("timestamp", "symbol", "open", "high", "low", "close", "volume")


GRID = """ends AS (SELECT min(timestamp) AS a, max(timestamp) AS b FROM bars), grid AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS timestamp FROM ends),
dense AS (SELECT g.timestamp, s.symbol, b.close, b.volume FROM grid g CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.timestamp = g.timestamp AND b.symbol = s.symbol)"""


@query(f"WITH {BARS}, {GRID} SELECT timestamp, symbol, close, volume FROM dense")
def grid_densify(spark, d):
    return densify(event_bars(spark, d).select("timestamp", "symbol", "close", "volume"), 3600)


@query(f"WITH {BARS}, {GRID} SELECT timestamp, symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM dense")
def resample_last_ffill(spark, d):
    trades = event_trades(spark, d)
    last = last_in_bucket(trades, 3600, "price").withColumnRenamed("price", "close")
    return carried(densify(last, 3600), ["close"]).select("timestamp", "symbol", "close")


CAL = """cal AS (SELECT CAST(c.day AS DATE) AS date, s.symbol FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS day FROM events) c CROSS JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol FROM events) s),
daily AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol, sum(value) AS x FROM events GROUP BY 1, 2),
filled AS (SELECT c.date, c.symbol, last_value(x IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS x FROM cal c LEFT JOIN daily d ON d.date = c.date AND d.symbol = c.symbol)"""


@query(f"WITH {CAL} SELECT date, symbol, round(lag(x, 1) OVER (PARTITION BY symbol ORDER BY date), 6) AS x FROM filled")
def calendar_ffill_shift(spark, d):
    daily = user_days(spark, d).select(F.to_date("timestamp").alias("date"), "symbol", "x")
    return rounded(calendar(daily, ["x"], 7, 1), "x")


@query(f"WITH {BARS} SELECT timestamp, symbol, close FROM bars WHERE timestamp IN (SELECT timestamp FROM (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS n FROM (SELECT DISTINCT timestamp FROM bars)) WHERE n % 6 = 0)")
def strided_stamps(spark, d):
    return strided(event_bars(spark, d).select("timestamp", "symbol", "close"), 6)


@query(f"WITH {bars_sql(600)} SELECT timestamp, symbol, close FROM bars WHERE timestamp = date_trunc('hour', timestamp)")
def screening_grid(spark, d):
    b = ohlcv(event_trades(spark, d), 600)
    return b.where(F.col("timestamp") == F.date_trunc("hour", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")).select("timestamp", "symbol", "close")


@query("WITH days AS (SELECT CAST(ts AS DATE) AS date, event_type AS symbol, sum(CASE WHEN value > 100 THEN value END) AS x, arg_max(value, ts) AS last_value FROM events GROUP BY 1, 2) SELECT date, symbol, round(x, 6) AS x, last_value FROM days")
def daily_fold_min_count(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("symbol")).agg(F.sum(F.when(F.col("value") > 100, F.col("value"))).alias("x"), F.max_by("value", "ts").alias("last_value"))
    return rounded(g, "x")


@query("SELECT CAST(m AS DATE) AS train_start, CAST(m + INTERVAL 12 MONTH AS DATE) AS select_start, CAST(m + INTERVAL 15 MONTH AS DATE) AS oos_start, CAST(m + INTERVAL 16 MONTH AS DATE) AS oos_end FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate) - INTERVAL 16 MONTH, INTERVAL 1 MONTH)) AS m FROM orders)")
def roll_calendar(spark, d):
    ends = table(spark, d, "orders").agg(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    months = ends.select(F.explode(F.sequence("a", F.add_months("b", -16), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select(F.col("m").alias("train_start"), *[F.add_months("m", k).alias(n) for k, n in ((12, "select_start"), (15, "oos_start"), (16, "oos_end"))])


# ---- joins ---------------------------------------------------------------------------------------

CLICKS = "clicks AS (SELECT user_id, ts, value AS click_value FROM events WHERE event_type = 'click'), buys AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"


def clicks_and_buys(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("click_value"))


@query(f"WITH {CLICKS} SELECT b.event_id, b.user_id, b.ts, c.ts AS matched_at, c.click_value FROM buys b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts >= c.ts")
def asof_backward(spark, d):
    buys, clicks = clicks_and_buys(spark, d)
    return joins.asof(buys, clicks, ["user_id"], "ts", ["click_value"])


@query(f"WITH {CLICKS}, j AS (SELECT b.event_id, b.user_id, b.ts, c.ts AS m, c.click_value AS v FROM buys b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts >= c.ts) SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(m) <= 86400000000 THEN m END AS matched_at, CASE WHEN epoch_us(ts) - epoch_us(m) <= 86400000000 THEN v END AS click_value FROM j")
def asof_bounded(spark, d):
    buys, clicks = clicks_and_buys(spark, d)
    return joins.asof_bounded(buys, clicks, ["user_id"], "ts", ["click_value"], 86400)


@query(f"WITH {BARS}, errs AS (SELECT ts AS event_time FROM events WHERE event_type = 'error' AND value > 150) SELECT timestamp, symbol, (SELECT max(event_time) FROM errs WHERE event_time < timestamp) AS previous_event, (SELECT min(event_time) FROM errs WHERE event_time >= timestamp) AS next_event FROM bars")
def next_previous_event(spark, d):
    e = table(spark, d, "events").where("event_type = 'error' AND value > 150").select(F.col("ts").alias("event_time"))
    return joins.neighbours(event_bars(spark, d).select("timestamp", "symbol"), e)


@query("WITH e AS (SELECT event_id, user_id, ts AS event_time FROM events WHERE event_type = 'error') SELECT e.event_id, e.user_id, e.event_time, x.ts AS timestamp, x.value FROM e JOIN events x ON x.user_id = e.user_id AND x.ts > e.event_time AND x.ts <= e.event_time + INTERVAL 6 HOUR")
def event_window_join(spark, d):
    e = table(spark, d, "events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").alias("event_time"))
    return joins.event_windows(errors, e.select("user_id", F.col("ts").alias("timestamp"), "value"), ["user_id"], 6 * 3600)


SPELLS = "spells AS (SELECT CAST(user_id AS VARCHAR) AS symbol, min(ts) AS valid_from, CASE WHEN user_id % 3 = 0 THEN NULL ELSE min(ts) + INTERVAL 10 DAY END AS valid_to FROM events GROUP BY user_id)"


def spells_of(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("valid_from"))
    return g.select(F.col("user_id").cast("string").alias("symbol"), "valid_from", F.when(F.col("user_id") % 3 != 0, F.col("valid_from") + F.expr("INTERVAL 10 DAYS")).alias("valid_to"))


@query(f"WITH {DAYS_SQL}, {SPELLS} SELECT d.timestamp, d.symbol, round(d.x, 6) AS x FROM days d JOIN spells s ON s.symbol = d.symbol WHERE s.valid_from <= d.timestamp AND (s.valid_to IS NULL OR d.timestamp < s.valid_to)")
def membership_interval(spark, d):
    return rounded(joins.members(user_days(spark, d).select("timestamp", "symbol", "x"), spells_of(spark, d)), "x")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_row_per_key(spark, d):
    return joins.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT 'with' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    sides = [c.join(o, "c_custkey", how).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n") for side, how in (("with", "left_semi"), ("without", "left_anti"))]
    return sides[0].unionByName(sides[1])


@query("WITH a AS (SELECT CAST(ts AS DATE) AS date, count(*) AS clicks FROM events WHERE event_type = 'click' AND value > 150 GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS date, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 150 GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, clicks, errors FROM a FULL OUTER JOIN b ON a.date = b.date")
def outer_daily_merge(spark, d):
    e = table(spark, d, "events").where("value > 150 AND event_type IN ('click', 'error')")
    g = e.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("c"), F.count(F.when(F.col("event_type") == "error", 1)).alias("e"))
    return g.select("date", F.when(F.col("c") > 0, F.col("c")).alias("clicks"), F.when(F.col("e") > 0, F.col("e")).alias("errors"))


@query("SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def lookup_map(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select("o_orderkey", "c_mktsegment", "n_name")


@query("WITH a AS (SELECT user_id, sum(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, sum(value) AS y FROM events WHERE event_type = 'view' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(x, 0) + coalesce(y, 0), 4) AS total FROM a FULL OUTER JOIN b ON a.user_id = b.user_id")
def aligned_add(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(F.col("event_type") == t).groupBy("user_id").agg(F.sum("value").alias(n)) for t, n in (("click", "x"), ("view", "y")))
    return a.join(b, "user_id", "full_outer").select("user_id", F.round(F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)), 4).alias("total"))


@query(f"WITH {SPELLS}, cur AS (SELECT DISTINCT CAST(user_id + 5 AS VARCHAR) AS symbol FROM events) SELECT s.symbol, s.valid_from, CASE WHEN s.valid_to IS NULL AND s.symbol NOT IN (SELECT symbol FROM cur) THEN TIMESTAMP '2024-02-01' ELSE s.valid_to END AS valid_to FROM spells s UNION ALL SELECT symbol, TIMESTAMP '2024-02-01', NULL FROM cur WHERE symbol NOT IN (SELECT symbol FROM spells WHERE valid_to IS NULL)")
def membership_evolution(spark, d):
    current = table(spark, d, "events").select((F.col("user_id") + 5).cast("string").alias("symbol")).distinct()
    return joins.evolve_spells(spells_of(spark, d), current, "2024-02-01")


# ---- aggregations --------------------------------------------------------------------------------


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean_qty, round(median(l_quantity), 6) AS median_qty, round(stddev_samp(l_quantity), 6) AS sd_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1")
def agg_named(spark, d):
    t, keys = table(spark, d, "lineitem"), ["l_suppkey"]
    g = t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"), F.avg("l_quantity").alias("mean_qty"), F.stddev_samp("l_quantity").alias("sd_qty"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    # A distinct count beside other aggregates would multiply all rows, an exact median would hold a group's
    # values: both start from counts by value.
    parts = t.groupBy(*keys, "l_partkey").count().groupBy(*keys).agg(F.count("l_partkey").alias("parts"))
    median = reports.grouped_median(t, keys, "l_quantity", "median_qty")
    out = g.join(parts, keys).join(median, keys, "left").select(*keys, "n", "parts", "total", "mean_qty", "median_qty", "sd_qty", "first_ship", "last_ship")
    return rounded(rounded(out, "mean_qty", "median_qty", "sd_qty"), "total", digits=2)


@query("SELECT event_type, round(stddev_samp(value), 6) AS sample, round(stddev_pop(value), 6) AS population, round(sum(value * CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END), 4) AS weighted FROM events GROUP BY 1")
def agg_moments_weighted(spark, d):
    sign = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    g = table(spark, d, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sample"), F.round(F.stddev_pop("value"), 6).alias("population"), F.round(F.sum(F.col("value") * sign), 4).alias("weighted"))
    return g


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_keep_first(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id", "value")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def most_common(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@query("SELECT CAST(unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS DOUBLE) AS q, round(unnest(v), 6) AS value FROM (SELECT quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS v FROM events)")
def quantiles(spark, d):
    return rounded(reports.quantiles(table(spark, d, "events"), "value"), "value")


@query("SELECT CAST(ts AS DATE) AS date, round(product(1 + value / 100000) - 1, 8) AS compounded FROM events GROUP BY 1")
def compounded_return(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.round(F.product(1 + F.col("value") / 100000) - 1, 8).alias("compounded"))


@query("SELECT date, coalesce(sum(v) FILTER (k = 'click'), 0) AS click, coalesce(sum(v) FILTER (k = 'view'), 0) AS view FROM (SELECT CAST(ts AS DATE) AS date, event_type AS k, CAST(1 AS DOUBLE) AS v FROM events) GROUP BY 1")
def pivot_counts(spark, d):
    e = table(spark, d, "events").where("true").groupBy(F.to_date("ts").alias("date")).pivot("event_type", ["click", "view"]).agg(F.sum(F.lit(1.0)))
    return e.na.fill(0.0)


@query("SELECT event_type, k, round(v, 6) AS v FROM (SELECT event_type, unnest(['lo', 'hi']) AS k, unnest([min(value), max(value)]) AS v FROM events GROUP BY 1)")
def stack_wide_to_long(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rounded(g.unpivot("event_type", ["lo", "hi"], "k", "v"), "v")


@query("SELECT symbol, timestamp, round(x, 6) AS x FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS timestamp, value AS x FROM events WHERE event_type = 'click' UNION ALL SELECT CAST(user_id AS VARCHAR), ts, NULL FROM events WHERE event_type = 'error')")
def union_by_name(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"), F.col("value").alias("x"))
    b = e.where("event_type = 'error'").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("symbol"))
    return rounded(a.unionByName(b, allowMissingColumns=True), "x")


@query("SELECT 'both' AS k, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) UNION ALL SELECT 'only', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60)")
def set_operations(spark, d):
    e = table(spark, d, "events")
    a, b = e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'error' AND value > 60").select("user_id")
    rows = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, x in (("both", a.intersect(b)), ("only", a.subtract(b)))]
    return rows[0].unionByName(rows[1])


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def top_per_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("n", F.row_number().over(w)).where("n <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


# ---- windows -------------------------------------------------------------------------------------

RET = {"r": change("close")}


def bars_formula(name: str, stages: dict[str, str], **kw) -> None:
    formula_query(name, Formula((RET, stages), tuple(stages), **kw), event_bars, BARS, "bars")


bars_formula("rolling_mean", {"m6": mean("close", 6, 3), "m36": mean("close", 36)})
bars_formula("rolling_std", {"s36": std("r", 36, 12), "s144": std("r", 144)})
bars_formula("rolling_sum", {"s6": total("r", 6, 2), "n36": total("volume", 36)})
bars_formula("rolling_minmax", {"hi": most("high", 144, 72), "lo": f"least({lag('low')}, low)"})
bars_formula("rolling_corr", {"c": corr("r", "volume", 144, 72)})
bars_formula("rolling_beta", {"b": beta("r", "volume", 144, 72)})
bars_formula("rolling_zscore", {"z": f"(r - ({mean('r', 36, 18)})) / (({std('r', 36, 18)}) + 1e-10)"})
bars_formula("lag_lead_diff", {"d3": f"close - {lag('close', 3)}", "p6": change("close", 6), "ahead": "lead(close, 1) OVER (PARTITION BY symbol ORDER BY timestamp)"})
bars_formula("forward_sum", {"f1": forward_sum("r", 1), "f6": forward_sum("r", 6), "f144": forward_sum("r", 144)})
bars_formula("cumulative", {"total": running("sum(r)"), "peak": running("max(close)"), "n": f"CAST({running('count(r)')} AS DOUBLE)"})
formula_query("day_anchored_vwap", Formula(({"day": "CAST(timestamp AS DATE)", "pv": "close * volume"}, {"vwap": f"{running('sum(pv)', 'symbol, day')} / {running('sum(volume)', 'symbol, day')}"}, {"dev": "close / vwap - 1"}), ("vwap", "dev"), digits={"vwap": 9, "dev": 9}), event_bars, BARS, "bars")
formula_query("island_age", Formula((RET, {"big": "CASE WHEN abs(r) > 2 THEN 1 ELSE 0 END"}, {"island": running("sum(big)")}, {"age": "CASE WHEN island > 0 THEN CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY timestamp) - 1 AS DOUBLE) END"}), ("age",)), event_bars, BARS, "bars")
bars_formula("same_bucket_rolling", {"hour_mean": mean("r", 10, 3, "symbol, extract(hour FROM timestamp)")})
bars_formula("cs_rank", {"pct": percent_rank("r"), "rank": average_rank("r")})
bars_formula("cs_zscore", {"z": cross_z("r")})
bars_formula("cs_demean", {"x": f"r - {across('avg(r)')}", "mid": across("median(r)")})
formula_query("minimum_slice", Formula((RET, {"z": f"(r - ({mean('r', 6, 3)})) / (({std('r', 6, 3)}) + 1e-10)"}, {"rank": percent_rank("z")}), ("z", "rank")), event_bars, BARS, "bars")


@query(f"WITH {DAYS_SQL} SELECT timestamp, symbol, round(sum(x) OVER (PARTITION BY symbol ORDER BY timestamp RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW), 6) AS x10 FROM days")
def range_days_sum(spark, d):
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000
    days = user_days(spark, d).withColumn("_s", at.cast("long"))
    return days.select("timestamp", "symbol", F.round(F.sum("x").over(Window.partitionBy("symbol").orderBy("_s").rangeBetween(-9 * 86400, 0)), 6).alias("x10"))


@query(f"WITH {DAYS_SQL} SELECT timestamp, symbol, CAST(greatest(1, least(10, ceil((rank() OVER (PARTITION BY timestamp ORDER BY y) + (count(*) OVER (PARTITION BY timestamp, y) - 1) / 2.0) / count(*) OVER (PARTITION BY timestamp) * 10))) AS INTEGER) AS decile FROM days")
def cs_decile(spark, d):
    return user_days_in_order(spark, d).select("timestamp", "symbol", evaluation.decile(F.col("y"), "timestamp").alias("decile"))


@query("WITH w AS (SELECT CAST(ts AS DATE) AS date, sum(value) AS x FROM events GROUP BY 1) SELECT date, ntile(3) OVER (ORDER BY date) AS third, round(x, 4) AS x FROM w")
def chronological_thirds(spark, d):
    w = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.sum("value").alias("x"))
    return rounded(w.withColumn("third", F.ntile(3).over(Window.orderBy("date")).cast("long")), "x", digits=4).select("date", "third", "x")


@query(f"WITH {BARS}, w AS (SELECT timestamp, symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS n FROM bars) SELECT a.timestamp, a.symbol, round(sum(b.close * power(0.5, (a.n - b.n) / 12.0)) / sum(power(0.5, (a.n - b.n) / 12.0)), 6) AS ewm FROM w a JOIN w b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY 1, 2")
def ewm_exact(spark, d):
    return rounded(evaluation.smoothed(event_bars(spark, d), "close", 12), "ewm")


# ---- the expression language ---------------------------------------------------------------------

X = ("col", "close")
PROGRAMS = {
    "neg": ("neg", X), "abs": ("abs", ("col", "r")), "sign": ("sign", ("col", "r")), "square": ("square", ("col", "r")), "sqrt": ("sqrt", ("col", "r")), "log1p": ("log1p", ("col", "r")), "tanh": ("tanh", ("col", "r")),
    "add": ("add", ("col", "r"), ("cs_rank", X)), "sub": ("sub", ("col", "high"), ("col", "low")), "mul": ("mul", ("col", "r"), ("col", "volume")), "div": ("div", ("col", "r"), ("col", "volume")),
    "roll_mean": ("roll_mean", ("col", "r"), 6), "roll_std": ("roll_std", ("col", "r"), 36), "roll_sum": ("roll_sum", ("col", "r"), 36), "roll_zscore": ("roll_zscore", X, 36), "roll_delta": ("roll_delta", X, 6),
    "cs_rank": ("cs_rank", ("roll_mean", X, 6)), "cs_zscore": ("cs_zscore", X), "cs_demean": ("cs_demean", ("roll_std", X, 36)),
    "where": ("where", ("gt", ("col", "r"), 0.0), X, ("neg", X)), "gt": ("where", ("gt", ("col", "volume"), 3.0), ("col", "r"), ("tanh", X)), "lt": ("where", ("lt", ("col", "volume"), 3.0), ("col", "r"), X),
    "abs_gt": ("where", ("abs_gt", ("col", "r"), 0.5), ("cs_rank", X), ("col", "r")), "abs_lt": ("where", ("abs_lt", ("cs_zscore", X), 1.0), X, ("col", "open")),
}


def returns_panel(spark, d):
    return Formula((RET,), ("r",)).apply(event_bars(spark, d))


for _name, _expr in PROGRAMS.items():
    _f = dsl.compile_expression(_expr)
    formula_query(f"dsl_{_name}", Formula((RET, *_f.stages), _f.outputs), event_bars, BARS, "bars")

SIGNALS = {
    "plain": dsl.Program(("roll_zscore", ("col", "r"), 36)),
    "gated": dsl.Program(("cs_rank", ("roll_mean", ("col", "r"), 6)), (("gt", ("col", "volume"), 1.0), ("abs_lt", ("col", "r"), 3.0))),
    "shared": dsl.Program(("sub", ("roll_zscore", ("col", "r"), 36), ("roll_mean", ("col", "r"), 6))),
}
_f = dsl.compile_signals(SIGNALS)
formula_query("dsl_signals", Formula((RET, *_f.stages), _f.outputs), event_bars, BARS, "bars")


# ---- features ------------------------------------------------------------------------------------

for _name, _family in features.FAMILIES.items():
    formula_query(f"feat_{_name}", _family(), event_bars, BARS, "bars")

MARKET = """rets AS (SELECT *, close / nullif(lag(close, 1) OVER (PARTITION BY symbol ORDER BY timestamp), 0) - 1 AS r0 FROM bars),
mkt AS (SELECT timestamp, CASE WHEN count(r0) >= 3 THEN avg(r0) END AS market_factor FROM rets WHERE r0 IS NOT NULL GROUP BY 1)"""


def with_market(spark, d):
    bars = event_bars(spark, d)
    m = factors.market_factor(Formula((RET,), ("r",)).apply(bars), 3).select("timestamp", "market_factor")
    return bars.join(m, "timestamp", "left")


formula_query("feat_market_context", features.market_context(), lambda s, d: with_market(s, d).withColumn("beta_market", F.lit(1.0)), f"{BARS}, {MARKET}, src AS (SELECT b.*, m.market_factor, CAST(1 AS DOUBLE) AS beta_market FROM bars b LEFT JOIN mkt m ON m.timestamp = b.timestamp)", "src")
formula_query("feat_capitalisation", features.capitalisation(days=1), lambda s, d: event_bars(s, d).withColumn("market_cap", F.col("close") * 1000 + F.col("volume")), f"{BARS}, src AS (SELECT *, close * 1000 + volume AS market_cap FROM bars)", "src")


def with_leader(spark, d):
    bars = Formula((RET,), ("r",)).apply(event_bars(spark, d))
    leader = bars.where("symbol = 'click'").select("timestamp", F.col("r").alias("leader_r"))
    return bars.drop("r").join(leader, "timestamp", "left").withColumn("leader_r", F.when(F.col("symbol") != "click", F.col("leader_r")))


formula_query("feat_lead_lag", features.lead_lag(432), with_leader, f"{BARS}, rets AS (SELECT *, close / nullif(lag(close, 1) OVER (PARTITION BY symbol ORDER BY timestamp), 0) - 1 AS r0 FROM bars), lead_r AS (SELECT timestamp, r0 FROM rets WHERE symbol = 'click'), src AS (SELECT b.*, CASE WHEN b.symbol <> 'click' THEN l.r0 END AS leader_r FROM bars b LEFT JOIN lead_r l ON l.timestamp = b.timestamp)", "src")


def with_residual(spark, d):
    return with_market(spark, d).transform(lambda b: Formula((RET,), ("r",)).apply(b)).withColumn("residual_return", F.col("r") - F.col("market_factor")).drop("r", "market_factor")


RESIDUAL = f"{BARS}, {MARKET}, src AS (SELECT r.* EXCLUDE (r0), r.r0 - m.market_factor AS residual_return FROM rets r LEFT JOIN mkt m ON m.timestamp = r.timestamp)"
formula_query("feat_residual_dynamics", features.residual_dynamics(), with_residual, RESIDUAL, "src")


@query(f"""WITH {RESIDUAL}, h AS (SELECT *, hour(timestamp) AS hr, hour(timestamp) % 8 AS ph, abs(residual_return) AS ar, count(residual_return) OVER (PARTITION BY symbol) >= 100 AS ok FROM src),
m AS (SELECT timestamp, symbol, ok, CASE WHEN count(residual_return) OVER a >= 3 THEN avg(residual_return) OVER a END AS t, CASE WHEN count(ar) OVER a >= 3 THEN avg(ar) OVER a END AS ta, CASE WHEN count(ar) OVER c >= 72 THEN avg(ar) OVER c END AS al, CASE WHEN count(residual_return) OVER b >= 9 THEN avg(residual_return) OVER b END AS p
  FROM h WINDOW a AS (PARTITION BY symbol, hr ORDER BY timestamp ROWS 9 PRECEDING), b AS (PARTITION BY symbol, ph ORDER BY timestamp ROWS 29 PRECEDING), c AS (PARTITION BY symbol ORDER BY timestamp ROWS 239 PRECEDING)),
dd AS (SELECT symbol, CAST(timestamp AS DATE) AS day, sum(residual_return) AS s FROM src GROUP BY 1, 2),
dw AS (SELECT symbol, day, CASE WHEN count(s) OVER w >= 2 THEN avg(s) OVER w END AS s FROM dd WINDOW w AS (PARTITION BY symbol, dayofweek(day) ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT timestamp, m.symbol, CASE WHEN ok THEN round(t, 6) END AS sn_tod_res, CASE WHEN ok THEN round(ta / (al + 1e-12), 6) END AS sn_tod_vol_ratio, CASE WHEN ok THEN round(p, 6) END AS sn_fph_res, CASE WHEN ok THEN round(s, 6) END AS sn_dow_res FROM m JOIN dw ON dw.symbol = m.symbol AND dw.day = CAST(m.timestamp AS DATE)""")
def feat_seasonality(spark, d):
    return rounded(slow_features.seasonality(with_residual(spark, d), days=10, least_days=3, bars_per_day=24), "sn_tod_res", "sn_tod_vol_ratio", "sn_fph_res", "sn_dow_res")


@query(f"""WITH {RESIDUAL}, ev AS (SELECT ts AS event_time FROM events WHERE event_type = 'error' AND value > 200),
d AS (SELECT symbol, CAST(timestamp AS DATE) AS day, sum(abs(residual_return)) AS a, sum(quote_asset_volume) AS v FROM src GROUP BY 1, 2),
r AS (SELECT symbol, day, a, v / (CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END + 1e-10) AS q, day IN (SELECT CAST(event_time AS DATE) FROM ev) AS e FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING)),
t AS (SELECT *, CASE WHEN e AND a IS NOT NULL AND count(a) OVER ea >= 2 THEN avg(a) OVER ea END AS ta, CASE WHEN e AND q IS NOT NULL AND count(q) OVER eq >= 2 THEN avg(q) OVER eq END AS tq, CASE WHEN count(a) OVER b >= 4 THEN avg(a) OVER b END AS ba, CASE WHEN count(q) OVER b >= 4 THEN avg(q) OVER b END AS bq
  FROM r WINDOW ea AS (PARTITION BY symbol, e AND a IS NOT NULL ORDER BY day ROWS 3 PRECEDING), eq AS (PARTITION BY symbol, e AND q IS NOT NULL ORDER BY day ROWS 3 PRECEDING), b AS (PARTITION BY symbol ORDER BY day ROWS 9 PRECEDING)),
f AS (SELECT symbol, day, last_value(ta IGNORE NULLS) OVER o / (ba + 1e-18) AS ra, last_value(tq IGNORE NULLS) OVER o / (bq + 1e-18) AS rq FROM t WINDOW o AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)),
g AS (SELECT symbol, day, lag(ra) OVER o AS ra, lag(rq) OVER o AS rq FROM f WINDOW o AS (PARTITION BY symbol ORDER BY day)),
pr AS (SELECT s.symbol, event_time, coalesce(sum(residual_return), 0) AS p FROM ev JOIN src s ON s.timestamp > event_time AND s.timestamp <= event_time + INTERVAL 24 HOUR GROUP BY 1, 2),
tr AS (SELECT symbol, event_time + INTERVAL 24 HOUR AS avail, CASE WHEN count(*) OVER w >= 2 THEN avg(p) OVER w END AS drift FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY event_time ROWS 3 PRECEDING)),
k AS (SELECT symbol, timestamp, count(residual_return) OVER (PARTITION BY symbol) >= 50 AS ok FROM src)
SELECT k.timestamp, k.symbol, CASE WHEN ok THEN round(ra, 6) END AS mb_event_vol_ratio, CASE WHEN ok THEN round(rq, 6) END AS mb_event_volume_ratio, CASE WHEN ok THEN round(drift, 6) END AS mb_event_drift
FROM k LEFT JOIN g ON g.symbol = k.symbol AND g.day = CAST(k.timestamp AS DATE) ASOF LEFT JOIN tr ON tr.symbol = k.symbol AND k.timestamp >= tr.avail""")
def feat_event_reactions(spark, d):
    e = table(spark, d, "events").where("event_type = 'error' AND value > 200").select(F.col("ts").alias("event_time"))
    r = slow_features.event_reactions(with_residual(spark, d), e, k=4, least=2, base=(10, 4), own=(5, 2), least_rows=50)
    return rounded(r, "mb_event_vol_ratio", "mb_event_volume_ratio", "mb_event_drift")


@query(f"""WITH {DAYS_SQL}, caps AS (SELECT CAST(timestamp AS DATE) AS date, symbol, x AS c FROM days WHERE n > 1 OR CAST(symbol AS INTEGER) % 3 = 0),
grid AS (SELECT d.date, s.symbol FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS date FROM days) d, (SELECT DISTINCT symbol FROM caps) s),
held AS (SELECT g.date, g.symbol, arg_max(c, caps.date) AS c FROM grid g JOIN caps ON caps.symbol = g.symbol AND caps.date BETWEEN g.date - 4 AND g.date - 1 GROUP BY 1, 2),
rk AS (SELECT date, symbol, (rank() OVER (PARTITION BY date ORDER BY c) + (count(*) OVER (PARTITION BY date, c) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS r FROM held)
SELECT timestamp, days.symbol, round(r, 6) AS cs_mcap_rank FROM days LEFT JOIN rk ON rk.symbol = days.symbol AND rk.date = CAST(timestamp AS DATE)""")
def feat_cap_rank(spark, d):
    u = user_days(spark, d)
    caps = u.where("n > 1 OR CAST(symbol AS INT) % 3 = 0").select(F.to_date("timestamp").alias("date"), "symbol", F.col("x").alias("market_cap"))
    return rounded(slow_features.cap_rank(u, caps, limit=3), "cs_mcap_rank")


@query(f"WITH {BARS}, m AS (SELECT timestamp, avg(close - open) AS a, stddev_samp(close - open) AS s FROM bars GROUP BY 1) SELECT b.timestamp, symbol, round((close - open - a) / nullif(s, 0), 6) AS cs_funding_z FROM bars b JOIN m ON m.timestamp = b.timestamp")
def feat_across_funding(spark, d):
    return features.across_funding().result(event_bars(spark, d).withColumn("funding_rate", F.col("close") - F.col("open")))


@query(f"""WITH {BARS}, c AS (SELECT timestamp, symbol, (close - open) / 9973 AS f, quote_asset_volume + 1 AS o FROM bars),
z AS (SELECT timestamp, symbol, CASE WHEN count(f) OVER w >= 20 THEN (f - avg(f) OVER w) / (stddev_samp(f) OVER w + 1e-10) END AS fz, CASE WHEN count(o) OVER w >= 20 THEN (o - avg(o) OVER w) / (stddev_samp(o) OVER w + 1e-10) END AS oz FROM c WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS 99 PRECEDING))
SELECT timestamp, symbol, round(fz * oz, 6) AS fr_oi_crowding FROM z""")
def feat_crowding(spark, d):
    bars = event_bars(spark, d).withColumns({"funding_rate": (F.col("close") - F.col("open")) / 9973, "open_interest": F.col("quote_asset_volume") + 1})
    return features.crowding(100, 20).result(bars)


formula_query("feat_ou_process", features.mean_reversion_process(), with_residual, RESIDUAL, "src")
formula_query("signal_spaces", Formula(({"spread": features.space("spread", "close", "open"), "ratio": features.space("ratio", "close", "volume"), "diff": features.space("diff", "close", k=6), "direct": features.space("direct", "high")},), ("spread", "ratio", "diff", "direct")), event_bars, BARS, "bars")


@query(f"WITH {BARS} SELECT timestamp, symbol, round(close, 6) AS close FROM bars WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-09 22:00:00'")
def window_slice(spark, d):
    return rounded(joins.window_slice(event_bars(spark, d), "2024-01-05", "2024-01-10", 12).select("timestamp", "symbol", "close"), "close")


@query(f"WITH {DAYS_SQL}, f AS (SELECT symbol, min(timestamp) AS first FROM days GROUP BY 1) SELECT d.timestamp, d.symbol, round(x, 6) AS x FROM days d JOIN f ON f.symbol = d.symbol WHERE d.timestamp >= first + INTERVAL 5 DAY")
def listing_age_gate(spark, d):
    u = user_days(spark, d)
    return rounded(portfolio.old_enough(u, u, 5).select("timestamp", "symbol", "x"), "x")


@query("WITH o AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT symbol, max(date) AS date FROM o WHERE date <= DATE '1997-06-30' GROUP BY 1) SELECT o.symbol, o.date, round(v, 2) AS v FROM o JOIN l ON l.symbol = o.symbol AND l.date = o.date WHERE o.date >= DATE '1997-06-25'")
def fresh_latest(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("v"))
    return rounded(joins.fresh_latest(o, "1997-06-30"), "v", digits=2)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, upper(n_name) || '!' FROM nation WHERE n_regionkey >= 3")
def merge_only_new(spark, d):
    n = table(spark, d, "nation")
    stored = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return joins.only_new(stored, n.select(F.col("n_nationkey").alias("k"), F.concat(F.upper("n_name"), F.lit("!")).alias("name")), "k")


@query("WITH best AS (SELECT o_custkey % 50 AS symbol, arg_max(o_orderkey, o_totalprice * 1e10 + o_orderkey) AS id FROM orders WHERE o_orderkey NOT IN (1, 2, 3) GROUP BY 1) SELECT CAST(symbol AS VARCHAR) AS symbol, CAST(CASE WHEN symbol % 10 = 0 THEN -1 WHEN symbol % 10 = 1 THEN -2 ELSE id END AS VARCHAR) AS id FROM best")
def resolved_ids(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("symbol"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("market_cap"))
    names = o.select("symbol").distinct()
    last = F.col("symbol").cast("int") % 10
    manual, cached = names.where(last == 0).withColumn("id", F.lit("-1")), names.where(last <= 1).withColumn("id", F.lit("-2"))
    return joins.resolved_ids(names, manual, cached, o, ["1", "2", "3"])


formula_query("feat_funding", features.funding(), lambda s, d: event_bars(s, d).withColumn("funding_rate", (F.col("close") - F.col("open")) / 9973), f"{BARS}, src AS (SELECT *, (close - open) / 9973 AS funding_rate FROM bars)", "src")
formula_query("feat_open_interest", features.open_interest(), lambda s, d: event_bars(s, d).withColumn("open_interest", F.col("quote_asset_volume") + 1), f"{BARS}, src AS (SELECT *, quote_asset_volume + 1 AS open_interest FROM bars)", "src")
formula_query("feat_positioning", features.positioning(), lambda s, d: event_bars(s, d).withColumns({"retail_ls_ratio": ieee_div(F.col("high"), F.col("low")), "toptrader_ls_positions": ieee_div(F.col("open"), F.col("close")), "taker_buy_sell_ratio": F.col("taker_buy_base_asset_volume") / F.col("volume")}), f"{BARS}, src AS (SELECT *, high / low AS retail_ls_ratio, open / close AS toptrader_ls_positions, taker_buy_base_asset_volume / volume AS taker_buy_sell_ratio FROM bars)", "src")


@query(f"WITH {BARS}, f AS ({features.price().sql('bars')}) SELECT round(avg(CASE WHEN px_ret_1d IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS px_ret_1d, round(avg(CASE WHEN px_ret_3d IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS px_ret_3d FROM f")
def feature_coverage(spark, d):
    f = features.price().result(event_bars(spark, d))
    return f.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in ("px_ret_1d", "px_ret_3d")])


# ---- features of daily and event data ------------------------------------------------------------

MACRO_COLUMNS = {"rates2y": "click", "rates10y": "view", "dollar": "signup", "vix": "error", "breakeven10": "purchase"}
MACRO_SQL = f"daily AS (SELECT date_trunc('day', ts)::TIMESTAMP AS timestamp, 'all' AS symbol, {', '.join(f"avg(value) FILTER (event_type = '{e}') AS {c}" for c, e in MACRO_COLUMNS.items())}, sum(value) AS fed_bs, CAST(count(*) AS DOUBLE) AS rrp, sum(value) + 1 AS stables_mcap, max(value) AS fear_greed, avg(value) / 100 AS dominance, CASE WHEN max(value) > 300 THEN 1 ELSE 0 END AS is_event, avg(value) / 50 - 1 AS res FROM events GROUP BY 1)"


def macro_days(spark, d):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    v = F.col("value")
    means = [F.avg(F.when(F.col("event_type") == e, v)).alias(c) for c, e in MACRO_COLUMNS.items()]
    g = table(spark, d, "events").groupBy(day.alias("timestamp")).agg(*means, F.sum(v).alias("fed_bs"), F.count("*").cast("double").alias("rrp"), (F.sum(v) + 1).alias("stables_mcap"), F.max(v).alias("fear_greed"), (F.avg(v) / 100).alias("dominance"), F.when(F.max(v) > 300, 1).otherwise(0).alias("is_event"), (F.avg(v) / 50 - 1).alias("res"))
    return g.withColumn("symbol", F.lit("all"))


formula_query("feat_macro_state", slow_features.macro_state(20, 5), macro_days, MACRO_SQL, "daily")
formula_query("feat_macro_betas", slow_features.macro_betas(w=15, least=8), macro_days, MACRO_SQL, "daily")
formula_query("feat_stablecoins", slow_features.stablecoins(), lambda s, d: macro_days(s, d).select("timestamp", "symbol", *[F.col(a).alias(b) for a, b in (("fed_bs", "usdt"), ("rates2y", "usdc"), ("vix", "dai"), ("dollar", "eth"), ("breakeven10", "sol"), ("rates10y", "tron"))]), f"{MACRO_SQL}, src AS (SELECT timestamp, symbol, fed_bs AS usdt, rates2y AS usdc, vix AS dai, dollar AS eth, breakeven10 AS sol, rates10y AS tron FROM daily)", "src")
formula_query("feat_unlocks", slow_features.unlocks(0.02), lambda s, d: user_days_in_order(s, d).select("timestamp", "symbol", (F.col("x") / 10007).alias("daily_pct")), f"{DAYS_SQL}, src AS (SELECT timestamp, symbol, x / 10007 AS daily_pct FROM days)", "src")
formula_query("feat_developers", slow_features.developers(3, 5), lambda s, d: user_days(s, d).select("timestamp", "symbol", F.col("x").alias("all_devs"), F.col("y").alias("full_time_devs"), F.col("n").cast("double").alias("exclusive_devs")), f"{DAYS_SQL}, src AS (SELECT timestamp, symbol, x AS all_devs, y AS full_time_devs, CAST(n AS DOUBLE) AS exclusive_devs FROM days)", "src")
formula_query("feat_factor_loadings", slow_features.loadings(24, 48), lambda s, d: event_bars(s, d).select("timestamp", "symbol", ieee_div(F.col("high"), F.col("low")).alias("beta_market"), ieee_div(F.col("low"), F.col("high")).alias("r_squared")), f"{BARS}, src AS (SELECT timestamp, symbol, high / low AS beta_market, low / high AS r_squared FROM bars)", "src")


@query(f"WITH {DAYS_SQL}, f AS (SELECT symbol, min(timestamp) + INTERVAL 2 DAY AS first_trade FROM days GROUP BY 1), a AS (SELECT d.timestamp, d.symbol, CASE WHEN date_diff('day', CAST(first_trade AS DATE), CAST(d.timestamp AS DATE)) >= 0 THEN CAST(date_diff('day', CAST(first_trade AS DATE), CAST(d.timestamp AS DATE)) AS DOUBLE) END AS x FROM days d JOIN f ON f.symbol = d.symbol) SELECT timestamp, symbol, x AS ls_days_listed, CASE WHEN x IS NOT NULL THEN CASE WHEN x <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS ls_is_young FROM a")
def feat_listing_age(spark, d):
    u = user_days(spark, d)
    return slow_features.listing_age(u, u.groupBy("symbol").agg((F.min("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("first_trade")), 10)


EV_HOURS = "(epoch_us({0}) - epoch_us({1})) / 3.6e9::DOUBLE"


@query(f"""WITH {BARS}, ev AS (SELECT ts AS event_time, event_type FROM events WHERE value > 200), n AS (SELECT timestamp, symbol, (SELECT max(event_time) FROM ev WHERE event_time < timestamp) AS p, (SELECT min(event_time) FROM ev WHERE event_time >= timestamp) AS q FROM bars),
h AS (SELECT timestamp, symbol, coalesce({EV_HOURS.format("q", "timestamp")}, 168) AS a, coalesce({EV_HOURS.format("timestamp", "p")}, 168) AS b FROM n)
SELECT timestamp, symbol, {", ".join(f"CASE WHEN CAST(timestamp AS DATE) IN (SELECT CAST(event_time AS DATE) FROM ev WHERE event_type = '{k}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ev_{k}_day" for k in ("error", "signup", "view"))},
round(least(168.0::DOUBLE, a), 6) AS ev_hours_to_event, round(least(168.0::DOUBLE, b), 6) AS ev_hours_since_event, CASE WHEN a <= 6 OR b <= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ev_event_window FROM h""")
def feat_event_timing(spark, d):
    e = table(spark, d, "events").where("value > 200").select(F.col("ts").alias("event_time"), "event_type")
    return rounded(slow_features.event_timing(event_bars(spark, d), e, bar_seconds=3600, kinds=("error", "signup", "view")), "ev_hours_to_event", "ev_hours_since_event")


FINE = bars_sql(600)
INTRA = f"""{FINE}, l1 AS (SELECT *, CASE WHEN close > 0 THEN ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY timestamp), 0)) END AS lr, close * volume AS xpv, CAST(timestamp AS DATE) AS day FROM bars),
l2 AS (SELECT *, lag(lr) OVER (PARTITION BY symbol ORDER BY timestamp) AS lr_1, sum(xpv) OVER (PARTITION BY symbol, day ORDER BY timestamp) AS cum_pv, sum(volume) OVER (PARTITION BY symbol, day ORDER BY timestamp) AS cum_v FROM l1),
l3 AS (SELECT *, {corr("lr", "lr_1", 60, 30)} AS ac FROM l2),
src AS (SELECT make_timestamp(CAST(ceil(epoch_us(timestamp) / (21600 * 1e6)) AS BIGINT) * 21600 * 1000000) AS timestamp, symbol, coalesce(sum(lr * lr), 0) AS rv, max(abs(lr)) AS max_abs, sum(volume) AS v, sum(volume * volume) AS v2, sum(CASE WHEN volume <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zero, CAST(count(*) AS DOUBLE) AS n, last(close ORDER BY timestamp) AS close, last(cum_pv ORDER BY timestamp) AS pv, last(cum_v ORDER BY timestamp) AS cv, last(ac ORDER BY timestamp) AS ib_autocorr_1m FROM l3 GROUP BY 1, 2)"""


@query(f"WITH {INTRA} {slow_features.INTRABAR(4).sql('src')}")
def feat_intrabar(spark, d):
    return slow_features.intrabar(ohlcv(event_trades(spark, d), 600).select("timestamp", "symbol", "close", "volume"), 21600, 4)


@query()
def feat_technical(spark, d):
    return rounded(slow_features.technical(event_bars(spark, d)), "rs_rsi", "mc_macd_histogram", "at_atr", "dm_di_plus", "dm_di_minus", "dm_adx")


@query()
def feat_cluster_relative(spark, d):
    p = with_residual(spark, d).select("timestamp", "symbol", "residual_return")
    return rounded(slow_features.cluster_relative(p, "residual_return", slow_features.residual_clusters(p, "residual_return", -1.0, 2)), "cs_cluster_z")


# ---- factors -------------------------------------------------------------------------------------

PANEL = f"{DAYS_SQL}, p AS (SELECT timestamp, symbol, y AS signal, x AS char, lead(y, 1) OVER (PARTITION BY symbol ORDER BY timestamp) - y AS tgt FROM days)"


def cross_panel(spark, d, days=user_days):
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return days(spark, d).select("timestamp", "symbol", F.col("y").alias("signal"), F.col("x").alias("char"), (F.lead("y").over(w) - F.col("y")).alias("tgt"))


@query(f"WITH {PANEL} SELECT timestamp, round(CASE WHEN count(tgt) >= 10 THEN avg(tgt) END, 6) AS market_factor, count(tgt) AS n_members FROM p WHERE tgt IS NOT NULL GROUP BY 1")
def factor_market(spark, d):
    return rounded(factors.market_factor(cross_panel(spark, d), 10, "tgt"), "market_factor")


WEIGHTS = f"{PANEL}, rk AS (SELECT timestamp, symbol, -(row_number() OVER (PARTITION BY timestamp ORDER BY char, symbol) - (count(*) OVER (PARTITION BY timestamp) + 1) / 2.0) AS w FROM p), wt AS (SELECT timestamp, symbol, CAST(w / sum(CASE WHEN w > 0 THEN w END) OVER (PARTITION BY timestamp) AS DOUBLE) AS lw, CAST(w / sum(CASE WHEN w < 0 THEN -w END) OVER (PARTITION BY timestamp) AS DOUBLE) AS sw, w FROM rk), weights AS (SELECT timestamp, symbol, CASE WHEN w > 0 THEN lw ELSE sw END AS weight FROM wt WHERE lw IS NOT NULL AND sw IS NOT NULL)"


@query(f"WITH {WEIGHTS} SELECT timestamp, symbol, round(weight, 8) AS weight FROM weights")
def factor_rank_weights(spark, d):
    return rounded(factors.rank_weights(cross_panel(spark, d), "char", low_is_long=True, by="timestamp"), "weight", digits=8)


@query(f"WITH {WEIGHTS} SELECT p.timestamp, round(sum(CASE WHEN weight > 0 THEN weight * tgt END) / nullif(sum(CASE WHEN weight > 0 THEN weight END), 0) - sum(CASE WHEN weight < 0 THEN -weight * tgt END) / nullif(sum(CASE WHEN weight < 0 THEN -weight END), 0), 6) AS size_factor, count(tgt) AS n_size_factor FROM p JOIN weights w ON w.timestamp = p.timestamp AND w.symbol = p.symbol WHERE tgt IS NOT NULL GROUP BY 1")
def factor_rank_spread(spark, d):
    panel = cross_panel(spark, d)
    return rounded(factors.spread_factor(panel, factors.rank_weights(panel, "char", True, "timestamp"), "size_factor", "timestamp", "tgt"), "size_factor")


formula_query("residual_forward_targets", Formula(({"fwd_10min": forward_sum("residual_return", 1), "fwd_1h": forward_sum("residual_return", 6), "fwd_1d": forward_sum("residual_return", 144)},), ("fwd_10min", "fwd_1h", "fwd_1d")), with_residual, RESIDUAL, "src")


@query(f"WITH {BARS}, {MARKET}, src AS (SELECT r.*, m.market_factor, r.r0 - m.market_factor AS e FROM rets r LEFT JOIN mkt m ON m.timestamp = r.timestamp) SELECT symbol, round(var_samp(e) / var_samp(r0), 6) AS variance_ratio, round(corr(e, market_factor), 6) AS factor_corr, count(e) AS n FROM src GROUP BY 1")
def acceptance_checks(spark, d):
    p = Formula((RET,), ("r",)).apply(with_market(spark, d)).withColumn("residual_return", F.col("r") - F.col("market_factor"))
    return rounded(factors.acceptance(p), "variance_ratio", "factor_corr")


@query(f"""WITH {BARS}, rets AS (SELECT timestamp, symbol, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY timestamp), 0) - 1 AS r0 FROM bars),
d AS (SELECT CAST(timestamp AS DATE) AS date, symbol, sum(CASE WHEN r0 > -1 THEN ln(1 + r0) END) AS lr, sum(r0 * r0) AS sq FROM rets GROUP BY 1, 2), a AS (SELECT *, lr - avg(lr) OVER (PARTITION BY date) AS adj FROM d),
b AS (SELECT *, avg(CASE WHEN symbol IN ('click', 'view') THEN adj END) OVER (PARTITION BY date) AS anc FROM a)
SELECT date, symbol, CASE WHEN count(lr) OVER m >= 5 THEN round(sum(lr) OVER m, 6) END AS momentum, CASE WHEN count(sq) OVER v >= 5 THEN round(sqrt(sum(sq) OVER v), 4) END AS vol,
CASE WHEN count(CASE WHEN adj IS NOT NULL AND anc IS NOT NULL THEN 1 END) OVER c >= 8 THEN round(corr(adj, anc) OVER c, 6) END AS likeness
FROM b WINDOW m AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 11 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING), v AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), c AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def factor_characteristics(spark, d):
    bars = Formula((RET,), ("r",)).apply(event_bars(spark, d))
    c = factors.characteristics(bars, ["click", "view"], momentum=(10, 5, 2), vol=(10, 5), theme=(15, 8))
    return rounded(rounded(c, "momentum", "likeness"), "vol", digits=4)


@query()
def beta_wls(spark, d):
    p = Formula((RET,), ("r",)).apply(with_market(spark, d))
    return rounded(factors.daily_betas(p, ["market_factor"], window=240, half_life=120, least=60), "r_squared", "beta_market_factor")


@query()
def residual_returns(spark, d):
    p = Formula((RET,), ("r",)).apply(with_market(spark, d))
    b = factors.daily_betas(p, ["market_factor"], window=240, half_life=120, least=60)
    return rounded(factors.residuals(p, b, ["market_factor"]).select("timestamp", "symbol", "residual_return"), "residual_return")


# ---- evaluation ----------------------------------------------------------------------------------

RANKS = f"{PANEL}, ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY timestamp) AS n FROM p WHERE signal IS NOT NULL AND tgt IS NOT NULL) WHERE n >= 10), rk AS (SELECT *, rank() OVER (PARTITION BY timestamp ORDER BY signal) + (count(*) OVER (PARTITION BY timestamp, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY timestamp ORDER BY tgt) + (count(*) OVER (PARTITION BY timestamp, tgt) - 1) / 2.0 AS b FROM ok)"


@query(f"WITH {RANKS} SELECT timestamp, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS ic, count(*) AS n FROM rk GROUP BY 1")
def rank_ic(spark, d):
    return rounded(evaluation.rank_ic(cross_panel(spark, d)), "ic")


@query(f"WITH {RANKS} SELECT timestamp, round(avg(CASE WHEN a / n >= 0.8 THEN tgt END) - avg(CASE WHEN a / n <= 0.2 THEN tgt END), 6) AS spread, count(*) AS n FROM rk GROUP BY 1")
def quintile_spread(spark, d):
    return rounded(evaluation.quintile_spread(cross_panel(spark, d)), "spread")


BUCKET = f"{PANEL}, q AS (SELECT *, CASE WHEN char >= median(char) OVER (PARTITION BY timestamp) THEN 'liquid' ELSE 'thin' END AS bucket FROM p), ok AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY timestamp, bucket) AS n FROM q WHERE tgt IS NOT NULL) WHERE n >= 5), rk AS (SELECT *, CAST(rank() OVER (PARTITION BY timestamp, bucket ORDER BY signal) + (count(*) OVER (PARTITION BY timestamp, bucket, signal) - 1) / 2.0 AS DOUBLE) AS a, CAST(rank() OVER (PARTITION BY timestamp, bucket ORDER BY tgt) + (count(*) OVER (PARTITION BY timestamp, bucket, tgt) - 1) / 2.0 AS DOUBLE) AS b FROM ok)"


@query(f"WITH {BUCKET}, ic AS (SELECT timestamp, bucket, corr(a, b) AS ic FROM rk GROUP BY 1, 2) SELECT bucket, round(avg(ic), 6) AS ic_mean, count(ic) AS n_stamps FROM ic GROUP BY 1")
def liquidity_bucket_ic(spark, d):
    half = F.when(F.col("char") >= F.median("char").over(Window.partitionBy("timestamp")), "liquid").otherwise("thin")
    return rounded(evaluation.bucket_ic(cross_panel(spark, d).withColumn("bucket", half), "bucket", least=5), "ic_mean")


BOOK = f"{PANEL}, dm AS (SELECT timestamp, symbol, tgt, signal - avg(signal) OVER (PARTITION BY timestamp) AS dv FROM p WHERE tgt IS NOT NULL), gr AS (SELECT *, sum(abs(dv)) OVER (PARTITION BY timestamp) AS g FROM dm), bk AS (SELECT timestamp, symbol, tgt, dv / g AS weight FROM gr WHERE g > 1e-12), full_grid AS (SELECT t.timestamp, s.symbol, coalesce(b.weight, 0) AS weight FROM (SELECT DISTINCT timestamp FROM bk) t CROSS JOIN (SELECT DISTINCT symbol FROM bk) s LEFT JOIN bk b ON b.timestamp = t.timestamp AND b.symbol = s.symbol), turn AS (SELECT timestamp, sum(mv) AS turnover FROM (SELECT timestamp, abs(weight - lag(weight, 1, 0) OVER (PARTITION BY symbol ORDER BY timestamp)) AS mv FROM full_grid) GROUP BY 1)"


SCREEN = f"{PANEL}, ok AS (SELECT timestamp, symbol, signal, tgt FROM p WHERE signal IS NOT NULL AND tgt IS NOT NULL AND timestamp IN (SELECT timestamp FROM p WHERE signal IS NOT NULL AND tgt IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)), st AS (SELECT timestamp, avg(signal) AS m FROM ok GROUP BY 1), sz AS (SELECT ok.timestamp, sum(abs(signal - m)) AS g FROM ok JOIN st ON st.timestamp = ok.timestamp GROUP BY 1), wt AS (SELECT ok.timestamp, symbol, tgt, CASE WHEN g > 0 THEN (signal - m) / g ELSE 0 END AS w FROM ok JOIN st ON st.timestamp = ok.timestamp JOIN sz ON sz.timestamp = ok.timestamp), nx AS (SELECT timestamp, lag(timestamp) OVER (ORDER BY timestamp) AS prior FROM st), chg AS (SELECT coalesce(a.timestamp, b.timestamp) AS timestamp, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS mv FROM wt a FULL JOIN (SELECT nx.timestamp, symbol, w FROM wt JOIN nx ON nx.prior = wt.timestamp) b ON b.timestamp = a.timestamp AND b.symbol = a.symbol)"


@query(f"WITH {SCREEN}, tn AS (SELECT timestamp, sum(mv) AS turnover FROM chg GROUP BY 1), gs AS (SELECT timestamp, sum(w * tgt) AS gross FROM wt GROUP BY 1) SELECT gs.timestamp, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 0.0005, 6) AS net FROM gs JOIN tn ON tn.timestamp = gs.timestamp")
def screening_backtest(spark, d):
    return rounded(evaluation.screening_backtest(cross_panel(spark, d)), "gross", "turnover", "net")


@query(f"WITH {BOOK} SELECT round(avg(turnover) / 2, 6) AS turnover FROM turn WHERE timestamp > (SELECT min(timestamp) FROM turn)")
def signal_turnover(spark, d):
    w = evaluation.book_weights(cross_panel(spark, d).where("tgt IS NOT NULL"))
    return rounded(discovery.signal_turnover(w), "turnover")


HAC = f"{RANKS}, ic AS (SELECT timestamp, corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS x FROM rk GROUP BY 1), dv AS (SELECT timestamp, x - avg(x) OVER () AS dv, count(*) OVER () AS n, avg(x) OVER () AS m FROM ic WHERE x IS NOT NULL), lg AS (SELECT n, m, dv, lag(dv, 1) OVER (ORDER BY timestamp) AS l1, lag(dv, 2) OVER (ORDER BY timestamp) AS l2, lag(dv, 3) OVER (ORDER BY timestamp) AS l3, CAST(floor(4 * power(n / 100.0, 2.0 / 9)) AS INTEGER) AS k FROM dv)"


@query(f"WITH {HAC}, s AS (SELECT max(n) AS n, max(m) AS m, (sum(dv * dv) + CASE WHEN max(k) >= 1 THEN 2 * (1 - 1.0 / (max(k) + 1)) * sum(dv * l1) ELSE 0 END + CASE WHEN max(k) >= 2 THEN 2 * (1 - 2.0 / (max(k) + 1)) * sum(dv * l2) ELSE 0 END + CASE WHEN max(k) >= 3 THEN 2 * (1 - 3.0 / (max(k) + 1)) * sum(dv * l3) ELSE 0 END) / max(n) AS v FROM lg) SELECT n, round(m, 6) AS mean, round(m / sqrt(v / n), 6) AS tstat FROM s")
def hac_tstat(spark, d):
    ic = evaluation.rank_ic(cross_panel(spark, d)).select("timestamp", F.col("ic").alias("x"))
    return rounded(evaluation.hac_tstat(ic), "mean", "tstat")


CURVE = f"{RESIDUAL}, sig AS (SELECT timestamp, symbol, close AS signal FROM src), st AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS pos FROM (SELECT DISTINCT timestamp FROM src)), gd AS (SELECT st.timestamp, st.pos, s.symbol, coalesce(x.residual_return, 0) AS e FROM st CROSS JOIN (SELECT DISTINCT symbol FROM src) s LEFT JOIN src x ON x.timestamp = st.timestamp AND x.symbol = s.symbol), ent AS (SELECT timestamp, symbol, dv / sum(abs(dv)) OVER (PARTITION BY timestamp) AS w FROM (SELECT timestamp, symbol, signal - avg(signal) OVER (PARTITION BY timestamp) AS dv, count(*) OVER (PARTITION BY timestamp) AS n FROM sig) WHERE n >= 3), pth AS (SELECT *, {', '.join(f'sum(e) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) AS a{k}' for k in (1, 6, 24))} FROM gd), oc AS (SELECT p.timestamp, {', '.join(f'sum(w * a{k}) AS a{k}' for k in (1, 6, 24))} FROM ent JOIN pth p ON p.timestamp = ent.timestamp AND p.symbol = ent.symbol WHERE p.pos % 6 = 0 AND p.pos + 24 <= (SELECT max(pos) FROM st) GROUP BY 1)"


@query(f"WITH {CURVE} " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(avg(a{k}), 6) AS a, count(*) AS n_entries FROM oc" for k in (1, 6, 24)))
def response_curve(spark, d):
    p = with_residual(spark, d)
    return rounded(evaluation.response_curve(p.select("timestamp", "symbol", F.col("close").alias("signal")), p.select("timestamp", "symbol", "residual_return"), (1, 6, 24)), "a")


@query(f"WITH {DAYS_SQL} SELECT round(corr(x, y), 6) AS corr, count(*) AS n FROM days")
def signal_correlation(spark, d):
    u = user_days(spark, d)
    return rounded(evaluation.signal_correlation(u.select("timestamp", "symbol", F.col("x").alias("signal")), u.select("timestamp", "symbol", F.col("y").alias("signal"))), "corr")


@query("WITH t AS (SELECT user_id, 1.0 / (1 + count(*) * avg(value)) AS p FROM events GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM t), c AS (SELECT max(p) AS cut FROM r WHERE p <= 0.0004 * k / n) SELECT user_id, round(p, 9) AS p, coalesce(p <= cut, false) AS discovered FROM r, c")
def false_discovery(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg((1.0 / (1 + F.count("*") * F.avg("value"))).alias("p"))
    return rounded(evaluation.false_discovery(t, rate=0.0004), "p", digits=9)


# ---- discovery -----------------------------------------------------------------------------------

LEDGER = "ledger AS (SELECT o_custkey % 7 AS roll_id, CAST(o_orderkey AS VARCHAR) AS cand_hash, o_totalprice / 1e5 - 1 AS a0, o_totalprice / 2e5 - 0.5 AS median_peak, o_orderkey % 40 AS test_days, o_totalprice / 3e5 - 0.4 AS net_rate, (o_orderkey % 10) / 10.0::DOUBLE AS capture, o_totalprice AS train_net_rate FROM orders)"


def ledger_of(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("roll_id"), F.col("o_orderkey").cast("string").alias("cand_hash"), (p / 1e5 - 1).alias("a0"), (p / 2e5 - 0.5).alias("median_peak"), (F.col("o_orderkey") % 40).alias("test_days"), (p / 3e5 - 0.4).alias("net_rate"), ((F.col("o_orderkey") % 10) / 10.0).alias("capture"), p.alias("train_net_rate"))


@query(f"WITH {LEDGER}, ok AS (SELECT *, count(*) OVER (PARTITION BY roll_id) AS n, row_number() OVER (PARTITION BY roll_id ORDER BY train_net_rate DESC, cand_hash) AS rank FROM ledger WHERE a0 > 0 AND median_peak > 0 AND test_days >= 20 AND net_rate > 0 AND capture >= 0.5) SELECT roll_id, cand_hash, CAST(rank AS INTEGER) AS rank FROM ok WHERE rank <= greatest(5, least(50, ceil(n * 0.2)))")
def promotion_filters(spark, d):
    return discovery.promotable(ledger_of(spark, d)).select("roll_id", "cand_hash", "rank")


HISTORY = "hist AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS cand_hash, o_orderkey AS roll_id, o_totalprice / 1e5 - 2.5 AS effect, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1 + (o_orderkey % 5) / 4.0::DOUBLE END AS se FROM orders)"


@query(f"WITH {HISTORY}, g AS (SELECT cand_hash, sum(effect / (se * se)) / sum(1 / (se * se)) AS pooled, arg_max(effect, roll_id) AS latest FROM hist GROUP BY 1) SELECT cand_hash, CAST(sign(coalesce(pooled, latest)) AS INTEGER) AS direction, round(pooled, 6) AS pooled FROM g")
def pooled_direction(spark, d):
    o = table(spark, d, "orders")
    h = o.select((F.col("o_custkey") % 50).cast("string").alias("cand_hash"), F.col("o_orderkey").alias("roll_id"), (F.col("o_totalprice") / 1e5 - 2.5).alias("effect"), F.when(F.col("o_orderkey") % 9 != 0, 1 + (F.col("o_orderkey") % 5) / 4.0).alias("se"))
    return rounded(discovery.pooled_direction(h), "pooled")


@query("WITH pr AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS cand_hash, o_orderkey AS roll_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS direction, o_orderdate AS valid_from, o_totalprice / 1e5 - 2.5 AS t FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY cand_hash ORDER BY abs(t) DESC, roll_id DESC) AS n FROM pr) SELECT cand_hash, max(direction) FILTER (n = 1) AS direction, min(valid_from) AS valid_from, round(max(abs(t)), 6) AS abs_t, count(*) AS n_rolls FROM r GROUP BY 1")
def discovered_bridge(spark, d):
    o = table(spark, d, "orders")
    p = o.select((F.col("o_custkey") % 50).cast("string").alias("cand_hash"), F.col("o_orderkey").alias("roll_id"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("direction"), F.col("o_orderdate").alias("valid_from"), (F.col("o_totalprice") / 1e5 - 2.5).alias("select_alpha_tstat"))
    return rounded(discovery.bridge(p), "abs_t")


@query()
def enumeration_topn(spark, d):
    p = Formula((RET, {"f0": cross_z("close"), "f1": cross_z("volume"), "f2": cross_z("r"), "tgt": forward_sum("r", 1)}), ()).apply(event_bars(spark, d))
    return rounded(discovery.enumerate_pairs(p, ["f0", "f1", "f2"], "tgt", 10), "score")


@query()
def search_random(spark, d):
    p = Formula((RET,), ("r",)).apply(event_bars(spark, d))
    found = discovery.search(p, p.select("timestamp", "symbol", F.col("r").alias("residual_return")), dsl.RandomProposer(1), ["close", "volume", "r"], generations=2, batch=3)
    return spark.createDataFrame(found[["generation", "cand_hash", "candidate_json", "direction"]])


# ---- event study ---------------------------------------------------------------------------------

DAILY = "dly AS (SELECT CAST(ts AS DATE) AS date, event_type AS symbol, sum(value) AS x, avg(value) / 50 - 1 AS res FROM events GROUP BY 1, 2)"


def daily_types(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("symbol")).agg(F.sum("value").alias("x"), (F.avg("value") / 50 - 1).alias("res"))



TRIG = f"{DAILY}, pv AS (SELECT *, lag(res) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM dly), trg AS (SELECT date, symbol FROM pv WHERE res < 0 AND NOT coalesce(prev < 0, false))"


@query(f"WITH {TRIG} SELECT date, symbol FROM trg")
def event_triggers(spark, d):
    return events.triggers(daily_types(spark, d), "res", "below", 0.0)


@query(f"WITH {TRIG.replace('res < 0 AND NOT coalesce(prev < 0, false)', 'res > 0 AND prev <= 0 AND x > 1000')} SELECT date, symbol FROM trg")
def event_triggers_cross(spark, d):
    return events.triggers(daily_types(spark, d), "res", "cross_above", 0.0, "x > 1000")


CARS = f"{TRIG}, dt AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM dly)), gd AS (SELECT dt.date, dt.pos, s.symbol, y.res FROM dt CROSS JOIN (SELECT DISTINCT symbol FROM dly) s LEFT JOIN dly y ON y.date = dt.date AND y.symbol = s.symbol), cr AS (SELECT date, symbol, {', '.join(f'CASE WHEN pos + {h} <= (SELECT max(pos) FROM dt) THEN sum(res) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS car_{h}' for h in (1, 3, 5))} FROM gd), cars AS (SELECT t.date, t.symbol, car_1, car_3, car_5 FROM trg t JOIN cr ON cr.date = t.date AND cr.symbol = t.symbol)"


@query(f"WITH {CARS} SELECT date, symbol, round(car_1, 6) AS car_1, round(car_3, 6) AS car_3, round(car_5, 6) AS car_5 FROM cars")
def event_cars(spark, d):
    daily = daily_types(spark, d)
    return rounded(events.abnormal_returns(events.triggers(daily, "res", "below", 0.0), daily.select("date", "symbol", "res")), "car_1", "car_3", "car_5")


@query(f"WITH {CARS}, m AS (SELECT date, avg(car_3) AS m, sum(car_3) AS s, count(car_3) AS k FROM cars WHERE car_3 IS NOT NULL GROUP BY 1) SELECT round(sum(s) / sum(k), 6) AS mean_car, round(avg(m) / (stddev_samp(m) / sqrt(count(m))), 6) AS tstat_clustered, CAST(sum(k) AS BIGINT) AS n_events, count(m) AS n_event_days FROM m")
def clustered_tstat(spark, d):
    daily = daily_types(spark, d)
    cars = events.abnormal_returns(events.triggers(daily, "res", "below", 0.0), daily.select("date", "symbol", "res"))
    return rounded(events.clustered(cars, 3), "mean_car", "tstat_clustered")


@query()
def event_cooldown(spark, d):
    return events.cooldown(events.triggers(daily_types(spark, d), "res", "below", 0.0), 5)


# ---- portfolio -----------------------------------------------------------------------------------


@query(f"WITH {DAYS_SQL}, s AS (SELECT timestamp, symbol, CASE WHEN n > 1 THEN x END AS a, CASE WHEN n < 4 THEN y END AS b FROM days), t AS (SELECT timestamp, symbol, coalesce(a, 0) * 0.5 + coalesce(b, 0) * 2.0 AS sm FROM s WHERE a IS NOT NULL OR b IS NOT NULL) SELECT timestamp, symbol, round(greatest(-3, least(3, (sm - avg(sm) OVER (PARTITION BY timestamp)) / (stddev_samp(sm) OVER (PARTITION BY timestamp) + 1e-10))), 6) AS score FROM t")
def composite_score(spark, d):
    s = user_days(spark, d).select("timestamp", "symbol", F.when(F.col("n") > 1, F.col("x")).alias("a"), F.when(F.col("n") < 4, F.col("y")).alias("b"))
    return rounded(portfolio.composite(s, {"a": 0.5, "b": 2.0}), "score")


@query(f"""WITH {DAYS_SQL}, v AS (SELECT timestamp, symbol, CASE WHEN n > 1 THEN x - 20 END AS adv FROM days), m AS (SELECT timestamp, median(adv) AS mid FROM v WHERE adv > 0 GROUP BY 1)
SELECT v.timestamp, symbol, CASE WHEN adv > 0 THEN round(least(3.0, greatest(0.5, 1 + 0.25 * (mid / adv - 1))), 6) ELSE 1 END AS cost_multiplier, CASE WHEN adv > 0 THEN round(least(2.0, greatest(0.25, sqrt(adv / mid))), 6) ELSE 1 END AS speed_multiplier, round(coalesce(greatest(adv, 0), 0) * 0.1 / 1e4, 8) AS cap FROM v LEFT JOIN m ON m.timestamp = v.timestamp""")
def liquidity_multipliers(spark, d):
    u = user_days(spark, d).withColumn("adv", F.when(F.col("n") > 1, F.col("x") - 20))
    cost, speed = portfolio.liquidity_multipliers(F.col("adv"), "timestamp")
    return u.select("timestamp", "symbol", F.round(cost, 6).alias("cost_multiplier"), F.round(speed, 6).alias("speed_multiplier"), F.round(portfolio.participation_cap(F.col("adv"), 0.1, 1e4), 8).alias("cap"))


@query(f"WITH {DAYS_SQL}, m AS (SELECT timestamp, symbol, n, (y - 40) / (1.5 * (n - 1)) AS q FROM days) SELECT timestamp, symbol, CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN q < 0.1 THEN 0.0::DOUBLE WHEN q > 1 THEN 1.0::DOUBLE ELSE round(q, 6) END AS gross FROM m")
def edge_gross(spark, d):
    return user_days(spark, d).select("timestamp", "symbol", F.round(portfolio.edge_gross(F.col("y") - 40, (F.col("n") - 1).cast("double"), 1.5, 0.1), 6).alias("gross"))


@query(f"WITH {DAYS_SQL} SELECT timestamp, symbol, round(-y, 6) AS score FROM days")
def control_sign_flip(spark, d):
    return rounded(portfolio.controlled(user_days(spark, d).select("timestamp", "symbol", F.col("y").alias("score")), "sign_flip"), "score")


@query()
def control_shuffle(spark, d):
    return rounded(portfolio.controlled(user_days(spark, d).select("timestamp", "symbol", F.col("y").alias("score")), "shuffle"), "score")


@query()
def backtest_window(spark, d):
    p = Formula((RET, {"score": f"-({cross_z('close')})"}), ()).apply(event_bars(spark, d))
    rows = p.select(F.weekofyear("timestamp").cast("long").alias("window"), "timestamp", "symbol", "score", "r", (F.col("quote_asset_volume") * 1e4).alias("volume"))
    b = portfolio.backtest(rows, portfolio.BookConfig(covariance_bars=72, least_bars=2))
    return rounded(b, "gross_return", "funding", "cost", "net_return", "turnover", "gross_exposure", "net_exposure")


# ---- reports -------------------------------------------------------------------------------------

STRAT = "st AS (SELECT CAST(ts AS DATE)::TIMESTAMP AS timestamp, avg(value) / 5000 - 0.0098 AS r FROM events GROUP BY 1)"


def strategy(spark, d):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(day.alias("timestamp")).agg((F.avg("value") / 5000 - 0.0098).alias("r"))


EQ = f"{STRAT}, cm AS (SELECT timestamp, r, exp(sum(ln(1 + r)) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS c FROM st), eq AS (SELECT timestamp, r, c - 1 AS cum_return, c / greatest(1.0, max(c) OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS drawdown FROM cm)"


@query(f"WITH {EQ} SELECT timestamp, round(r, 8) AS r, round(cum_return, 8) AS cum_return, round(drawdown, 8) AS drawdown FROM eq")
def drawdown(spark, d):
    return rounded(reports.equity(strategy(spark, d)), "r", "cum_return", "drawdown", digits=8)


@query(f"WITH {EQ} SELECT count(r) AS n, round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round(avg(r) * 365, 6) AS annual_return, round(stddev_samp(r) * sqrt(365), 6) AS annual_vol, round(avg(r) / stddev_samp(r) * sqrt(365), 6) AS sharpe, round(avg(r) / sqrt(avg(power(least(r, 0), 2))) * sqrt(365), 6) AS sortino, round(min(drawdown), 6) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate FROM eq")
def perf_stats(spark, d):
    return rounded(reports.performance(strategy(spark, d), 365), "total_return", "annual_return", "annual_vol", "sharpe", "sortino", "max_drawdown", "hit_rate")


@query(f"WITH {BOOK} SELECT symbol, round(sum(weight * tgt), 6) AS pnl, round(avg(CASE WHEN weight * tgt > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_rate, round(avg(abs(weight)), 6) AS mean_abs_weight, count(*) AS n FROM bk GROUP BY 1")
def factor_attribution(spark, d):
    w = evaluation.book_weights(cross_panel(spark, d, user_days_in_order).where("tgt IS NOT NULL"))
    return rounded(reports.attribution(w, "weight", "tgt", "symbol"), "pnl", "hit_rate", "mean_abs_weight")


@query(f"WITH {DAYS_SQL} SELECT 'x' AS a, 'x' AS b, round(corr(x, x), 6) AS corr FROM days UNION ALL SELECT 'x', 'y', round(corr(x, y), 6) FROM days UNION ALL SELECT 'x', 'n', round(corr(x, n), 6) FROM days UNION ALL SELECT 'y', 'y', round(corr(y, y), 6) FROM days UNION ALL SELECT 'y', 'n', round(corr(y, n), 6) FROM days UNION ALL SELECT 'n', 'n', round(corr(n, n), 6) FROM days")
def correlation_matrix(spark, d):
    return rounded(reports.correlation_matrix(user_days(spark, d), ["x", "y", "n"]), "corr")


@query(f"WITH {STRAT} SELECT timestamp, round(CASE WHEN count(r) OVER w >= 5 THEN avg(r) OVER w / stddev_samp(r) OVER w * sqrt(365) END, 5) AS sharpe FROM st WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def rolling_sharpe(spark, d):
    w = Window.partitionBy().orderBy("timestamp").rowsBetween(-9, 0)
    s = strategy(spark, d)
    return s.select("timestamp", F.round(F.when(F.count("r").over(w) >= 5, F.avg("r").over(w) / F.stddev_samp("r").over(w) * F.sqrt(F.lit(365.0))), 5).alias("sharpe"))


@query(f"WITH {PANEL} SELECT round(regr_slope(tgt, signal), 6) AS slope, round(regr_intercept(tgt, signal), 6) AS intercept, round(regr_r2(tgt, signal), 6) AS r2, count(tgt) AS n FROM p")
def factor_regression(spark, d):
    return cross_panel(spark, d).agg(F.round(F.regr_slope("tgt", "signal"), 6).alias("slope"), F.round(F.regr_intercept("tgt", "signal"), 6).alias("intercept"), F.round(F.regr_r2("tgt", "signal"), 6).alias("r2"), F.count("tgt").alias("n"))


@query(f"WITH {RANKS}, ic AS (SELECT timestamp, corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS ic FROM rk GROUP BY 1) SELECT CAST(date_trunc('week', timestamp) AS DATE) AS week, round(avg(ic), 6) AS ic_mean, count(ic) AS n FROM ic GROUP BY 1")
def walkforward_slice_ic(spark, d):
    ic = evaluation.rank_ic(cross_panel(spark, d))
    return rounded(ic.groupBy(F.trunc(F.to_date("timestamp"), "week").alias("week")).agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n")), "ic_mean")


# ---- remaining transforms ------------------------------------------------------------------------


@query("SELECT timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 14 HOUR)) AS event_time_utc, 'fomc' AS event_type FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders)")
def event_calendar(spark, d):
    months = table(spark, d, "orders").select(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("m")).distinct()
    utc = F.expr("convert_timezone('America/New_York', 'UTC', m + INTERVAL 14 HOURS)")
    return months.select(utc.alias("event_time_utc"), F.lit("fomc").alias("event_type"))


@query("WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT date + 1 AS date, round(urgent / total, 8) AS dominance FROM s")
def dominance(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy(o.o_orderdate.cast("date").alias("date")).agg((F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))) / F.sum("o_totalprice")).alias("dominance"))
    return rounded(g.withColumn("date", F.date_add("date", 1)), "dominance", digits=8)


@query("WITH sec AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS section, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), cum AS (SELECT date, section, sum(v) OVER (PARTITION BY section ORDER BY date) AS c FROM sec), tot AS (SELECT date, sum(c) AS t FROM cum GROUP BY 1), df AS (SELECT date, greatest(0, t - lag(t) OVER (ORDER BY date)) AS unlocked, t / max(t) OVER () AS cum_pct FROM tot) SELECT date, round(unlocked, 2) AS unlocked, round(cum_pct, 8) AS cum_pct FROM df")
def unlock_schedule(spark, d):
    o = table(spark, d, "orders")
    sec = o.groupBy(o.o_orderdate.cast("date").alias("date"), "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    cum = sec.withColumn("c", F.sum("v").over(Window.partitionBy("o_orderpriority").orderBy("date")))
    tot = cum.groupBy("date").agg(F.sum("c").alias("t"))
    w = Window.orderBy("date")
    prev = F.lag("t").over(w)
    out = tot.withColumns({"p": prev}).join(tot.agg(F.max("t").alias("m")), how="cross")
    return out.select("date", F.round(F.greatest(F.lit(0.0), F.col("t") - F.col("p")), 2).alias("unlocked"), F.round(F.col("t") / F.col("m"), 8).alias("cum_pct"))


@query("SELECT c_mktsegment, string_agg(k, ';' ORDER BY k) AS counts FROM (SELECT c_mktsegment, c_nationkey || ':' || count(*) AS k FROM customer GROUP BY c_mktsegment, c_nationkey) GROUP BY 1")
def counts_as_text(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    k = F.concat_ws(":", F.col("c_nationkey").cast("string"), F.col("n").cast("string"))
    return g.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(k)), ";").alias("counts"))


@query("SELECT symbol, date, round(market_cap, 4) AS market_cap FROM (WITH px AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, arg_max(value, ts) AS close FROM events GROUP BY 1, 2), an AS (SELECT symbol, arg_min(1e6 / close, date) AS supply FROM px GROUP BY 1) SELECT p.symbol, p.date, p.close * a.supply AS market_cap FROM px p JOIN an a ON a.symbol = p.symbol)")
def constant_supply_mcap(spark, d):
    at = F.when(F.col("value").isNotNull(), F.col("ts")).alias("_at")
    rows = table_in_order(spark, d, "events").select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("date"), "value", at, "_file", "_row")
    last = Window.partitionBy("symbol", "date").orderBy(F.col("_at").desc_nulls_last(), "_file", "_row")  # of equal stamps the first row counts, as in its SQL
    px = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("symbol", "date", F.when(F.col("_at").isNotNull(), F.col("value")).alias("close"))
    supply = px.groupBy("symbol").agg(F.min_by(ieee_div(F.lit(1e6), F.col("close")), F.when(F.col("close").isNotNull(), F.col("date"))).alias("supply"))
    return px.join(supply, "symbol").select("symbol", "date", F.round(F.col("close") * F.col("supply"), 4).alias("market_cap"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(props) AS digest, substr(sha1(props), 1, 16) AS short FROM events")
def json_and_hash(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), F.sha2(p, 256).alias("digest"), F.substring(F.sha1(p), 1, 16).alias("short"))




FIRST = "ft AS (SELECT CAST(user_id AS VARCHAR) AS symbol, min(ts) + INTERVAL 3 DAY AS first_trade FROM events WHERE user_id % 2 = 0 GROUP BY user_id)"


def first_trades(spark, d):
    return table(spark, d, "events").where("user_id % 2 = 0").groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("first_trade")).select(F.col("user_id").cast("string").alias("symbol"), "first_trade")


@query(f"WITH {SPELLS}, {FIRST}, sd AS (SELECT symbol, date_trunc('month', valid_from)::TIMESTAMP AS valid_from, valid_to FROM spells) SELECT s.symbol, CASE WHEN s.valid_from = (SELECT min(valid_from) FROM sd) AND s.valid_from > TIMESTAMP '2023-06-01' THEN greatest(coalesce(f.first_trade, TIMESTAMP '2023-06-01'), TIMESTAMP '2023-06-01') ELSE s.valid_from END AS valid_from, s.valid_to FROM sd s LEFT JOIN ft f ON f.symbol = s.symbol")
def membership_backdate(spark, d):
    month = F.date_trunc("month", F.col("valid_from").cast("timestamp")).cast("timestamp_ntz")
    return joins.backdate_spells(spells_of(spark, d).withColumn("valid_from", month), first_trades(spark, d), "2023-06-01")


@query(f"WITH {SPELLS}, {FIRST} SELECT s.symbol, CASE WHEN f.first_trade IS NOT NULL THEN greatest(s.valid_from, greatest(f.first_trade, TIMESTAMP '2024-01-05')) ELSE s.valid_from END AS valid_from, s.valid_to FROM spells s LEFT JOIN ft f ON f.symbol = s.symbol")
def membership_clip(spark, d):
    return joins.clip_spells(spells_of(spark, d), first_trades(spark, d), "2024-01-05")


@query("WITH t AS (SELECT user_id, sum(value) AS x FROM events GROUP BY 1), c AS (SELECT quantile_cont(x, 1.0 / 3) AS a, quantile_cont(x, 2.0 / 3) AS b FROM t) SELECT user_id, CASE WHEN x <= a THEN 0 WHEN x <= b THEN 1 ELSE 2 END AS tercile FROM t, c")
def tercile_cut(spark, d):
    return reports.terciles(table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("x")), "x").select("user_id", "tercile")


@query(f"WITH {BARS} SELECT timestamp, symbol, round(avg(close) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS smooth FROM bars")
def centred_mean(spark, d):
    w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(-2, 2)
    return event_bars(spark, d).select("timestamp", "symbol", F.round(F.avg("close").over(w), 9).alias("smooth"))


TARGETS = f"{RESIDUAL}, tg AS (SELECT timestamp, symbol, {forward_sum('residual_return', 1)} AS fwd_1b, {forward_sum('residual_return', 6)} AS fwd_6b, {mean('quote_asset_volume', 144, 36)} AS adv FROM src), pr AS (SELECT *, {percent_rank('adv')} AS p FROM tg)"


@query(f"WITH {TARGETS} SELECT timestamp, symbol, round(fwd_1b, 6) AS fwd_1b, round(fwd_6b, 6) AS fwd_6b, coalesce(p >= 0.5, false) AS is_liquid, CASE WHEN p IS NOT NULL THEN CAST(greatest(1, least(10, ceil(p * 10))) AS INTEGER) END AS liq_decile FROM pr")
def targets_panel(spark, d):
    t = evaluation.targets_panel(with_residual(spark, d), {"1b": 1, "6b": 6})
    return rounded(t.select("timestamp", "symbol", "fwd_1b", "fwd_6b", "is_liquid", "liq_decile"), "fwd_1b", "fwd_6b")


@query(f"WITH {PANEL}, ok AS (SELECT tgt, (rank() OVER (PARTITION BY timestamp ORDER BY signal) + (count(*) OVER (PARTITION BY timestamp, signal) - 1) / 2.0) / count(*) OVER (PARTITION BY timestamp) AS pct FROM p WHERE tgt IS NOT NULL) SELECT CAST(least(9, floor(pct * 10)) AS INTEGER) AS bin, round(avg(tgt), 6) AS mean, count(tgt) AS n FROM ok GROUP BY 1")
def feature_decile_curve(spark, d):
    return rounded(evaluation.binned_response(cross_panel(spark, d, user_days_in_order), "signal", "tgt"), "mean")


@query(f"WITH {BARS}, wt AS (SELECT timestamp + INTERVAL 1 HOUR AS timestamp, symbol, open / 1000 AS weight FROM bars) SELECT w.timestamp, round(-sum(w.weight * (b.close - b.open) / 9973), 9) AS funding_pnl FROM wt w JOIN bars b ON b.timestamp = w.timestamp AND b.symbol = w.symbol GROUP BY 1")
def funding_accrual(spark, d):
    b = event_bars(spark, d)
    out = portfolio.funding_accrual(b.select("timestamp", "symbol", (F.col("open") / 1000).alias("weight")), b.select("timestamp", "symbol", ((F.col("close") - F.col("open")) / 9973).alias("funding_rate")), 3600)
    return rounded(out, "funding_pnl", digits=9)


@query("""WITH s AS (SELECT o_orderkey AS signal_id, o_custkey % 6 AS lag, CASE WHEN o_custkey % 6 = 5 THEN NULL ELSE o_totalprice / 1e5 - 3 END AS ic, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 5) / 4.0 END AS turnover, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 48 + 1 END AS half_life FROM orders),
b AS (SELECT lag, sum(abs(coalesce(ic, 0))) AS total, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT s.*, CASE WHEN total > 1e-12 THEN abs(coalesce(ic, 0)) / total ELSE 1.0 / n END AS weight FROM s JOIN b ON b.lag = s.lag),
f AS (SELECT lag, sum(abs(coalesce(ic, 0)) * weight) AS ic, sum(coalesce(turnover, 1) * weight) AS turnover, sum(weight * half_life) / greatest(sum(weight) FILTER (half_life IS NOT NULL), 1e-12) AS half_life FROM w GROUP BY 1)
SELECT signal_id, w.lag, round(weight, 9) AS weight, round(f.ic, 6) AS bucket_ic, round(f.turnover, 6) AS bucket_turnover, round(f.half_life, 6) AS bucket_half_life FROM w JOIN f ON f.lag = w.lag""")
def month_book(spark, d):
    key, bucket = F.col("o_orderkey"), F.col("o_custkey") % 6
    s = table(spark, d, "orders").select(key.alias("signal_id"), bucket.alias("lag"), F.when(bucket != 5, F.col("o_totalprice") / 1e5 - 3).alias("ic"), F.when(key % 7 > 0, (key % 5) / 4.0).alias("turnover"), F.when(key % 3 > 0, key % 48 + 1).cast("double").alias("half_life"))
    out = portfolio.month_book(s).select("signal_id", "lag", "weight", "bucket_ic", "bucket_turnover", "bucket_half_life")
    return rounded(rounded(out, "weight", digits=9), "bucket_ic", "bucket_turnover", "bucket_half_life")


@query(f"WITH {BOOK}, f AS (SELECT *, CASE WHEN weight * lag(weight) OVER (PARTITION BY symbol ORDER BY timestamp) < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flip FROM bk) SELECT symbol, round(avg(abs(weight)), 8) AS mean_abs, round(max(abs(weight)), 8) AS max_abs, CAST(sum(CASE WHEN abs(weight) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS bars_held, round(avg(flip), 8) AS flip_rate FROM f GROUP BY 1")
def weights_audit(spark, d):
    w = evaluation.book_weights(cross_panel(spark, d).where("tgt IS NOT NULL"))
    return rounded(reports.weights_audit(w), "mean_abs", "max_abs", "flip_rate", digits=8)


@query(f"WITH {STRAT}, k AS (SELECT date_trunc('week', timestamp)::DATE AS week, timestamp, r, count(r) OVER (PARTITION BY date_trunc('week', timestamp)) AS n, row_number() OVER (PARTITION BY date_trunc('week', timestamp) ORDER BY r, timestamp) AS j FROM st) SELECT week, round(product(1 + r) - 1, 8) AS total_return, round(min(r), 8) AS worst, round(avg(CASE WHEN j <= greatest(1, floor(n / 100)) THEN r END), 8) AS tail_mean, count(r) AS n FROM k GROUP BY 1")
def window_returns(spark, d):
    s = strategy(spark, d).withColumn("week", F.trunc(F.to_date("timestamp"), "week"))
    return rounded(reports.window_returns(s, "week"), "total_return", "worst", "tail_mean", digits=8)


@query(f"WITH {LEDGER} SELECT roll_id, count(*) AS evaluated, count(*) FILTER (net_rate > 0) AS net_positive, count(*) FILTER (net_rate > 0 AND capture >= 0.5) AS captured, count(*) FILTER (net_rate > 0 AND capture >= 0.5 AND test_days >= 20) AS eligible FROM ledger GROUP BY 1")
def discovery_funnel(spark, d):
    return reports.funnel(ledger_of(spark, d))


@query("""WITH b AS (SELECT o_orderdate, sum(o_totalprice) / 1e6 AS g, avg(o_totalprice) / 1e6 AS t, sum(o_totalprice) / 1e8 AS r, sum(o_totalprice) / 1e8 - count(*) / 1e4 AS net, count(*) AS n FROM orders GROUP BY 1)
SELECT round(avg(g), 6) AS avg_gross, round(quantile_cont(g, 0.95), 6) AS p95_gross, round(max(g), 6) AS max_gross, round(avg(t), 6) AS avg_turnover_bar, round(avg(t) * 252, 6) AS ann_turnover_x_gross, round(avg(r - net) * 1e4, 6) AS avg_cost_bps_bar, round(avg(r - net) * 252 * 100, 6) AS ann_cost_pct, round(avg(n), 6) AS avg_n_positions, min(n) AS min_n_positions, max(n) AS max_n_positions FROM b""")
def execution_stats(spark, d):
    p, n = F.sum("o_totalprice"), F.count(F.lit(1))
    b = table(spark, d, "orders").groupBy("o_orderdate").agg((p / 1e6).alias("gross_exposure"), (F.avg("o_totalprice") / 1e6).alias("turnover"), (p / 1e8).alias("gross_return"), (p / 1e8 - n / 1e4).alias("net_return"), n.alias("n_positions"))
    s = reports.execution_stats(b, 252)
    return rounded(s, *[c for c in s.columns if not c.startswith(("min_", "max_n"))])


@query("SELECT o_custkey % 5 AS horizon, count(DISTINCT o_orderkey % 97) AS n_signals, round(avg(abs(o_totalprice / 1e5 - 2)), 6) AS ic_abs_mean, round(quantile_cont(abs(o_totalprice / 1e5 - 2), 0.5), 6) AS ic_abs_med, round(max(abs(o_totalprice / 1e5 - 2)), 6) AS best_ic, round(avg(abs(o_totalprice / 2e5 - 1)), 6) AS icir_abs_mean, round(avg(o_orderkey % 7), 6) AS turnover_mean FROM orders GROUP BY 1")
def metrics_by_horizon(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    m = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("horizon"), (k % 97).alias("signal_name"), (p / 1e5 - 2).alias("ic"), (p / 2e5 - 1).alias("icir"), (k % 7).alias("turnover"))
    return rounded(reports.metrics_by(m, "horizon"), "ic_abs_mean", "ic_abs_med", "best_ic", "icir_abs_mean", "turnover_mean")
