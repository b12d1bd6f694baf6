"""Bar panels over the event and order tables, and resampling in general."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``table`` with each row's file and number in it (``_file``, ``_row``): the order in which SQL in one thread meets the rows."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def bucket_end(ts: Column, seconds: int) -> Column:
    """End of the right-closed bucket that holds ``ts``: a stamp on the edge stays in the bucket it ends."""
    micros = F.unix_micros(ts.cast("timestamp"))
    width = seconds * 1_000_000
    return F.timestamp_micros(F.ceil(micros / width).cast("long") * width).cast("timestamp_ntz")


def ohlcv(trades: DataFrame, seconds: int, ts: str = "timestamp", price: str = "price", volume: str = "volume", sums: Sequence[str] = ()) -> DataFrame:
    """Bars per (symbol, bucket): first, highest, lowest and last price, summed volume and other columns.

    First and last go by time, not by the order of rows; aggregation is partial before the shuffle.
    """
    at = F.col(ts)
    return trades.groupBy(bucket_end(at, seconds).alias("timestamp"), "symbol").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"), *[F.sum(c).alias(c) for c in sums]
    )


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: a symbol per event type, users with odd numbers as takers."""
    odd = F.col("user_id") % 2 == 1
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("value").alias("quote_asset_volume"), F.lit(1).cast("long").alias("number_of_trades"),
        F.when(odd, 1.0).otherwise(0.0).alias("taker_buy_base_asset_volume"), F.when(odd, F.col("value")).otherwise(0.0).alias("taker_buy_quote_asset_volume"),
    )


SUMS = ("quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume")


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return ohlcv(event_trades(spark, sf_dir), seconds, sums=SUMS)


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cross-section: a symbol per user, a bar per day."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(day.alias("timestamp"), F.col("user_id").cast("string").alias("symbol")).agg(F.sum("value").alias("x"), F.avg("value").alias("y"), F.count("value").alias("n"))


def user_days_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_days`` whose sums add the values row by row, as the table's files hold them.

    Sums of doubles depend on their order in the last bit, and partial sums meet in any order. What compares such
    sums for equality or with a threshold (ties of ranks, cliffs, signs of changes) needs one order: the rows' own,
    as SQL in one thread has it. Costs a sort by day and user in place of partial sums; one user's day is one task's.
    """
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    rows = table_in_order(spark, sf_dir, "events").select(day.alias("timestamp"), F.col("user_id").cast("string").alias("symbol"), "value", "_file", "_row")
    w = Window.partitionBy("timestamp", "symbol").orderBy("_file", "_row")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("timestamp", "symbol", F.sum("value").over(upto).alias("x"), F.avg("value").over(upto).alias("y"), F.count("value").over(upto).alias("n"), F.lead(F.lit(1)).over(w).alias("_more"))
    return run.where("_more IS NULL").drop("_more")


def last_in_bucket(df: DataFrame, seconds: int, value: str) -> DataFrame:
    """Last non-null value of each (symbol, bucket)."""
    some = df.where(F.col(value).isNotNull())
    return some.groupBy(bucket_end(F.col("timestamp"), seconds).alias("timestamp"), "symbol").agg(F.max_by(value, "timestamp").alias(value))


def densify(bars: DataFrame, seconds: int) -> DataFrame:
    """All symbols on all stamps between the panel's first and last; gaps become rows of NULLs."""
    ends = bars.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("timestamp"))
    return grid.join(bars.select("symbol").distinct(), how="cross").join(bars, ["timestamp", "symbol"], "left")


def carried(df: DataFrame, columns: Sequence[str], by: str = "symbol", order: str = "timestamp", limit: int | None = None) -> DataFrame:
    """Columns filled forward from the last row that has them, at most ``limit`` rows back."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def calendar(df: DataFrame, columns: Sequence[str], limit: int, shift: int, by: str = "symbol", date: str = "date") -> DataFrame:
    """Daily calendar per symbol over the whole table's dates, filled forward up to ``limit`` days and made available ``shift`` days later."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias(date)).join(df.select(by).distinct(), how="cross")
    filled = carried(days.join(df, [date, by], "left"), columns, by, date, limit)
    w = Window.partitionBy(by).orderBy(date)
    return filled.withColumns({c: F.lag(c, shift).over(w) for c in columns}).select(date, by, *columns)


def strided(df: DataFrame, k: int, ts: str = "timestamp") -> DataFrame:
    """Rows at every ``k``-th of the panel's distinct stamps.

    Stamps, not rows, are ranked: the distinct stamps of a panel are few beside its rows.
    """
    stamps = df.select(ts).distinct().withColumn("_n", F.row_number().over(Window.orderBy(ts))).where((F.col("_n") - 1) % k == 0).select(ts)
    return df.join(stamps, ts, "left_semi")


BARS_SQL = """bars AS (SELECT make_timestamp(CAST(ceil(epoch_us(ts) / ({s} * 1e6)) AS BIGINT) * {s} * 1000000) AS timestamp, event_type AS symbol,
  arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_asset_volume,
  count(*) AS number_of_trades, sum(CASE WHEN user_id % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS taker_buy_base_asset_volume, sum(CASE WHEN user_id % 2 = 1 THEN value ELSE 0.0::DOUBLE END) AS taker_buy_quote_asset_volume
  FROM events GROUP BY 1, 2)"""
DAYS_SQL = """days AS (SELECT date_trunc('day', ts)::TIMESTAMP AS timestamp, CAST(user_id AS VARCHAR) AS symbol, sum(value) AS x, avg(value) AS y, count(value) AS n FROM events GROUP BY 1, 2)"""


def bars_sql(seconds: int = 3600) -> str:
    return BARS_SQL.format(s=seconds)
