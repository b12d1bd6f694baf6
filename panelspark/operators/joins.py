"""Joins in time: as-of, bounded as-of, neighbouring events, event windows and interval membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the last right row at or before it (before it, if ``strict``).

    One shuffle by key and one sort: both sides are stacked and the right values carried forward. Adds
    ``matched_at``, the time of the row they come from. Right rows of equal time are taken in the order of
    their values, the last one counting.
    """
    a = left.withColumns({"_at": F.col(on), "_tag": F.lit(1), "_row": F.lit(None).cast(_struct(right, [on, *values]))})
    b = right.select(*by, F.col(on).alias("_at"), F.lit(2 if strict else 0).alias("_tag"), F.struct(F.col(on), *values).alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_tag", "_row").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(w)).where("_tag = 1")
    return out.select(*left.columns, F.col(f"_hit.{on}").alias("matched_at"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def _struct(df: DataFrame, names: Sequence[str]):
    return df.select(F.struct(*names).alias("s")).schema["s"].dataType


def asof_bounded(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], seconds: int) -> DataFrame:
    """As ``asof``, with nulls where the matched row is older than ``seconds``."""
    out = asof(left, right, by, on, values)
    fresh = F.unix_micros(F.col(on).cast("timestamp")) - F.unix_micros(F.col("matched_at").cast("timestamp")) <= seconds * 1_000_000
    return out.withColumns({v: F.when(fresh, F.col(v)) for v in (*values, "matched_at")})


def neighbours(bars: DataFrame, events: DataFrame, by: Sequence[str] = (), on: str = "timestamp", event_time: str = "event_time", block_seconds: int = 86400) -> DataFrame:
    """Adds the next event at or after each row and the last one strictly before it.

    Events are stacked with the rows of their key and block of time and carried both ways, so no row meets
    more than its neighbours. What a block has not is carried over from the blocks around it, of which there
    is one row each.
    """
    at = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (block_seconds * 1_000_000))
    a, b = bars.withColumn("_block", at(on)), events.where(F.col(event_time).isNotNull()).select(*by, event_time).withColumn("_block", at(event_time))
    keys = [*by, "_block"]
    both = a.withColumns({"_at": F.col(on), "_tag": F.lit(1), "_e": F.lit(None).cast(b.schema[event_time].dataType)}).unionByName(b.select(*keys, F.col(event_time).alias("_at"), F.lit(2).alias("_tag"), F.col(event_time).alias("_e")), allowMissingColumns=True)
    inside = Window.partitionBy(*keys).orderBy("_at", "_tag")
    near = both.withColumns({"_before": F.last("_e", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.first("_e", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))})
    blocks = a.select(*keys).distinct().join(b.groupBy(*keys).agg(F.min(event_time).alias("_first"), F.max(event_time).alias("_last")), keys, "full")
    order = Window.partitionBy(*by).orderBy("_block")
    around = blocks.select(*keys, F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    out = near.where("_tag = 1").join(around, keys, "left")
    return out.select(*[F.col(c) for c in bars.columns], F.coalesce("_before", "_earlier").alias("previous_event"), F.coalesce("_after", "_later").alias("next_event"))


def event_windows(events: DataFrame, bars: DataFrame, by: Sequence[str], seconds: int, event_time: str = "event_time", on: str = "timestamp") -> DataFrame:
    """Pairs of an event and a bar in (event, event + seconds].

    Both sides are keyed by blocks of the window's length, an event by the two blocks its window can
    touch, so the range condition becomes an equi-join with a residual filter.
    """

    def block(c):
        return F.floor(F.unix_micros(c.cast("timestamp")) / (seconds * 1_000_000))

    e = events.withColumn("_block", F.explode(F.array(block(F.col(event_time)), block(F.col(event_time)) + 1)))
    b = bars.withColumn("_block", block(F.col(on)))
    inside = (F.col(on) > F.col(event_time)) & (F.col(on) <= F.col(event_time) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return e.join(b, [*by, "_block"]).where(inside).drop("_block")


def members(panel: DataFrame, spells: DataFrame, on: str = "timestamp") -> DataFrame:
    """Rows whose symbol's latest spell begun at or before them has not ended (an open end never ends)."""
    matched = asof(panel.withColumn("_from", F.col(on)), spells.select("symbol", F.col("valid_from").alias("_from"), "valid_to"), ["symbol"], "_from", ["valid_to"])
    return matched.where(F.col("matched_at").isNotNull() & (F.col("valid_to").isNull() | (F.col(on) < F.col("valid_to")))).select(*panel.columns)


def latest(df: DataFrame, by: Sequence[str], on: str, ties: Sequence[str] = ()) -> DataFrame:
    """Last row per key, ties broken by further columns."""
    w = Window.partitionBy(*by).orderBy(F.col(on).desc(), *[F.col(t).desc() for t in ties])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def evolve_spells(spells: DataFrame, current: DataFrame, as_of: str) -> DataFrame:
    """Close open spells of symbols no longer in ``current`` and open spells for new ones."""
    at = F.lit(as_of).cast("timestamp_ntz")
    names = current.select("symbol").distinct().withColumn("_here", F.lit(True))
    open_now = F.col("valid_to").isNull()
    closed = spells.join(names, "symbol", "left").withColumn("valid_to", F.when(open_now & F.col("_here").isNull(), at).otherwise(F.col("valid_to"))).drop("_here")
    new = names.join(spells.where(open_now).select("symbol").distinct(), "symbol", "left_anti").select("symbol", at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return closed.select("symbol", "valid_from", "valid_to").unionByName(new)


def backdate_spells(spells: DataFrame, first_trades: DataFrame, new_start: str) -> DataFrame:
    """Move the seeded cohort, the rows at the earliest start, back to ``new_start`` or their first trade, whichever is later."""
    start = F.lit(new_start).cast("timestamp_ntz")
    earliest = spells.agg(F.min("valid_from").alias("_e"))
    j = spells.join(earliest, how="cross").join(first_trades.select("symbol", "first_trade"), "symbol", "left")
    moved = F.greatest(F.coalesce("first_trade", start), start)
    seeded = (F.col("valid_from") == F.col("_e")) & (F.col("_e") > start)
    return j.select("symbol", F.when(seeded, moved).otherwise(F.col("valid_from")).alias("valid_from"), "valid_to")


def clip_spells(spells: DataFrame, first_trades: DataFrame, floor: str) -> DataFrame:
    """A spell starts no earlier than its symbol's first trade, first trades before ``floor`` counting as ``floor``."""
    j = spells.join(first_trades.select("symbol", "first_trade"), "symbol", "left")
    at = F.greatest(F.col("first_trade"), F.lit(floor).cast("timestamp_ntz"))
    return j.select("symbol", F.when(F.col("first_trade").isNotNull(), F.greatest(F.col("valid_from"), at)).otherwise(F.col("valid_from")).alias("valid_from"), "valid_to")


def fresh_latest(df: DataFrame, day: str, by: Sequence[str] = ("symbol",), on: str = "date", most_days: int = 5) -> DataFrame:
    """Each key's last row on or before ``day``, unless it is more than ``most_days`` old."""
    then = F.to_date(F.lit(day))
    known = df.where(F.col(on) <= then)
    return latest(known, by, on).where(F.datediff(then, F.col(on)) <= most_days)


def window_slice(panel: DataFrame, start: str, end: str, purge_bars: int = 0, bar_seconds: int = 600, on: str = "timestamp") -> DataFrame:
    """Rows from ``start`` up to, not with, ``end`` less ``purge_bars`` bars."""
    a, z = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr(f"INTERVAL {purge_bars * bar_seconds} SECONDS")
    return panel.where((F.col(on) >= a) & (F.col(on) < z))


def only_new(stored: DataFrame, fetched: DataFrame, key: str = "date") -> DataFrame:
    """Stored rows and, of keys that are not stored, the fetched ones, one a key."""
    return stored.unionByName(fetched.join(stored.select(key).distinct(), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def resolved_ids(names: DataFrame, manual: DataFrame, cached: DataFrame, listed: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    """(symbol, id): the manual choice, else the cached one, else the listed id of the largest market cap that is not blocked."""
    best = listed.where(~F.col("id").isin(list(blocked)) if blocked else F.lit(True)).groupBy("symbol").agg(F.max_by("id", F.struct(F.coalesce("market_cap", F.lit(-1.0)), "id")).alias("_best"))
    out = names.select("symbol").distinct().join(manual.select("symbol", F.col("id").alias("_manual")), "symbol", "left").join(cached.select("symbol", F.col("id").alias("_cached")), "symbol", "left").join(best, "symbol", "left")
    return out.select("symbol", F.coalesce("_manual", "_cached", "_best").alias("id"))
