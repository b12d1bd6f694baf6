"""Event studies: triggers, cooldown, cumulative abnormal returns and day-clustered t statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def triggers(daily: DataFrame, x: str, kind: str, level: float, require: str | None = None) -> DataFrame:
    """(date, symbol) where ``x`` enters or crosses ``level``.

    ``below`` and ``above`` fire on the first day of a spell, a missing day before counting as outside it;
    ``cross_below`` and ``cross_above`` need the day before on the other side.
    """
    prev = F.lag(x).over(Window.partitionBy("symbol").orderBy("date"))
    now, was = F.col(x), F.col("_prev")
    tests = {
        "below": (now < level) & ~F.coalesce(was < level, F.lit(False)),
        "above": (now > level) & ~F.coalesce(was > level, F.lit(False)),
        "cross_below": (now < level) & (was >= level),
        "cross_above": (now > level) & (was <= level),
    }
    out = daily.withColumn("_prev", prev).where(tests[kind])
    return (out.where(require) if require else out).select("date", "symbol")


def cooldown(events: DataFrame, days: int) -> DataFrame:
    """Events more than ``days`` after the last kept one of their symbol."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for d in sorted(pdf["date"]):
            if last is None or (d - last).days > days:
                kept.append(d)
                last = d
        return pd.DataFrame({"date": kept, "symbol": pdf["symbol"].iloc[0]})

    return events.groupBy("symbol").applyInPandas(keep, "date date, symbol string")


def abnormal_returns(events: DataFrame, residuals: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Sum of ``res`` over the next days of the observed calendar, for each event and horizon.

    Null unless the window ends inside the calendar and holds a value.
    """
    dates = residuals.select("date").distinct().withColumn("_pos", F.row_number().over(Window.orderBy("date")))
    last = dates.agg(F.max("_pos")).first()[0]
    grid = dates.join(residuals.select("symbol").distinct(), how="cross").join(residuals, ["date", "symbol"], "left")
    w = Window.partitionBy("symbol").orderBy("_pos")
    cars = grid.select("date", "symbol", *[F.when(F.col("_pos") + h <= F.lit(last), F.sum("res").over(w.rowsBetween(1, h))).alias(f"car_{h}") for h in horizons])
    return events.join(cars, ["date", "symbol"])


def clustered(cars: DataFrame, horizon: int) -> DataFrame:
    """Mean over events, and the t of day means; one row."""
    c = f"car_{horizon}"
    days = cars.where(F.col(c).isNotNull()).groupBy("date").agg(F.avg(c).alias("m"), F.sum(c).alias("s"), F.count(c).alias("k"))
    sd = F.stddev_samp("m")
    return days.agg((F.sum("s") / F.sum("k")).alias("mean_car"), F.when((F.count("m") > 1) & (sd > 0), F.avg("m") / (sd / F.sqrt(F.count("m").cast("double")))).alias("tstat_clustered"), F.sum("k").alias("n_events"), F.count("m").alias("n_event_days"))
