"""Named Parquet tables under a folder: filtered reads, three ways of writing, deletes and introspection.

A table with a ``symbol`` column is partitioned by it, so an equality filter on symbol opens one directory
and replacing a symbol rewrites one. Spark's commit protocol makes writes atomic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def condition(name: str, op: str, value: Any) -> Column:
    c = F.col(name)
    if op == "in":
        return c.isin(list(value))
    if op == "not in":
        return ~c.isin(list(value))
    if op not in OPS:
        raise ValueError(f"unknown filter operator: {op}")
    return getattr(c, OPS[op])(value)


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """``{col: value}``, ``{col: (op, value)}`` or ``{col: [(op, value), ...]}``, all of which must hold."""
    tests = []
    for name, spec in (filters or {}).items():
        if isinstance(spec, tuple):
            spec = [spec]
        elif not isinstance(spec, list):
            spec = [("=", spec)]
        tests += [condition(name, op, value) for op, value in spec]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


class Store:
    """Tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        if not table.replace("_", "a").replace("-", "a").replace(".", "a").isalnum():
            raise ValueError(f"not a table name: {table!r}")
        return f"{self.root}/{table}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, table: str) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path(self.path(table))))

    def tables(self) -> list[str]:
        fs, path = self._fs()
        names = sorted(f.getPath().getName() for f in fs.listStatus(path(self.root))) if fs.exists(path(self.root)) else []
        return [n for n in names if not n.endswith((".new", ".old"))]

    def load(self, table: str, filters: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None, limit: int | None = None, drop: Sequence[str] = ()) -> DataFrame:
        """Rows of a table; a table that does not exist is an empty frame without columns."""
        if not self.exists(table):
            return self.spark.createDataFrame([], "")
        df = apply_filters(self.spark.read.option("mergeSchema", "true").parquet(self.path(table)), filters)
        df = df.select(*columns) if columns else df
        df = df.limit(limit) if limit is not None else df
        return df.drop(*drop)

    def save(self, df: DataFrame, table: str, mode: str = "overwrite", key: str | None = None, value: Any = None, required: Sequence[str] = ()) -> None:
        """``overwrite``, ``append`` (columns by name, missing ones null) or ``replace`` rows where ``key`` is ``value``."""
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        if mode == "replace":
            if key is None:
                raise ValueError("replace needs a key")
            if key == "symbol" and self.exists(table):
                df = df.where(F.col("symbol") == value)
                if df.isEmpty():
                    self.delete_rows(table, {"symbol": value})
                    return
                df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("symbol").parquet(self.path(table))
                return
            if self.exists(table):
                kept = self.load(table).where(F.coalesce(F.col(key) != value, F.lit(False)))
                self._rewrite(kept.unionByName(df, allowMissingColumns=True), table)
                return
            mode = "overwrite"
        writer = df.write.mode(mode)
        (writer.partitionBy("symbol") if "symbol" in df.columns else writer).parquet(self.path(table))

    def _rewrite(self, df: DataFrame, table: str) -> None:
        """Write beside the table, put the old files aside, move the new ones in, then delete the old.

        The plan still reads the old files while it writes. Whenever this stops, one whole version stands
        under the table's name or beside it as ``.old``, where ``recover`` finds it.
        """
        fs, path = self._fs()
        fresh, old, own = self.path(f"{table}.new"), self.path(f"{table}.old"), self.path(table)
        writer = df.write.mode("overwrite")
        (writer.partitionBy("symbol") if "symbol" in df.columns else writer).parquet(fresh)
        fs.delete(path(old), True)
        if fs.exists(path(own)) and not fs.rename(path(own), path(old)):
            raise OSError(f"cannot put {own} aside")
        if not fs.rename(path(fresh), path(own)):
            fs.rename(path(old), path(own))
            raise OSError(f"cannot move {fresh} in")
        fs.delete(path(old), True)
        self.spark.catalog.refreshByPath(own)

    def recover(self, table: str) -> bool:
        """Bring a table back whose rewrite was cut off between its two moves; whether there was one."""
        fs, path = self._fs()
        if fs.exists(path(self.path(table))) or not fs.exists(path(self.path(f"{table}.old"))):
            return False
        return bool(fs.rename(path(self.path(f"{table}.old")), path(self.path(table))))

    def clear(self, table: str) -> None:
        """Delete all rows; the table and its columns stay."""
        if self.exists(table):
            self._rewrite(self.load(table).limit(0).coalesce(1), table)

    def remove_symbol(self, symbol: str, *tables: str) -> dict[str, int]:
        """Delete a symbol's rows from the named tables, or from all that have symbols; rows deleted by table."""
        names = tables or [t for t in self.tables() if self.has_columns(t, ["symbol"])]
        return {t: self.delete_rows(t, {"symbol": symbol}) for t in names if self.exists(t) and self.has_columns(t, ["symbol"])}

    def batches(self, table: str, columns: Sequence[str] | None = None, rows: int = 1_000_000, order: Sequence[str] = ("symbol", "timestamp")):
        """Rows in order, as Arrow tables of at most ``rows`` rows; one partition at a time reaches the caller."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        df = self.load(table, columns=columns)
        schema, held = to_arrow_schema(df.schema), []
        for row in df.orderBy(*[c for c in order if c in df.columns]).toLocalIterator(prefetchPartitions=True):
            held.append(row.asDict())
            if len(held) == rows:
                yield pa.Table.from_pylist(held, schema)
                held = []
        if held:
            yield pa.Table.from_pylist(held, schema)

    def delete_rows(self, table: str, filters: Mapping[str, Any]) -> int:
        """Delete the rows that match, and those whose filtered columns are null; returns their number."""
        if not self.exists(table):
            return 0
        df = self.load(table)
        match = reduce(lambda a, b: a & b, [condition(k, *(v if isinstance(v, tuple) else ("=", v))) for k, v in filters.items()])
        kept = df.where(~match)
        gone = df.count() - kept.count()
        if gone:
            self._rewrite(kept, table)
        return gone

    def drop(self, table: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path(table)), True)

    def columns(self, table: str) -> list[str]:
        return self.load(table).columns

    def has_columns(self, table: str, names: Sequence[str]) -> bool:
        return set(names) <= set(self.columns(table))

    def symbols(self, table: str) -> list[str]:
        df = self.load(table)
        return sorted(r[0] for r in df.select("symbol").distinct().collect()) if "symbol" in df.columns else []

    def count(self, table: str, filters: Mapping[str, Any] | None = None) -> int:
        return self.load(table, filters).count() if self.exists(table) else 0

    def describe(self, table: str) -> dict[str, Any]:
        try:
            df = self.load(table)
        except AnalysisException:
            return {"table": table, "rows": 0, "columns": {}}
        return {"table": table, "rows": df.count(), "columns": dict(df.dtypes)}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows are surplus over one per key."""
    groups = df.groupBy(*keys).count().where("count > 1")
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0).cast("long")).alias("surplus"))


def complete_months(bars: DataFrame, per_day: int, share: float = 0.9, ts: str = "timestamp") -> DataFrame:
    """(symbol, month) with at least ``share`` of the rows that a month of ``per_day`` rows a day has."""
    day = F.to_date(ts)
    month = F.date_format(ts, "yyyy-MM")
    counts = bars.groupBy("symbol", month.alias("month"), F.dayofmonth(F.last_day(day)).alias("days")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= F.col("days") * per_day * share).select("symbol", "month", "n")


def complete_days(bars: DataFrame, per_day: int, share: float = 0.75, ts: str = "timestamp") -> DataFrame:
    counts = bars.groupBy("symbol", F.to_date(ts).alias("date")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= per_day * share)


def normalise_klines(raw: DataFrame) -> DataFrame:
    """Rows of a bar file: epoch micro- or milliseconds to timestamps, text to numbers, rows without a price dropped."""

    def stamp(c: str) -> Column:
        t = F.col(c).cast("long")
        return F.timestamp_millis(F.when(t > 9_999_999_999_999, F.floor(t / 1000)).otherwise(t)).cast("timestamp_ntz")

    numbers = ["open", "high", "low", "close", "volume", "quote_asset_volume", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume"]
    out = raw.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in numbers} | {"open_time": stamp("open_time"), "timestamp": stamp("close_time"), "number_of_trades": F.expr("try_cast(number_of_trades AS bigint)")})
    return out.where(F.col("close").isNotNull() & ~F.isnan("close")).drop("close_time")
