"""Helpers shared by the corpus operators: durable intermediate tables and size-aware partition counts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one partition of a text shuffle should hold.
PARTITION_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, as in local tests, a temporary
    folder is made and set for the session; a session with remote executors must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="panelspark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/panelspark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, so a lost one costs only its own tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_partitions(docs: DataFrame, text: str = "text") -> int:
    """Partitions for a shuffle of whole texts: the session's count, or more where texts are large."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``used`` renamed out of an operator's way, and the names to give back."""
    away = {c: f"_shielded_{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


#: A key is hot if it holds more than this share of the rows; so at most 1024 keys are.
HOT_SHARE = 1 / 1024


def join_unique(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and says in ``n`` how many of ``total`` rows of ``left`` it meets.

    Keys that hold more than ``HOT_SHARE`` of the rows, 1024 at most, are joined by broadcast where their
    rows lie, so no task gathers them. Both tables are read twice.
    """
    hot = F.col(n) > total * HOT_SHARE
    some = F.broadcast(right.where(hot).drop(n))
    rest = left.join(some.select(key), key, "left_anti").join(right.where(~hot).drop(n), key)
    return rest.unionByName(left.join(some, key))


#: Bits a key in a key map, unless the map would be larger than the most bits (16 MiB); bits of one of its rows.
MAP_BITS, MAP_MOST, MAP_ROW = 16, 1 << 27, 1 << 15


def key_map(keys: DataFrame, hashed: str, n: int) -> tuple[DataFrame, int]:
    """(part, bits) rows of a bitmap of the ``n`` integer hashes in ``keys``, stored, and its number of bits."""
    size = min(MAP_MOST, max(MAP_ROW, 1 << (MAP_BITS * n).bit_length()))
    at = F.pmod(F.col(hashed), F.lit(size))
    parts = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / MAP_ROW).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % MAP_ROW).alias("bits"))
    return materialize(parts, "key-map"), size


def may_be_in(df: DataFrame, hashed: str, mapped: tuple[DataFrame, int]) -> DataFrame:
    """``df`` with the boolean ``_may``: false for hashes that are surely not in the map.

    The map, of ``MAP_MOST`` bits at most, is broadcast. What may be in it needs an exact join still; a map
    too small for its keys only says so of more rows. So rows that meet no key need not be shuffled.
    """
    parts, size = mapped
    tagged = df.withColumn("_at", F.pmod(F.col(hashed), F.lit(size)))
    joined = tagged.join(F.broadcast(parts.toDF("_part", "_bits")), F.floor(F.col("_at") / MAP_ROW).cast("int") == F.col("_part"), "left")
    byte = "conv(hex(substring(_bits, cast((_at % {0}) div 8 as int) + 1, 1)), 16, 10)".format(MAP_ROW)
    bit = F.expr(f"(shiftright(cast({byte} as int), cast(_at % 8 as int)) & 1) = 1")
    return joined.select(*df.columns, F.coalesce(bit, F.lit(False)).alias("_may"))


#: What operators keep in a worker process from task to task: name -> how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}
_LAST: list[str] = []


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def only(name: str) -> None:
    """Let go of what other operators keep in this worker process; every Python function calls it before its own work.

    When the work changes, freed memory goes back to the system too: workers outlive their tasks, and what
    one stage freed but did not return would count beside what the next one needs.
    """
    if _LAST == [name]:
        return
    _LAST[:] = [name]
    for other, clear in KEPT.items():
        if other != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()
