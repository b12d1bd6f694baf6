"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources get word targets by water-filling. Every document belongs to one output shard, chosen by a hash.
A source's quota is then split over the shards exactly as a draw without replacement would fall: a binary
tree over the shards hands each left half a hypergeometric share of the node's words. In its shard a
document stands in a pseudo-random order and takes words until the shard's quota of its source is used
up, so quotas are met to the word, draws are disjoint, and no step looks at a whole source at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import materialize, only, shielded

#: Shards at least, and documents that a shard should hold.
MIN_SHARDS, SHARD_DOCS = 64, 8192
#: numpy's own sampler takes smaller populations only.
NUMPY_POPULATION = 900_000_000
#: Parts that a group of equal rows is numbered in.
PLACES = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _log_ratio(a: int, b: int) -> float:
    """log(a! / b!), without the loss that a difference of two large logarithms has."""
    if min(a, b) < 64:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    series = lambda n: 1 / (12 * n) - 1 / (360 * n**3)
    return (b + 0.5) * math.log1p(d / b) + d * math.log(a) - d + series(a) - series(b)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn from ``good + bad`` without replacement, for populations of any size.

    Ratio of uniforms with the published bounds for this distribution; exact up to double arithmetic.
    """
    total, few = good + bad, min(good, bad)
    m = min(sample, total - sample)
    if not few or not m:
        z = 0
    else:
        many = total - few
        mean = m * few / total
        sd = math.sqrt((total - m) / (total - 1) * m * (few / total) * (many / total) + 0.5)
        reach = 1.7155277699214135 * sd + 0.8989161620588988
        mode = (m + 1) * (few + 1) // (total + 2)
        while True:
            u, v = 1.0 - rng.random(), rng.random()
            w = mean + 0.5 + reach * (v - 0.5) / u
            z = math.floor(w)
            if z < max(0, m - many) or z > min(m, few):
                continue
            t = _log_ratio(mode, z) + _log_ratio(few - mode, few - z) + _log_ratio(m - mode, m - z) + _log_ratio(many - m + mode, many - m + z)
            if 2 * math.log(u) <= t:
                break
    if good > bad:
        z = m - z
    return z if m == sample else good - z


def _share(rng: np.random.Generator, left: np.ndarray, right: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Hypergeometric share of ``quota`` that falls to ``left``, for each node."""
    total = left + right
    out = np.zeros(len(left), np.int64)
    small = (total > 0) & (total < NUMPY_POPULATION)
    if small.any():
        out[small] = rng.hypergeometric(left[small], right[small], quota[small])
    for i in np.flatnonzero(total >= NUMPY_POPULATION):
        out[i] = hypergeometric(rng, int(left[i]), int(right[i]), int(quota[i]))
    return out


def split_quota(capacity: np.ndarray, quota: int, rng: np.random.Generator) -> np.ndarray:
    """Split ``quota`` over cells of the given capacities, level by level down a binary tree."""
    width = 1 << max(0, int(np.ceil(np.log2(max(1, len(capacity))))))
    levels = [np.pad(np.asarray(capacity, np.int64), (0, width - len(capacity)))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    quotas = np.array([min(int(quota), int(levels[-1][0]))], np.int64)
    for level in reversed(levels[:-1]):
        left = _share(rng, level[0::2], level[1::2], quotas)
        quotas = np.stack([left, quotas - left], axis=1).ravel()
    return quotas[: len(capacity)]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with ``target``: sources by code point, null last, weighed in turn.

    The ordinal of a source comes from a range-sorted table and its partitions' counts; only those counts
    and a few sums reach the driver.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    ranked = materialize(sizes.orderBy(order).withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("id", 33)
    counts = sorted(tuple(r) for r in ranked.groupBy(part.alias("p")).count().collect())
    starts, seen = [], 0
    for p, n in counts:
        starts.append((p, seen))
        seen += n
    if not starts:
        return ranked.drop("id").withColumn("target", F.lit(0.0))
    base = spark.createDataFrame(starts, "p long, base long")
    nth = (F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1)) % len(weights)
    weighed = ranked.withColumn("p", part).join(base, "p").withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth + 1).cast("int"))).drop("p", "base", "id")
    weighed = materialize(weighed, "source-weights")
    limit = F.col("source_size") * F.lit(float(cap))
    total, all_w = weighed.agg(F.sum("source_size"), F.sum("w")).first()
    level, capped = share * total / all_w, -1
    while True:  # each turn caps more sources; the level only rises
        full = limit <= F.lit(level) * F.col("w")
        n, held, free = weighed.agg(F.count(F.when(full, 1)), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not free:
            break
        level, capped = (share * total - (held or 0.0)) / free, n
    return weighed.withColumn("target", F.least(limit, F.lit(level) * F.col("w"))).drop("w")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """Add ``source_size``, ``target``, ``shard`` and ``taken`` to rows with doc_id, source and ``size`` (words).

    ``taken`` counts words with repeats: full passes over the source and, from the documents that the
    shard's quota reaches, the rest; the last one reached gives part of its words. Together a source's
    rows take its target rounded to a whole number, and no row takes more than ``cap`` times its size.

    Null sources form one source; repeated rows are rows of their own; a row of no words takes none; an
    empty table stays empty; ids may be null or repeat. Reruns agree: order and draws depend only on the
    rows' contents and ``seed``. Columns of those four names are replaced.
    """
    docs = docs.drop("source_size", "target", "shard", "taken")
    docs, back = shielded(docs, "doc_id", "source", "size", "text")
    shards = max(MIN_SHARDS, -(-docs.count() // SHARD_DOCS))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    text = [F.xxhash64("text")] if "text" in docs.columns else []
    name = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("doc_id").isNull(), key, F.col("size"), *text)
    rows = numbered(docs.withColumns({"_key": key, "_name": name}), "_name", "_copy")
    draw = F.xxhash64("_name", "_copy")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "_name", "_copy"), F.lit(shards))
    rows = rows.withColumns({"_draw": draw, "shard": shard}).drop("_name")
    pools = materialize(rows.groupBy("_key", "source", "shard").agg(F.sum("size").alias("pool")), "mix-pools")
    targets = source_targets(pools.groupBy("source").agg(F.sum("pool").alias("source_size")), weights, share, cap)

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        only("mixing")
        pdf = pdf.sort_values("shard", ignore_index=True)
        size, target = int(pdf.source_size[0]), float(pdf.target[0])
        words = round(target)
        passes = words // size if size else 0
        rng = np.random.default_rng([seed, *pdf["_key"][0].encode()])
        quota = split_quota(pdf["pool"].to_numpy(), words - passes * size, rng)
        return pdf[["_key", "shard", "source_size", "target"]].assign(passes=passes, quota=quota)

    named = targets.withColumn("_key", key).drop("source")
    split = pools.drop("source").join(named, "_key").groupBy("_key").applyInPandas(quotas, "_key string, shard long, source_size long, target double, passes long, quota long")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_key", "shard").orderBy("_draw", "doc_id", "_copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - before))
    out = rows.join(split, ["_key", "shard"]).withColumns({"_before": before, "taken": F.col("passes") * F.col("size") + left})
    return out.select(*docs.columns, "source_size", "target", "shard", "taken", F.col("passes").alias("_passes"), F.col("quota").alias("_quota"), "_before", "_draw").withColumnsRenamed(back)


def numbered(rows: DataFrame, name: str, copy: str) -> DataFrame:
    """Add ``copy``: 0, 1, 2 ... among rows of equal ``name``, in any order; a group of copies is dealt over tasks.

    Rows so alike are interchangeable, so results don't depend on which gets which number.
    """
    repeated = rows.groupBy(name).count().where("count > 1").select(name)
    if repeated.isEmpty():
        return rows.withColumn(copy, F.lit(0).cast("long"))
    repeated = materialize(repeated, "repeated-rows")
    once = rows.join(repeated, name, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    placed = rows.withColumn("_place", F.pmod(F.monotonically_increasing_id(), F.lit(PLACES))).join(repeated, name, "left_semi")
    counts = placed.groupBy(name, "_place").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(name).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(name, "_place").orderBy("_place"))
    many = placed.withColumn("_row", inside).join(counts.select(name, "_place", before.alias("_base")), [name, "_place"])
    return once.unionByName(many.withColumn(copy, F.col("_base") + F.col("_row") - 1).drop("_place", "_row", "_base"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixture of whole documents: rows of ``docs`` repeated as often as taken, in shuffled order by shard.

    ``docs`` needs doc_id, source and size. A document that a quota would cut comes whole with the
    probability of its covered share, drawn from its hash, so a source comes near its target however few
    documents a shard has. Null sources, ties, repeats and empty tables are as in ``mix_sources``; rows of
    no words come in no copy beyond the full passes. Returns the columns of ``docs`` and ``shard``.
    """
    columns = [c for c in docs.columns if c != "shard"]
    docs, back = shielded(docs.select(*columns), "doc_id", "source", "size", "text")
    mixed = mix_sources(docs, **options)
    chance = (F.pmod(F.xxhash64(F.lit(3), "_draw"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    reached = (F.col("_before") + F.col("size") * chance <= F.col("_quota")) & (F.col("_quota") > 0)
    copies = mixed.withColumn("_copies", F.col("_passes") + reached.cast("int")).where("_copies > 0")
    each = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    shuffled = each.sortWithinPartitions("shard", F.xxhash64("_draw", "_copy"))
    return shuffled.select(*docs.columns, "shard").withColumnsRenamed(back).select(*columns, "shard")
