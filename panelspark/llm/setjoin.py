"""Similar sets: what meets whom, in tiles of bounded size, and the exact search inside a tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(filed: DataFrame, item: str, bucket: str, size: str, block_items: int, block_size: int) -> DataFrame:
    """(item, tile) such that any two items of a bucket meet in a tile.

    A tile is a bucket, or two blocks of a bucket of more than ``block_items`` items or ``block_size`` in
    all. Buckets of one item are left out. ``item`` is an integer.
    """
    blocks = F.ceil(F.greatest(F.count("*") / block_items, F.sum(size) / block_size)).cast("int")
    shared = filed.groupBy(bucket).agg(F.count("*").alias("_n"), blocks.alias("_m")).where("_n > 1").select(bucket, "_m")
    met = filed.join(shared, bucket).withColumn("_mine", F.pmod(F.xxhash64(item), F.col("_m")).cast("int"))
    whole = met.where("_m = 1").select(item, F.col(bucket).alias("tile"))
    dealt = met.where("_m > 1").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return whole.union(dealt.select(item, F.xxhash64(bucket, F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("tile")))


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs of ``sets``, each of distinct values, with this Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        if min(sizes) < similarity * max(sizes):
            return []
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if common >= similarity * (sizes.sum() - common) else []
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    line = np.repeat(np.arange(len(sets)), sizes)
    ids = rank[ids]
    ids = ids[np.lexsort((ids, line))]  # a line's rarest shingles first
    starts = np.cumsum(sizes) - sizes
    prefix = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    early = np.arange(len(ids)) - starts[line] < prefix[line]
    alive, mark, links, frontier = np.ones(len(sets), bool), np.zeros(len(count), bool), [], []
    left = indexed = len(sets)
    first, tokens, owners = 0, None, None
    while left:
        if tokens is None or 2 * left < indexed:
            use = early & alive[line]
            order = np.argsort(ids[use], kind="stable")
            tokens, owners, indexed = ids[use][order], line[use][order], left
        if frontier:
            f = frontier.pop()
        else:
            while not alive[first]:
                first += 1
            f, alive[first], left = first, False, left - 1
        own = ids[starts[f] : starts[f] + sizes[f]]
        head = own[: prefix[f]]
        lo, hi = np.searchsorted(tokens, head), np.searchsorted(tokens, head, "right")
        met = np.concatenate([owners[a:b] for a, b in zip(lo, hi)])
        met = np.unique(met[alive[met]])
        met = met[(sizes[met] >= similarity * sizes[f] - 1e-9) & (sizes[f] >= similarity * sizes[met] - 1e-9)]
        if not len(met):
            continue
        mark[own] = True
        n = sizes[met]
        rows = np.repeat(starts[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.add.reduceat(mark[ids[rows]], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        found = met[common >= similarity * (n + sizes[f] - common)].tolist()
        alive[found] = False
        left -= len(found)
        frontier += found
        links += [(f, g) for g in found]
    return links
