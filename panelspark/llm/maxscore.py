"""Exact top-k by inner product with MaxScore, shard by shard.

Terms are vector components; a term's postings are the component's values over a slab of candidates, and
their extremes bound what the term can add to a query's score. Each query takes its terms by falling bound.
The tail whose bounds together stay below the query's current k-th score is non-essential: no candidate can
live on it. Essential postings are traversed for the whole slab; the other terms are probed a few at a time,
only for candidates that can still reach the k-th score (ties included). Slabs come in order of their
candidates' lengths, longest first, so the k-th score rises early, and a slab whose bounds together stay
below it is passed over. The k-th scores of the first shard go to all further ones, and shards are merged.

Queries and candidates meet in tiles of fixed size, so a task's memory does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.common import materialize, only

#: Queries and candidates of a tile, candidates of a slab, and terms probed between two looks at the bounds.
TILE_QUERIES, TILE_CANDIDATES, SLAB, PROBE = 2048, 16384, 4096, 4
#: Sums of products below this are exact in double arithmetic.
EXACT = float(1 << 53)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _narrow(most: int) -> str:
    """The narrowest integer type that holds components up to ``most``."""
    return "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"


def _scored(q: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, floor: float, stats: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a slab that reach ``floor``, and their scores; ``c`` is (terms, candidates)."""
    most = np.maximum(q * low, q * high)
    terms = np.argsort(-most, kind="stable")
    rest = np.append(np.cumsum(most[terms][::-1])[::-1], 0)  # bound of all terms from here on
    stats[0] += c.shape[1]
    if rest[0] < floor:
        return np.zeros(0, np.int64), np.zeros(0, q.dtype)
    essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(terms)
    # Bounds may fall and rise again where a term can only subtract; from ``essential`` on the largest counts.
    ahead = np.maximum.accumulate(rest[::-1])[::-1]
    first = terms[:essential]
    score = q[first] @ c[first]
    alive = np.flatnonzero(score + ahead[essential] >= floor)
    score = score[alive]
    for at in range(essential, len(terms), PROBE):
        if not len(alive):
            break
        some = terms[at : at + PROBE]
        score = score + q[some] @ c[np.ix_(some, alive)]
        keep = score + ahead[min(at + PROBE, len(terms))] >= floor
        if not keep.all():
            alive, score = alive[keep], score[keep]
    stats[1] += len(alive)
    return alive, score


def shard_topk(queries: np.ndarray, own: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None, stats: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) positions and scores: the best ``k`` candidates of the shard for each query.

    ``own`` is the position of a query's own row among the candidates, or -1. Ties go to the smaller id.
    Candidates below a query's ``floors`` may be left out. ``stats`` counts candidates met and scored in full.
    """
    stats = [0, 0] if stats is None else stats
    width = max(queries.shape[1], cands.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    cands = np.pad(cands, ((0, 0), (0, width - cands.shape[1])))
    reach = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(cands.astype(float)).max(initial=0)) * max(width, 1)
    kind = np.float64 if reach < EXACT else np.int64
    order = np.argsort(-(cands.astype(float) ** 2).sum(axis=1), kind="stable")
    slabs, at = [], 0
    while at < len(order):  # the first slabs are small: they set the first thresholds
        rows = order[at : at + min(SLAB, max(256, at))]
        at += len(rows)
        c = np.ascontiguousarray(cands[rows].T.astype(kind))
        slabs.append((rows, c, c.min(axis=1), c.max(axis=1)))
    out = []
    for i, q in enumerate(queries.astype(kind)):
        floor = -np.inf if floors is None else floors[i]
        best, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        for rows, c, low, high in slabs:
            at, score = _scored(q, c, low, high, floor, stats)
            met = rows[at]
            if own[i] >= 0:
                other = met != own[i]
                met, score = met[other], score[other]
            if len(met):
                best, scores = np.concatenate([best, met]), np.concatenate([scores, score])
                if len(best) > k:
                    top = np.lexsort((ids[best], -scores))[:k]
                    best, scores = best[top], scores[top]
                if len(best) == k:
                    floor = max(floor, float(scores.min()))
        out.append((np.full(len(best), i), best, scores.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def topk_search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, tile: tuple[int, int] = (TILE_QUERIES, TILE_CANDIDATES)) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` best other rows by inner product.

    Components become floor(scale * x) with x as double. Vectors that are null or hold a null or non-finite
    component take no part; shorter vectors count as padded with zeros. Ties go to the smaller vec_id, null
    ids last. Repeated rows are rows of their own: each may be found by the other. A query with fewer than
    ``k`` others gets them all; an empty table gives no rows. Other columns are ignored.
    """
    x = F.col(vector)
    finite = F.coalesce(F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False))), F.lit(False))
    packed = vectors.where(finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale))).alias("v"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(packed, "vectors")
    largest = F.array_max(F.transform("v", lambda v: F.abs(v)))
    n, asked, most = rows.agg(F.count("uid"), F.count(F.when(F.col("asks"), 1)), F.max(largest)).first()
    rows = rows.withColumn("v", F.col("v").cast(f"array<{_narrow(most or 0)}>"))
    blocks, shards = max(1, -(-asked // tile[0])), max(1, -(-n // tile[1]))
    place = F.xxhash64("uid")
    asks = rows.where("asks").select(F.pmod(place, F.lit(blocks)).alias("block"), "uid", "vec_id", "v")
    held = rows.withColumn("shard", F.pmod(place, F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    names = ["uid", "query_id", "vec_id", "score"]
    schema = "uid long, query_id long, vec_id long, score long"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        only("maxscore")
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        uids = b["uid"].to_numpy()
        order = np.argsort(uids)
        at = np.searchsorted(uids, a["uid"].to_numpy(), sorter=order).clip(0, len(uids) - 1)
        own = np.where(uids[order[at]] == a["uid"].to_numpy(), order[at], -1)
        ids = b["vec_id"].combine_chunks()
        rank = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        qi, ci, score = shard_topk(_matrix(a["v"]), own, _matrix(b["v"]), rank, k, a["floor"].to_numpy())
        return pa.table([a["uid"].combine_chunks().take(pa.array(qi)), a["vec_id"].combine_chunks().take(pa.array(qi)), ids.take(pa.array(ci)), pa.array(score)], names)

    def searched(queries: DataFrame, first: int, last: int) -> DataFrame:
        among = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
        left = queries.withColumn("shard", among).groupBy("block", "shard")
        right = held.where(F.col("shard").between(first, last)).select("block", "shard", "uid", "vec_id", "v").groupBy("block", "shard")
        return left.cogroup(right).applyInArrow(search, schema)

    none = F.lit(float("-inf"))
    best = searched(asks.withColumn("floor", none), 0, 0)
    if shards > 1:
        best = materialize(best, "first-shard")
        floors = best.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
        further = asks.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", none))
        best = best.union(searched(materialize(further.select("block", "uid", "vec_id", "v", "floor"), "queries"), 1, shards - 1))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
