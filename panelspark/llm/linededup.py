"""Fuzzy line deduplication: MinHash bands, exact Jaccard in whole buckets, union-find.

A line's features are character shingles of the lower-cased line: nine characters from each character on, or,
if asked, from each word's start on only. A signature takes, for each of a number of fixed keys, the shingle
hash nearest to the key by XOR; hashes being random, that is a uniformly drawn shingle, the same for two lines
with the probability of their Jaccard similarity. Lines with an equal band of signature values share a bucket.

Every pair of a bucket is settled exactly. Two lines of the similarity asked for share one of their rarest
shingles, so a line is held against those that it shares such a shingle with; lines found similar leave the
bucket's pool and search in turn, so a group of copies costs its size and not its square. Large buckets are
dealt out as pairs of blocks.

Lines are known by 64-bit hashes of their text. Lines in no bucket, places of lines that are neither repeated nor
linked, and documents that lose no line are told by bitmaps and not shuffled, but for the few that a bitmap does
not clear; what is shuffled is joined exactly. Signatures and comparisons are numpy over Arrow batches, the rest is DataFrame
operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import key_map, materialize, may_be_in, only
from panelspark.llm.components import connected_components
from panelspark.llm.setjoin import similar, tiled

#: Characters of a shingle; signature values in a band; bands. At similarity 0.8 a pair meets with probability 0.987.
SHINGLE, ROWS, BANDS = 9, 3, 6
#: Lines and characters of a block; a bucket of more is compared block by block.
BLOCK_LINES, BLOCK_CHARS = 2048, 4 << 20
#: Characters hashed at a time.
CHUNK = 1 << 18
#: Odd multipliers, one for each character of a shingle.
STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _keys(n: int) -> list[int]:
    """Spread 32-bit keys."""
    out, x = [], 0x9E3779B9
    for _ in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(x)
    return out


def shingles(lines: list[str], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines that hold a word, end to end, and where each line's begin.

    A shingle starts at each character that has eight more after it (at the first, in a shorter line), or,
    if not ``every``, at each word's start, and ends with the line at the latest.
    """
    sizes = np.array([len(x) for x in lines], np.int64)
    joined = ("\0" * SHINGLE).join(lines) + "\0" * SHINGLE
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes + SHINGLE)
    starts = ends - sizes - SHINGLE
    if every:
        takes = np.maximum(sizes - SHINGLE + 1, 1)
        here = np.repeat(starts - (np.cumsum(takes) - takes), takes) + np.arange(takes.sum())
    else:
        word = ~np.isin(chars, BLANK)
        word[(np.repeat(ends - SHINGLE, SHINGLE).reshape(-1, SHINGLE) + np.arange(SHINGLE)).ravel()] = False
        here = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        takes = np.diff(np.searchsorted(here, np.append(starts, len(chars))))
    wide = chars.astype(np.uint64)
    inside = np.ones(len(chars), bool)
    inside[(np.repeat(ends - SHINGLE, SHINGLE).reshape(-1, SHINGLE) + np.arange(SHINGLE)).ravel()] = False
    wide += inside  # a character is never what stands after the line
    total = len(wide)
    h = np.zeros(total, np.uint64)
    for i, step in enumerate(STEPS):
        h[: total - i] += wide[i:] * step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h[here], np.cumsum(takes) - takes


def signatures(lines: list[str], every: bool) -> np.ndarray:
    """(lines, values) of 32 bits: for each key the shingle hash nearest to it."""
    h, starts = shingles(lines, every)
    low = h.astype(np.uint32)
    return np.stack([np.minimum.reduceat(low ^ np.uint32(k), starts) for k in _keys(ROWS * BANDS)], axis=1)


def _chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n + SHINGLE
    if lo < len(sizes):
        yield lo, len(sizes)


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, at, line) of the lines that hold a word."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.where(F.col("line").rlike(r"\S"))


def sign(lines: DataFrame, every: bool) -> DataFrame:
    """(h, chars, values) of (h, line): signature values in the order of bands, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lines")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t) for t in texts]
            raw = [row.tobytes() for lo, hi in _chunks(sizes, CHUNK) for row in signatures(texts[lo:hi], every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], ["h", "chars", "values"])

    return lines.select("h", F.lower("line").alias("line")).mapInArrow(run, "h long, chars long, values binary")


def in_map(df: DataFrame, hashed: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose integer hash may be in the stored ``keys``: all that are, few others."""
    return may_be_in(df, hashed, key_map(keys, hashed, keys.count())).where("_may").drop("_may")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """(h, chars, bucket) of the lines whose bucket holds another line, and of few others."""
    span = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("values", b * span + 1, span)) for b in range(BANDS)])
    filed = signed.select("h", "chars", F.explode(bands).alias("bucket"))
    shared = materialize(filed.groupBy("bucket").count().where("count > 1").select("bucket"), "line-buckets")
    return in_map(filed, "bucket", shared)


def tiles(signed: DataFrame) -> DataFrame:
    """(h, tile): lines by what they are compared in, such that any two of a bucket meet in a tile.

    A tile is a bucket, or two blocks of a bucket that is larger than a block. Of tiles of the same lines there is one.
    """
    met = tiled(materialize(shared_buckets(signed), "line-filed"), "h", "bucket", "chars", BLOCK_LINES, BLOCK_CHARS)
    groups = met.groupBy("tile").agg(F.array_sort(F.collect_list("h")).alias("hs")).select("hs").distinct()
    return groups.select(F.explode("hs").alias("h"), F.xxhash64("hs").alias("tile"))


def tile_links(filed: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(a, b) of (tile, h, line), sorted by tile within partitions: a tile's similar lines, linked."""

    def linked(hs: list[int], texts: list[str]) -> list[tuple[int, int]]:
        sets = []
        for lo, hi in _chunks([len(t) for t in texts], CHUNK):
            h, starts = shingles(texts[lo:hi], every)
            sets += [np.unique(x) for x in np.split(h, starts[1:])]
        return [(hs[a], hs[b]) for a, b in similar(sets, similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("lines")
        now, hs, texts = None, [], []
        for batch in batches:
            out = []
            for tile, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != now:
                    if len(hs) > 1:
                        out += linked(hs, texts)
                    now, hs, texts = tile, [], []
                hs.append(h)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])
        out = linked(hs, texts) if len(hs) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    return filed.select("tile", "h", F.lower("line").alias("line")).mapInArrow(run, "a long, b long")


def line_components(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """(h, root): lines linked to others, by hash, and the least hash of their component."""
    lines = lines_of(docs, doc_id, text).select(F.xxhash64("line").alias("h"), "line")
    signed = materialize(sign(lines, every).groupBy("h").agg(F.min("chars").alias("chars"), F.min("values").alias("values")), "line-signatures")
    filed = materialize(tiles(signed), "line-tiles")
    wanted = materialize(filed.select("h").distinct(), "line-wanted")
    held = in_map(lines, "h", wanted).join(wanted, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
    dealt = filed.join(held, "h").select("tile", "h", "line").repartition("tile").sortWithinPartitions("tile")
    links = materialize(tile_links(dealt, similarity, every), "line-links")
    return connected_components(links).toDF("h", "root")


def line_dedup(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, every: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_removed, kept_sha256 (and ``kept``, the text, if asked).

    Of every component of equal or similar lines the first by document id and place stays; the others go.
    Similarity is of the shingles at ``every`` character, or else of those at word starts.
    Lines without a word stay and take no part. A null text has no lines. Rows without an id come last in
    the order. Rows equal in id and text are one document, and lose the same lines. An empty table gives no
    rows; other columns are ignored. Kept lines are joined by newlines.
    """
    occurrences = materialize(lines_of(docs, doc_id, text).select("id", "th", "at", F.xxhash64("line").alias("h")), "lines")
    roots = line_components(docs, similarity, doc_id, text, every)
    again = occurrences.groupBy("h").count().where("count > 1").select("h")
    several = materialize(again.join(roots, "h", "full").select("h", F.coalesce("root", "h").alias("root")), "line-components")
    rooted = materialize(in_map(occurrences, "h", several).join(several, "h").select("root", "id", "th", "at"), "line-places")
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th", "at")).alias("f"))
    same = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th")) & (F.col("at") == F.col("f.at"))
    gone = rooted.join(stays, "root").where(~same).select("id", "th", "at").distinct()
    removed = materialize(gone.groupBy(F.coalesce("id", F.lit(0)).alias("_k"), F.col("id").isNull().alias("_n"), "th").agg(F.collect_list("at").alias("gone")), "line-removed")
    own = F.col(doc_id).cast("long")
    rows = docs.select(own.alias("doc_id"), F.col(text).alias("t"), F.coalesce(own, F.lit(0)).alias("_k"), own.isNull().alias("_n"), F.xxhash64(text).alias("th"))
    key = F.xxhash64("_k", "_n", "th")
    keys = removed.select(key.alias("key"))
    told = may_be_in(rows.withColumn("key", key), "key", key_map(keys, "key", keys.count()))
    joined = told.where("_may").join(removed, ["_k", "_n", "th"], "left").select("doc_id", "t", "gone")
    every_row = joined.union(told.where("NOT _may").select("doc_id", "t", F.lit(None).cast("array<int>")))
    cut = every_row.select("doc_id", F.coalesce(F.split("t", "\n"), F.array().cast("array<string>")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    out = cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(stay, "\n").alias("kept"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), *["kept"] * keep_text)
