"""SimHash near-duplicates: exact search within a Hamming radius by bit-sliced comparison.

Fingerprints are cut into ``radius + m`` blocks. Two of them within the radius agree on at least ``m``
blocks, so each is filed under every choice of ``m`` blocks and compared only inside those buckets.

In a bucket the 64 bit positions are stored as vertical planes, one bit per fingerprint. XOR of the planes
with shifted copies (or with one fingerprint's bits) yields the differing bits of 64 pairs per machine
word; carry-save counters add them up plane by plane, and words in which every pair is beyond the radius
are given up. Only distinct fingerprints are compared, and a bucket reports a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import join_unique, key_map, materialize, may_be_in, only, released, shielded
from panelspark.llm.components import connected_components
from panelspark.llm.setjoin import similar, tiled

#: Fingerprints in a bucket up to which all its pairs are compared at once; larger ones are searched from seeds.
PAIRED = 64
#: Fingerprints in a bucket beyond which it is dealt out in blocks to many tasks.
BUCKET_ROWS = 1 << 16
CHUNK = 1 << 16
#: Rows gathered before their buckets are searched: enough that a plane is long and a call does much.
SEARCHED = 1 << 16
#: Odd multipliers that turn a shingle's hash into those of further lanes.
STEPS = np.array([1, *[pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 64)]], np.uint64)


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42, lanes: int = 1) -> bytes:
    """SimHash of the shingles of ``words`` words, big-endian; zero if there is no word.

    The first 64-bit lane is of the shingles' hashes; further lanes are of mixes of them.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return bytes(8 * lanes)
    joined = b" ".join(tokens)
    width = min(words, len(tokens))
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    digest = xxhash.xxh64_digest
    n, ones = len(tokens) - width + 1, np.zeros(64 * lanes, np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        raw = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(ends[lo:hi], ends[lo + width : hi + width])])
        if lanes == 1:
            rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        else:
            h = np.frombuffer(raw, ">u8").astype(np.uint64)[:, None] * STEPS[:lanes]
            h[:, 1:] ^= h[:, 1:] >> np.uint64(31)
            h[:, 1:] *= np.uint64(0x94D049BB133111EB)
            rows = h.astype(">u8").view(np.uint8).reshape(len(h), 8 * lanes)
        for row in range(0, len(rows), 2048):
            ones += np.unpackbits(rows[row : row + 2048], axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        for batch in batches:
            raw = b"".join([fingerprint(t.as_py(), words) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64 x lanes, words) bit planes of an (n, lanes) array: bit i of plane p is bit p of fingerprint i."""
    n, lanes = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8 * lanes), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -n % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(differ: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of ``lanes`` for which at most ``radius`` of the rows of ``differ`` are set.

    Counters are kept as bit planes too; a word is abandoned once all its pairs are beyond the radius.
    """
    out = np.zeros_like(lanes)
    live = np.flatnonzero(lanes)
    width = max(1, radius.bit_length())
    counters = [np.zeros(len(live), np.uint64) for _ in range(width)]
    beyond = ~lanes[live]
    for start in range(0, len(differ), 8):
        if not len(live):
            return out
        for plane in differ[start : start + 8]:
            carry = plane[live]
            for c in counters:
                carry_out = c & carry
                c ^= carry
                carry = carry_out
            beyond |= carry
        more, same = np.zeros(len(live), np.uint64), np.full(len(live), ~np.uint64(0))
        for i in reversed(range(width)):  # counter > radius, from the highest bit down
            if radius >> i & 1:
                same &= counters[i]
            else:
                more |= same & counters[i]
                same &= ~counters[i]
        beyond |= more
        keep = beyond != ~np.uint64(0)
        if not keep.all():
            live, beyond, counters = live[keep], beyond[keep], [c[keep] for c in counters]
    out[live] = ~beyond
    return out


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


Pairs = tuple[np.ndarray, np.ndarray]


def _pairs(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Pairs:
    """Links, as rows, inside groups that lie end to end in ``fps``, largest first: each shift compares all groups at once."""
    planes, left, right = planes_of(fps), [], []
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps))
    for shift in range(1, int(sizes[0])):
        valid = rest > shift
        rows = int(np.flatnonzero(valid)[-1]) + 1
        words = -(-rows // 64)
        lanes = np.packbits(np.pad(valid[:rows], (0, words * 64 - rows)), bitorder="little").view(np.uint64)
        whole, bit = shift // 64, np.uint64(shift % 64)
        a = planes[:, whole : whole + words]
        a = np.pad(a, ((0, 0), (0, words - a.shape[1])))
        if bit:
            b = planes[:, whole + 1 : whole + 1 + words]
            a = (a >> bit) | (np.pad(b, ((0, 0), (0, words - b.shape[1]))) << (np.uint64(64) - bit))
        hit = _lanes(within(planes[:, :words] ^ a, lanes, radius))
        left.append(hit)
        right.append(hit + shift)
    return (np.concatenate(left), np.concatenate(right)) if left else (sizes[:0], sizes[:0])


def _search(fps: np.ndarray, radius: int) -> Pairs:
    """Spanning forest, as rows, of one large group: breadth first, each found row against those not yet found.

    Planes are built anew only when half of their rows have been found, so a group costs as many builds as
    it has halvings, however its links run.
    """
    left, right = [], []
    ones, bits = np.uint64(0xFFFFFFFFFFFFFFFF), np.arange(64 * fps.shape[1])
    held, alive, count, first, frontier = np.arange(len(fps)), np.ones(len(fps), bool), len(fps), 0, []
    planes = planes_of(fps)
    while count:
        if not frontier:
            while not alive[first]:
                first += 1
            alive[first] = False
            count -= 1
            frontier.append(int(held[first]))
        if 2 * count < len(held):
            held, alive, first = held[alive], np.ones(count, bool), 0
            planes = planes_of(fps[held]) if count >= 256 else None
        f = frontier.pop()
        if not count:
            break
        if planes is None:
            near = np.flatnonzero(alive & (np.bitwise_count(fps[held] ^ fps[f]).sum(axis=1) <= radius))
        else:
            set_bits = (fps[f][bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)
            lanes = np.packbits(np.pad(alive, (0, -len(alive) % 64)), bitorder="little").view(np.uint64)
            near = _lanes(within(planes ^ (set_bits * ones)[:, None], lanes, radius))
        if len(near):
            found = held[near]
            left.append(np.full(len(found), f))
            right.append(found)
            frontier.extend(found.tolist())
            alive[near] = False
            count -= len(found)
    return (np.concatenate(left), np.concatenate(right)) if left else (held[:0], held[:0])


def bucket_links(fps: np.ndarray, keys: np.ndarray, radius: int) -> Pairs:
    """Links, as rows, among fingerprints (n, lanes) of equal key; ``keys`` is sorted."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    sizes = ends - starts
    out = []
    small = np.flatnonzero((sizes > 1) & (sizes <= PAIRED))
    if len(small):
        small = small[np.argsort(-sizes[small], kind="stable")]
        n = sizes[small]
        rows = np.repeat(starts[small] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, b = _pairs(fps[rows], n, radius)
        out.append((rows[a], rows[b]))
    for g in np.flatnonzero(sizes > PAIRED):
        a, b = _search(fps[starts[g] : ends[g]], radius)
        out.append((a + starts[g], b + starts[g]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (starts[:0], starts[:0])


def stars(a: np.ndarray, b: np.ndarray) -> Pairs:
    """Links with the components of the links ``a`` to ``b``: each node with the least of its component.

    A group that many tables find in part then gives nearly the same few links in each of them.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], least)
        np.minimum.at(hooked, root[b], least)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        root = hooked[root]
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def by_bucket(batches: Iterator[pa.RecordBatch], columns_of: Callable, links: Callable) -> Iterator[pa.RecordBatch]:
    """Feed ``links`` whole tiles of a stream sorted by tile; one that goes on into the next batch waits for it.

    ``columns_of`` gives a batch's arrays, the second of which is the tile; ``links`` turns the arrays of
    whole tiles into a batch of links.
    """
    only("simhash")
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        columns = columns_of(batch)
        if not len(columns[0]):
            continue
        tile = columns[1]
        done = held and (tile[0] != held[-1][1][-1] or tile[-1] != tile[0])  # something ends in or before this batch
        held.append(columns)
        n += len(tile)
        if n < SEARCHED or not done and len(held) > 1:
            continue
        cut = len(tile) - int((tile[::-1] != tile[-1]).argmax()) if tile[0] != tile[-1] else 0
        if not cut and len(held) == 1:
            continue
        held[-1] = tuple(c[:cut] for c in columns)
        yield links(*(np.concatenate(x) for x in zip(*held)))
        held, n = [tuple(c[cut:] for c in columns)], len(tile) - cut
    if n:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def tables(n: int, radius: int) -> list[int]:
    """Masks of the bits that each table files by: enough of them that random buckets of ``n`` rows stay small."""
    agree = 1
    while agree < 4 and n >> (64 * agree // (radius + agree)) > 8:
        agree += 1
    blocks = radius + agree
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets_dealt(filed: DataFrame, item: str, key: str, bucket_rows: int) -> DataFrame:
    """``filed`` with ``tile``, dealt out and sorted by it: any two rows of a key meet in one tile.

    Keys are counted first. One of more than ``bucket_rows`` rows is dealt out in pairs of blocks, before
    its rows travel, so no task ever holds more than two blocks of it.
    """
    over = materialize(filed.groupBy(key).count().where(F.col("count") > bucket_rows).select(key, F.ceil(F.col("count") / bucket_rows).cast("int").alias("_m")), "large-buckets")
    if over.isEmpty():
        out = filed.withColumnRenamed(key, "tile")
    else:
        mine = F.pmod(F.xxhash64(item), F.col("_m")).cast("int")
        hot = filed.join(over, key).withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        tile = F.xxhash64(key, F.least("_mine", "_other"), F.greatest("_mine", "_other"))
        rest = filed.join(over.select(key), key, "left_anti")
        columns = [c for c in filed.columns if c != key]
        out = rest.select(F.col(key).alias("tile"), *columns).unionByName(hot.select(tile.alias("tile"), *columns))
    return out.repartition("tile").sortWithinPartitions("tile")


def radius_links(distinct: DataFrame, n: int, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) over distinct fingerprints: links whose components are those of all pairs within ``radius``."""
    masks = tables(n, radius)
    mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t") + 1)
    each = distinct.select("fp", F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("t"))
    filed = each.select("fp", F.xxhash64("t", F.col("fp").bitwiseAND(mask)).alias("key"))

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))

    def links(fp: np.ndarray, tile: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(fp.view(np.uint64)[:, None], tile, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    dealt = buckets_dealt(filed, "fp", "key", bucket_rows).select("fp", "tile")
    return materialize(dealt.mapInArrow(lambda batches: by_bucket(batches, columns, links), "a long, b long"), "simhash-links")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits) and component_id.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest document id that links reach. Null and wordless texts have fingerprint zero and link like any
    other. Repeated rows share a component. A null id stays null and never names a component unless the
    component has no other. An empty table gives no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words, doc_id, text), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    distinct, rows = reps.agg(F.count("*"), F.sum("n")).first()
    linked = connected_components(radius_links(reps.select("fp"), distinct, radius, bucket_rows)).toDF("fp", "root")
    named = materialize(linked.join(reps, "fp"), "linked-fingerprints")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    of_linked = join_unique(named.select("fp", "root"), ids, "root", "m", distinct).select("fp", "component_id")
    of_all = materialize(reps.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "fingerprint-components")
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_unique(prints, of_all, "fp", "n", rows or 0).select("doc_id", hex16.alias("fingerprint"), "component_id")


# ---- near copies by similarity -----------------------------------------------------------------------

#: Lanes of a wide fingerprint; recall of the search at the similarity asked for; standard deviations of margin.
LANES, RECALL, MARGIN = 4, 0.995, 3.5
#: Documents and shingles of a block whose sets are compared exactly.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1 << 19
#: Distinct documents from which on keys have 24 bits, not 16, so that buckets stay small.
WIDE_KEYS = 1 << 28


def angle(similarity: float) -> float:
    """Share of differing bits expected of two shingle sets of this Jaccard similarity and like size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of a text's shingles of ``words`` words; all its words, if they are fewer."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s : e - 1]) for s, e in zip(ends, ends[width:])]), np.uint64))


def set_print(h: np.ndarray, lanes: int) -> bytes:
    """SimHash of a set of hashes, each counted once, in 64 bits a lane."""
    ones = np.zeros(64 * lanes, np.int64)
    for lo in range(0, len(h), 2048):
        mixed = h[lo : lo + 2048, None] * STEPS[1 : lanes + 1]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h)).tobytes()


@lru_cache(maxsize=4)
def _orders(lanes: int, count: int) -> np.ndarray:
    """Orders of the bits of a fingerprint: as they are, then fixed shuffles."""
    rng = np.random.default_rng(17)
    return np.stack([np.arange(64 * lanes), *(rng.permutation(64 * lanes) for _ in range(count - 1))])


def candidate_groups(prints: DataFrame, n: int, similarity: float, lanes: int, recall: float, key_bytes: int, bucket_rows: int) -> DataFrame:
    """(node, root) of distinct (node, fp): components of links within the radius of ``similarity`` and a margin.

    Fingerprints are filed under runs of ``key_bytes`` bytes of their bits, in order and in fixed shuffles of
    them, as many as find a pair at ``similarity`` with probability ``recall``.
    """
    width = 64 * lanes
    p = angle(similarity)
    radius = int(width * p + MARGIN * math.sqrt(width * p * (1 - p)))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** (8 * key_bytes)))
    each = width // 8 // key_bytes
    orders = -(-count // each)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        for batch in batches:
            if batch.num_rows:
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
                keys = np.concatenate([np.packbits(bits[:, o], axis=1) for o in _orders(lanes, orders)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["node", "fp", "keys"])

    keyed = prints.mapInArrow(file, "node long, fp binary, keys binary")
    at = [F.lit(i) for i in range(count)]
    run = F.substring("keys", F.floor(F.col("t") / each).cast("int") * (width // 8) + F.col("t") % each * key_bytes + 1, F.lit(key_bytes))
    filed = keyed.select("node", "fp", "keys", F.explode(F.array(*at)).alias("t")).select("node", "fp", F.xxhash64("t", run).alias("key"))

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        raw = b"".join(batch.column(2).to_pylist())
        return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), np.frombuffer(raw, np.uint64).reshape(-1, lanes)

    def links(node: np.ndarray, tile: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(fps, tile, radius)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(node[a], node[b])], ["a", "b"])

    dealt = buckets_dealt(filed, "node", "key", bucket_rows).select("node", "tile", "fp")
    return connected_components(dealt.mapInArrow(lambda batches: by_bucket(batches, columns, links), "a long, b long"))


def verified_links(members: DataFrame, texts: DataFrame, words: int, similarity: float, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) of nodes whose shingle sets have the similarity; ``members`` has (node, root, size), ``texts`` (node, t).

    Only nodes of one root are compared, exactly, in tiles of bounded size; sets travel once a tile.
    """
    tiles = materialize(tiled(members, "node", "root", "size", block_docs, block_shingles), "similar-tiles")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], ["node", "h"])

    sets = texts.mapInArrow(shingled, "node long, h binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        now, nodes, held = None, [], []

        def found() -> list[tuple[int, int]]:
            return [(nodes[a], nodes[b]) for a, b in similar(held, similarity)] if len(held) > 1 else []

        for batch in batches:
            out = []
            for tile, node, h in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != now:
                    out += found()
                    now, nodes, held = tile, [], []
                nodes.append(node)
                held.append(np.frombuffer(h, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])
        out = found()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

    dealt = tiles.join(sets, "node").select("tile", "node", "h").repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(compare, "a long, b long")


def _row_keys(doc_id: str, th: str) -> list:
    """Columns that name a row by id, null or not, and the hash of its text."""
    own = F.col(doc_id).cast("long")
    return [F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_null"), F.col(th).alias("_th")]


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = LANES, recall: float = RECALL, key_bytes: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, th, group) per row, ``th`` a hash of the text: near copies of one another share a group.

    Wide fingerprints of shingle sets, searched by bit planes, say which documents may be similar; in the
    groups so found, shingle sets are compared and only pairs of ``similarity`` or more are links. Groups are
    components of links. A pair at ``similarity`` is found with probability ``recall``, more similar ones
    more surely; a pair below it never links. Null and wordless texts have the empty set and form one
    group; so do texts of equal sets, repeated rows among them. An empty table gives no rows. ``docs`` needs
    doc_id and text, other columns are ignored; it is read twice.
    """

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("simhash")
        for batch in batches:
            fps, nodes, sizes = [], [], []
            for t in batch.column(2):
                h = shingle_set(t.as_py(), words)
                fps.append(set_print(h, lanes))
                nodes.append(xxhash.xxh64_digest(h.tobytes()))
                sizes.append(len(h))
            node = np.frombuffer(b"".join(nodes), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "th", "node", "fp", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t"))
    prints = materialize(rows.mapInArrow(prints_of, "doc_id long, th long, node long, fp binary, size long"), "wide-fingerprints")
    distinct = materialize(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("pick"), F.count("*").alias("n")), "distinct-documents")
    count, total = distinct.agg(F.count("*"), F.sum("n")).first()
    key_bytes = key_bytes or (2 if count < WIDE_KEYS else 3)
    some = materialize(candidate_groups(distinct.where("size > 0").select("node", "fp"), count, similarity, lanes, recall, key_bytes, bucket_rows), "candidate-groups")
    members = materialize(some.join(distinct, "node").select("node", "root", "size", *_row_keys("pick.doc_id", "pick.th")), "candidate-members")
    released(docs.sparkSession)
    keys = ["_id", "_null", "_th"]
    mapped = key_map(members, "_th", members.count())
    may = may_be_in(rows, "th", mapped).where("_may")
    one = may.select("t", *_row_keys("doc_id", "th")).join(members.select("node", *keys), keys).groupBy("node").agg(F.min("t").alias("t"))
    links = verified_links(members.select("node", "root", "size"), one, words, similarity)
    roots = connected_components(links)
    named = distinct.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("group"))
    return join_unique(prints.select("doc_id", "th", "node"), materialize(named, "similar-roots"), "node", "n", total or 0).select("doc_id", "th", "group")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) less near copies: of each group the row with the smallest id stays.

    Null ids stand last. Of rows equal in id and text one stays, whichever comes first if other columns
    differ. Null and wordless texts are copies of one another. All columns stay; an empty table stays empty.
    """
    columns = docs.columns
    docs, back = shielded(docs, "doc_id", "text")
    groups = materialize(similar_documents(docs, **options), "similar-groups")
    stays = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("s")).select("s.doc_id", "s.th")
    keys = ["_id", "_null", "_th"]
    counted = groups.select(*_row_keys("doc_id", "th")).groupBy(*keys).agg(F.count("*").alias("_n"))
    verdict = materialize(counted.join(stays.select(*_row_keys("doc_id", "th"), F.lit(True).alias("_stays")), keys, "left"), "similar-verdicts")
    # Only texts that may go, or that stay once of several times, travel.
    moved = verdict.where("_stays is null or _n > 1")
    mapped = key_map(moved, "_th", moved.count())
    released(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    tagged = may_be_in(docs.withColumns({"_id": F.coalesce(own, F.lit(0)), "_null": own.isNull(), "_th": F.xxhash64("text")}), "_th", mapped)
    may = tagged.where("_may")
    out = tagged.where("not _may").union(may.join(verdict.where("_stays and _n = 1").select(*keys), keys, "left_semi").select(*tagged.columns))
    repeated = verdict.where("_stays and _n > 1").select(*keys)
    if not repeated.isEmpty():
        out = out.union(may.join(repeated, keys, "left_semi").dropDuplicates(keys).select(*tagged.columns))
    return out.select(*docs.columns).withColumnsRenamed(back).select(*columns)
