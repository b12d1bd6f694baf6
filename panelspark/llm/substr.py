"""Substring deduplication with fixed-block anchors.

A window of ``window`` words always holds a whole block of ``block`` = (window + 1) // 2 words whose place
in its document is a multiple of ``block``. Those non-overlapping blocks are the anchors. Every rolling
block of every document probes them; a probe that meets an anchor elsewhere, and an anchor so met, mark
the windows around them. Only marked windows are compared exactly: runs of windows whose word sequences
agree are the maximal exact repeats, and each window learns the smallest document id that has it.

Probes travel packed: a mapper deals the rolling blocks of a few million words over hash buckets, as four
bytes of hash and a short step to the next place. A bucket needs no document ids; the batch's directory
travels beside it and turns places back into documents.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import key_map, materialize, may_be_in, only, text_partitions

#: Words after which a mapper's batch is dealt out; a batch holds at most this many and one document more, eight bytes a word.
BATCH_WORDS = 1 << 20
#: Buckets for each partition of a text shuffle.
BUCKETS_PER_PARTITION = 4
STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
MASK = (1 << 64) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64) if words else np.zeros(0, np.uint64)


def rolling(h: np.ndarray, width: int, step: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for j in range(width):
        out += h[j : j + n] * np.uint64(power)
        power = power * step & MASK
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _deal(uid: int, bucket: np.ndarray, n_buckets: int, payload: Callable[[np.ndarray], bytes]) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) for the rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
    for b, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if hi > lo:
            yield b, struct.pack("<q", uid) + payload(order[lo:hi])


def _steps(places: np.ndarray) -> bytes:
    steps = np.diff(places, prepend=places[:1]).astype(np.uint32)
    small = len(steps) == 0 or steps.max() < 1 << 16
    return struct.pack("<I?", int(places[0]), small) + (steps.astype("<u2") if small else steps.astype("<u4")).tobytes()


def _unsteps(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    first, small = struct.unpack_from("<I?", data, at)
    steps = np.frombuffer(data, "<u2" if small else "<u4", n, at + 5)
    return (first + np.cumsum(steps, dtype=np.int64)).astype(np.uint32), at + 5 + steps.nbytes


DEALT = "bucket long, payload binary"
#: Kinds of what a batch finds: its directory, places, and places with those that follow them.
DIRECTORY, HITS, FOLLOW = 0, 1, 2
FOUND = "uid long, kind int, data binary"
PLACES = "doc_id long, th long, places binary"


def _aside(uid: int, kind: int, data: bytes) -> tuple[int, bytes]:
    """What a batch tells its own documents; it has a bucket of its own, which passes it on untouched."""
    return -1 - uid, struct.pack("<qB", uid, kind) + data


def _directory(uid: int, ids: list[int], ths: list[int], sizes: list[int]) -> tuple[int, bytes]:
    data = struct.pack("<I", len(ids)) + np.array(ids, "<i8").tobytes() + np.array(ths, "<i8").tobytes() + np.array(sizes, "<u4").tobytes()
    return _aside(uid, DIRECTORY, data)


def _batches(batches: Iterator[pa.RecordBatch], flush: Callable[[int, list], Iterator[tuple[int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """Gather documents (doc_id, th, word hashes, rest) up to BATCH_WORDS and give each batch a number of its own."""
    only("substrings dealt")
    base, seq, held, words = TaskContext.get().partitionId() << 24, 0, [], 0

    def emit() -> pa.RecordBatch:
        rows = list(flush(base + seq, held))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    for batch in batches:
        for row in zip(*batch.columns):
            hashes = word_hashes((row[2].as_py() or b"").split())
            held.append((row[0].as_py(), row[1].as_py(), hashes, *(x.as_py() for x in row[3:])))
            words += len(hashes)
            if words >= BATCH_WORDS:
                yield emit()
                held, words, seq = [], 0, seq + 1
    if held:
        yield emit()


def _by_place(found: DataFrame) -> DataFrame:
    """Places of the batches turned into places of documents: one row per (doc_id, th)."""

    def expand(table: pa.Table) -> pa.Table:
        only("substrings placed")
        rows = list(zip(table["kind"].to_pylist(), table["data"].to_pylist()))
        head = next((d for kind, d in rows if kind == DIRECTORY), None)
        hits = [np.frombuffer(d, "<u4") for kind, d in rows if kind == HITS]
        if head is None or not hits:
            return pa.table({"doc_id": pa.array([], pa.int64()), "th": pa.array([], pa.int64()), "places": pa.array([], pa.binary())})
        (n,) = struct.unpack_from("<I", head)
        ids, ths = np.frombuffer(head, "<i8", n, 4), np.frombuffer(head, "<i8", n, 4 + 8 * n)
        starts = np.concatenate([[0], np.cumsum(np.frombuffer(head, "<u4", n, 4 + 16 * n), dtype=np.int64)])
        at = np.unique(np.concatenate(hits)).astype(np.int64)
        for _, d in (r for r in rows if r[0] == FOLLOW):
            lead, own = np.frombuffer(d, "<u4").reshape(2, -1)
            at = np.union1d(at, own[np.isin(lead, at)])
        doc = np.searchsorted(starts, at, side="right") - 1
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        which = doc[cuts[:-1]]
        places = [(at[a:b] - starts[d]).astype("<u4").tobytes() for a, b, d in zip(cuts, cuts[1:], which)]
        return pa.table({"doc_id": pa.array(ids[which]), "th": pa.array(ths[which]), "places": pa.array(places, pa.binary())})

    return found.groupBy("uid").applyInArrow(expand, PLACES).groupBy("doc_id", "th").agg(F.min("places").alias("places"))


def _meet(dealt: DataFrame, settle: Callable[[list[bytes]], Iterator[tuple[int, np.ndarray]]], name: str) -> DataFrame:
    """Bring each bucket together, keep the places that ``settle`` reports, and pass directories through."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        only("substrings met")
        payloads = table["payload"].to_pylist()
        if key[0].as_py() < 0:
            rows = [(*struct.unpack_from("<qB", p), p[9:]) for p in payloads]
        else:
            rows = [(uid, HITS, places.astype("<u4").tobytes()) for uid, places in settle(payloads)]
        return pa.table({"uid": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    return materialize(dealt.groupBy("bucket").applyInArrow(run, FOUND), name)


def _report(uids: list[int], counts: list[int], places: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The hit places of each payload; payloads lie end to end."""
    ends = np.cumsum(counts)
    for uid, lo, hi in zip(uids, ends - counts, ends):
        own = hit[lo:hi]
        if own.any():
            yield uid, places[lo:hi][own]


def _anchor_hits(docs: DataFrame, block: int, n_buckets: int) -> DataFrame:
    def flush(uid: int, held: list) -> Iterator[tuple[int, bytes]]:
        sizes = [len(d[2]) for d in held]
        yield _directory(uid, [d[0] for d in held], [d[1] for d in held], sizes)
        r = rolling(np.concatenate([d[2] for d in held]), block, int(STEP[0]))
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])[: len(r)]
        inside = place + block <= np.repeat(np.array(sizes, np.int32), sizes)[: len(r)]
        g = np.flatnonzero(inside).astype(np.uint32)
        r, anchor = r[inside], (place % block == 0)[inside]
        del place, inside
        # One of each block travels. Where the batch has it twice and once as an anchor, all its places are
        # met; where it has it twice and never so, the others follow the one that travels.
        order = np.argsort(r, kind="stable").astype(np.uint32)
        new = np.concatenate([[True], np.diff(r[order]) != 0])[: len(r)]
        group = np.cumsum(new, dtype=np.int32) - 1
        many = np.bincount(group) > 1
        anchored = np.logical_or.reduceat(anchor[order], np.flatnonzero(new)) if len(r) else np.zeros(0, bool)
        lead = order[new]
        met = (many & anchored)[group]
        if met.any():
            yield _aside(uid, HITS, g[order[met]].astype("<u4").tobytes())
        led = (many & ~anchored)[group] & ~new
        if led.any():
            yield _aside(uid, FOLLOW, np.concatenate([g[lead[group[led]]], g[order[led]]]).astype("<u4").tobytes())
        back = np.argsort(lead)
        r, g, anchor = r[lead[back]], g[lead[back]], anchored[back]
        low = r.astype(np.uint32)

        def payload(rows: np.ndarray) -> bytes:
            return struct.pack("<I", len(rows)) + low[rows].astype("<u4").tobytes() + np.packbits(anchor[rows]).tobytes() + _steps(g[rows])

        yield from _deal(uid, ((r >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, payload)

    def settle(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        uids, keys, anchors, places, counts = [], [], [], [], []
        for p in payloads:
            uid, n = struct.unpack_from("<qI", p)
            uids.append(uid)
            counts.append(n)
            keys.append(np.frombuffer(p, "<u4", n, 12))
            at = 12 + 4 * n
            anchors.append(np.unpackbits(np.frombuffer(p, np.uint8, -(-n // 8), at), count=n))
            places.append(_unsteps(p, at + -(-n // 8), n)[0])
        key, anchor, place = np.concatenate(keys), np.concatenate(anchors).astype(bool), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group = np.cumsum(first) - 1
        met = (np.bincount(group) > 1) & (np.bincount(group, weights=anchor[order]) > 0)
        hit = np.zeros(len(key), bool)
        hit[order] = met[group]
        yield from _report(uids, counts, place, hit)

    dealt = docs.mapInArrow(lambda batches: _batches(batches, flush), DEALT)
    return _by_place(_meet(dealt, settle, "anchor-hits"))


def _repeats(marked: DataFrame, window: int, block: int, n_buckets: int) -> DataFrame:
    """Starts of windows that a document with a smaller id has too; ``marked`` brings the places of met blocks."""
    reach = window - block

    def flush(uid: int, held: list) -> Iterator[tuple[int, bytes]]:
        yield _directory(uid, [d[0] for d in held], [d[1] for d in held], [len(d[2]) for d in held])
        ids, a, b, g, base = [], [], [], [], 0
        for doc_id, _, h, places in held:
            n = len(h) - window + 1
            if n > 0:
                ends = np.frombuffer(places, "<u4").astype(np.int64)
                cover = np.zeros(len(h) + 2, np.int64)
                np.add.at(cover, np.maximum(ends - reach, 0), 1)
                np.add.at(cover, ends + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover)[:n] > 0)
                a.append(rolling(h, window, int(STEP[0]))[starts])
                b.append(rolling(h, window, int(STEP[1]))[starts])
                g.append((starts + base).astype(np.uint32))
                ids.append(np.full(len(starts), doc_id, np.int64))
            base += len(h)
        if not g:
            return
        ids, a, b, g = map(np.concatenate, (ids, a, b, g))
        if not len(g):
            return
        # Of each window the places in the batch's smallest document travel; any other document's are repeats.
        order = np.lexsort((g, ids, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        least = ids[order[new]][np.cumsum(new) - 1]
        again = ids[order] > least
        if again.any():
            yield _aside(uid, HITS, g[order[again]].astype("<u4").tobytes())
        # Of those, the first place stands for the others, which follow it.
        led = ~again & ~new
        if led.any():
            yield _aside(uid, FOLLOW, np.concatenate([g[order[new]][(np.cumsum(new) - 1)[led]], g[order[led]]]).astype("<u4").tobytes())
        keep = np.sort(order[new])
        ids, a, b, g = ids[keep], a[keep], b[keep], g[keep]

        def payload(rows: np.ndarray) -> bytes:
            own = ids[rows]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            counts = np.diff(np.concatenate([cuts, [len(rows)]]))
            return struct.pack("<II", len(rows), len(cuts)) + a[rows].tobytes() + own[cuts].tobytes() + counts.astype("<u4").tobytes() + _steps(g[rows])

        if len(g):
            yield from _deal(uid, (b % np.uint64(n_buckets)).astype(np.int64), n_buckets, payload)

    def settle(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        uids, keys, ids, places, counts = [], [], [], [], []
        for p in payloads:
            uid, n, m = struct.unpack_from("<qII", p)
            uids.append(uid)
            counts.append(n)
            keys.append(np.frombuffer(p, "<u8", n, 16))
            at = 16 + 8 * n
            ids.append(np.repeat(np.frombuffer(p, "<i8", m, at), np.frombuffer(p, "<u4", m, at + 8 * m)))
            places.append(_unsteps(p, at + 12 * m, n)[0])
        key, doc, place = np.concatenate(keys), np.concatenate(ids), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        least = np.minimum.reduceat(doc[order], np.flatnonzero(first))
        hit = np.zeros(len(key), bool)
        hit[order] = doc[order] > least[np.cumsum(first) - 1]
        yield from _report(uids, counts, place, hit)

    dealt = marked.mapInArrow(lambda batches: _batches(batches, flush), DEALT)
    return _by_place(_meet(dealt, settle, "repeats"))


def substring_dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the text, if asked).

    A word goes if some window of ``window`` words over it also starts in a document with a smaller id.
    Windows are judged on the input texts. Word hashes have 64 bits; windows are compared by more than 64.

    A null text has no words. Rows of one id never make each other smaller, so repeated rows keep or lose
    the same words. A row without an id loses nothing and makes no other row lose a word. Texts shorter
    than a window keep all; an empty table gives no rows; other columns are ignored. ``docs`` is read
    five times; its texts are shuffled where they hold a met block, and once more where they may lose words.
    """
    block = (window + 1) // 2
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t"))
    known = rows.where("doc_id is not null")
    n_buckets = BUCKETS_PER_PARTITION * text_partitions(rows, "t")
    hits = _anchor_hits(known, block, n_buckets)
    gone = materialize(_repeats(known.join(hits, ["doc_id", "th"]).select("doc_id", "th", "t", "places"), window, block, n_buckets), "repeat-places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("substrings cut")
        for batch in batches:
            n_words, n_removed, digests, kept = [], [], [], []
            for t, places in zip(batch.column(1), batch.column(2)):
                words = (t.as_py() or b"").split()
                n_words.append(len(words))
                if places.is_valid:
                    starts = np.frombuffer(places.as_py(), "<u4").astype(np.int64)
                    cover = np.bincount(starts, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(starts + window, minlength=len(words) + 1)[: len(words) + 1]
                    stay = np.cumsum(cover)[: len(words)] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                out = b" ".join(words)
                digests.append(hashlib.sha256(out).hexdigest())
                if keep_text:
                    kept.append(out)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text)

    # Texts that surely lose nothing stay where they are; only the others are shuffled to their places.
    key = F.xxhash64("doc_id", "th")
    tagged = may_be_in(rows.withColumn("_key", key), "_key", key_map(gone.select(key.alias("_key")), "_key", gone.count()))
    whole = tagged.where("not _may").select("doc_id", "t", F.lit(None).cast("binary").alias("places"))
    joined = tagged.where("_may").join(gone, ["doc_id", "th"], "left").select("doc_id", "t", "places").unionByName(whole)
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
