"""Token-id output: raw id payloads in sorted blocks, each with a minimal perfect hash index.

Layout of a block, little-endian throughout (a file is a run of blocks, each followed by one newline):

====================  =========================================================================
header                magic, id width, partition, sequence, documents, ids, and section lengths
keys                  int64 document ids, uint8 null flags, uint32 ordinals among equal ids
hash index            levels of bit vectors (a key sits at the first level where it collides with
                      no other), then per slot a 32-bit fingerprint, id offset and id count
payload               ids as uint16 where the vocabulary fits, else uint32
====================  =========================================================================

A lookup hashes the key, finds its level bit, ranks it to a slot, compares the fingerprint and reads
the id range: constant time whatever the block holds.

Blocks leave through Spark's own text writer (a block is one opaque row) and come back through its
``binaryFile`` reader, so any store that Spark reaches will do and only committed tasks leave files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelspark.llm.common import KEPT, fresh_path, materialize, only, text_partitions

MAGIC = b"PSTOKEN1"
HEADER = struct.Struct("<8sIIIIQQQ")
#: Ids after which a block is closed; the block then holds at most this many and one document more.
BLOCK_IDS = 4 << 20
#: Characters encoded at a time, and pieces that an encoder keeps from one slice to the next.
SLICE, KEPT_PIECES = 8 << 20, 100_000
#: Documents taken out of a batch at a time.
TAKEN = 2500
#: Letters below this one are letters to every version of Unicode.
LATIN = "\u0250"
#: Documents that a shard of the key index should hold.
INDEX_DOCS = 1 << 20
MASK = (1 << 64) - 1
#: Fixed value: how a byte-level tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE through the ``tokenizers`` library, each distinct piece of a slice of texts once.

    A byte-level tokenizer never merges across its own word split, and that split always falls before a
    single space that follows a non-space. Texts are therefore cut at such spaces, the pieces are numbered,
    each distinct one is split by the tokenizer's own pattern and encoded by its model, and the ids are laid
    out by number. Texts where the cut is unsafe (white space before a space, or the text of an added
    token) go to the library whole. Pieces that come often are kept for the next slice, up to ``kept``.
    """

    def __init__(self, path: str, end_id: int = 0, slice_chars: int = SLICE, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self.slice_chars, self.kept = slice_chars, kept
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        split = self.tokenizer.pre_tokenizer
        state = json.loads(split.__getstate__()) if split is not None else {}
        self.cut = state.get("type") == "ByteLevel" and state.get("use_regex", True) and not state.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.width = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.width).tobytes()
        self.unsafe = re.compile(r"\s ")
        self.splitter = regex.compile(SPLIT)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space, self.kind = self.letters[32], "H" if self.width == "<u2" else "I"
        self.known: dict[str, bytes] = {}
        self.marks = {m: self._packed([m]) for m in ".,;:!?"}

    def _packed(self, parts: list[str]) -> bytes:
        """Ids of parts of the split, in the tokenizer's letters."""
        return array(self.kind, [t.id for part in parts for t in self.model.tokenize(part)]).tobytes()

    def piece(self, p: str) -> bytes:
        """Ids of a space and the piece after it, from what is known where it can."""
        got = self.known.get(p)
        if got is None:
            if p.isalpha() and p.isascii():  # letters are one part of the split
                got = array(self.kind, [t.id for t in self.model.tokenize(self.space + p)]).tobytes()
            elif p.isalpha() and max(p) < LATIN:
                got = self._packed([(" " + p).encode().decode("latin-1").translate(self.letters)])
            elif p[-1:] in self.marks and p[:-1].isalpha() and max(p) < LATIN:  # and so is a mark after them
                got = self.piece(p[:-1]) + self.marks[p[-1]]
            else:
                got = self._packed([part.encode().decode("latin-1").translate(self.letters) for part in self.splitter.findall(" " + p)])
            self.known[p] = got
        return got

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        """Ids of one text with the end id, as bytes of the payload's width."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as bytes of the payload's width; a slice of texts at a time."""
        out, held, lo = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= self.slice_chars:
                out += self._slice(texts[lo : i + 1])
                lo, held = i + 1, 0
        return out + self._slice(texts[lo:])

    def _slice(self, texts: list[str | None]) -> list[bytes]:
        out, cut = [], []
        for i, t in enumerate(texts):
            if not t:
                out.append(self.end)
            elif not self.cut or self.unsafe.search(t) or any(x in t for x in self.added):
                out.append(np.array(self.whole(t), self.width).tobytes() + self.end)
            else:
                out.append(b"")
                cut.append(i)
        if not cut:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in cut], pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        offsets, code = lists.offsets.to_numpy(), numbered.indices.to_numpy().astype(np.int64)
        pieces = numbered.dictionary.to_pylist()
        del lists
        ids = list(map(self.piece, pieces))
        if len(self.known) > self.kept:
            often = np.argsort(-np.bincount(code, minlength=len(pieces)), kind="stable")[: self.kept // 2].tolist()
            self.known = {pieces[i]: ids[i] for i in often if len(pieces[i]) <= 64}
        # A text's first piece has no space before it; the end id follows its last one.
        code[offsets[:-1]] = np.arange(len(cut)) + len(ids)
        ids += [array(self.kind, self.whole(texts[i].split(" ", 1)[0])).tobytes() for i in cut]
        code = np.insert(code, offsets[1:], len(ids))
        ids.append(self.end)
        size = np.dtype(self.width).itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        flat = np.frombuffer(b"".join(ids), self.width)
        n = sizes[code]
        ends = np.cumsum(n)
        wide = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
        laid = flat[np.repeat(((np.cumsum(sizes) - sizes)[code] - (ends - n)).astype(wide), n) + np.arange(ends[-1], dtype=wide)]
        stops = ends[offsets[1:] + np.arange(len(cut))].tolist()
        for i, a, b in zip(cut, [0, *stops], stops):
            out[i] = laid[a:b].tobytes()
        return out


@lru_cache(maxsize=1)
def encoder_for(path: str, end_id: int, slice_chars: int = SLICE, kept: int = KEPT_PIECES) -> Encoder:
    """The encoder of this worker process, which tasks share one after another."""
    return Encoder(path, end_id, slice_chars, kept)


KEPT["tokens"] = encoder_for.cache_clear


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key_hash(ids: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    k = _mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return _mix(k ^ _mix(ordinals.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


class PerfectHash:
    """Minimal perfect hash over 64-bit key hashes: keys alone in their cell settle, the rest go a level down."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.ranks.append(ones[:-1] + base)
            base += int(ones[-1])
        self.n = base

    @staticmethod
    def _cell(h: np.ndarray, level: int, words: int) -> np.ndarray:
        return _mix(h + np.uint64(level * 0xD1342543DE82EF95 & MASK)) % np.uint64(words * 64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(h)
        if len(left) != len(h):
            raise ValueError("keys must differ")
        while len(left):
            words = max(1, -(-2 * len(left) // 64))
            cell = cls._cell(left, len(levels), words)
            alone = np.bincount(cell.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            left = left[~alone[cell.astype(np.int64)]]
        return cls(levels)

    def slot(self, h: np.ndarray) -> np.ndarray:
        """Slots of the keys; of a key that was not built in, any slot or -1."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            cell = self._cell(h[todo], level, len(bits))
            word, bit = (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.ranks[level][word] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        return out

    def tobytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(x)) + x.tobytes() for x in self.levels)

    @classmethod
    def frombytes(cls, data: bytes) -> PerfectHash:
        (count,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(count):
            (words,) = struct.unpack_from("<I", data, at)
            levels.append(np.frombuffer(data, "<u8", words, at + 4))
            at += 4 + 8 * words
        return cls(levels)


def pack_block(part: int, seq: int, ids: list[int | None], ordinals: list[int], payloads: list[bytes], width: str) -> bytes:
    nulls = np.array([x is None for x in ids], np.uint8)
    keys, ords = np.array([x or 0 for x in ids], "<i8"), np.array(ordinals, "<u4")
    size = np.dtype(width).itemsize
    counts = np.array([len(x) // size for x in payloads], "<u8")
    offsets = np.cumsum(counts, dtype="<u8") - counts
    h = _key_hash(keys, nulls, ords)
    index = PerfectHash.build(h)
    slot = index.slot(h)
    prints, at, n = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u8"), np.zeros(len(h), "<u8")
    prints[slot], at[slot], n[slot] = (h >> np.uint64(32)).astype("<u4"), offsets, counts
    levels = index.tobytes()
    body = b"".join([keys.tobytes(), nulls.tobytes(), ords.tobytes(), levels, prints.tobytes(), at.tobytes(), n.tobytes(), *payloads])
    return HEADER.pack(MAGIC, size, part, seq, len(levels), len(ids), int(counts.sum()), len(body)) + body


class Block:
    """One block read back: its keys in order, and keyed access to its ids."""

    def __init__(self, data: memoryview):
        magic, size, self.part, self.seq, levels, n, self.n_ids, body = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.length, at = HEADER.size + body, HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.nulls, self.ordinals = take("<i8", n), take("u1", n), take("<u4", n)
        self.index = PerfectHash.frombytes(take("u1", levels).tobytes())
        self.prints, self.at, self.counts = take("<u4", n), take("<u8", n), take("<u8", n)
        self.ids = take(f"<u{size}", self.n_ids)

    def find(self, keys: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and count of each key's ids; offset -1 where the block lacks the key."""
        h = _key_hash(keys, nulls, ordinals)
        slot = self.index.slot(h)
        at, n = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == (h[found] >> np.uint64(32)).astype(np.uint32)
        at[found], n[found] = self.at[slot[found]], self.counts[slot[found]]
        return at, n

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """Ids of one document, or None."""
        at, n = self.find(np.array([doc_id or 0], np.int64), np.array([doc_id is None], np.uint8), np.array([ordinal], np.uint32))
        return None if at[0] < 0 else self.ids[at[0] : at[0] + n[0]]


def blocks(content: bytes) -> Iterator[Block]:
    view, at = memoryview(content), 0
    while at < len(view):
        block = Block(view[at:])
        yield block
        at += block.length + 1


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, slice_chars: int = SLICE, kept: int = KEPT_PIECES) -> None:
    """Encode every whole text and write blocks under ``path`` in ascending order of document id.

    Each document's ids are followed by ``end_id``; a null text counts as empty. Null ids come first; rows
    of one id stand together, told apart by an ordinal and ordered by a hash of the text. Other columns
    are ignored. An empty table leaves no blocks.
    """
    wanted = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    rows = wanted.withColumn("h", F.xxhash64("t")).repartitionByRange(text_partitions(wanted, "t"), "k", "h").sortWithinPartitions("k", "h", "t")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokens")
        encoder = encoder_for(tokenizer or default_tokenizer(), end_id, slice_chars, kept)
        size, part, seq = len(encoder.end), TaskContext.get().partitionId(), 0
        ids: list = []
        ords: list[int] = []
        out: list[bytes] = []
        held, last = 0, (object(), 0)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_block(part, seq, ids, ords, out, encoder.width)], pa.binary())], ["block"])

        for batch in batches:
            few = (batch.slice(lo, TAKEN) for lo in range(0, batch.num_rows, TAKEN))
            for k, got in chain.from_iterable(zip(b.column(0).to_pylist(), encoder.encode_many(b.column(1).to_pylist())) for b in few):
                last = (k, last[1] + 1 if k == last[0] else 0)
                ids.append(k)
                ords.append(last[1])
                out.append(got)
                held += len(got) // size
                if held >= block_ids:
                    yield close()
                    ids, ords, out, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()

    written = rows.select("k", "t").mapInArrow(encode, T.StructType([T.StructField("block", T.BinaryType())]))
    written.select(F.col("block").cast("string")).write.text(path)


READ = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "ordinal", "part", "seq", "at", "n_tokens", "ids_crc32", "h", "byte")])


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the blocks under ``path``, each fetched through its block's hash index.

    ``at`` counts ids in the block, ``byte`` is where the document's ids begin in its file. A fetch that the
    index does not confirm fails the job.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("token blocks")
        for batch in batches:
            for content in batch.column(0):
                begin = 0
                for block in blocks(content.as_py()):
                    at, n = block.find(block.keys, block.nulls, block.ordinals)
                    if (at < 0).any():
                        raise ValueError("the index lacks a key of its own block")
                    crc = [zlib.crc32(block.ids[a : a + m].astype("<u4")) for a, m in zip(at.tolist(), n.tolist())]
                    size = block.ids.itemsize
                    byte = begin + block.length - size * block.n_ids + size * at
                    h = _key_hash(block.keys, block.nulls, block.ordinals).view(np.int64)
                    fixed = [np.full(len(at), x, np.int64) for x in (block.part, block.seq)]
                    yield pa.RecordBatch.from_arrays([pa.array(block.keys, mask=block.nulls.astype(bool)), pa.array(block.ordinals.astype(np.int64)), *map(pa.array, fixed), pa.array(at), pa.array(n), pa.array(crc, pa.int64()), pa.array(h), pa.array(byte)], READ.names)
                    begin += block.length + 1

    files = spark.read.format("binaryFile").load(path).select("content")
    return materialize(files.mapInArrow(digest, READ), "token-digests")


def _with_start(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32; ``start`` counts the ids of all documents before."""
    totals = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition written: one for each 64 MB of text.
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    of_block = totals.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("b"))
    base = of_block.join(of_part, "part").select("part", "seq", (F.col("p") + F.col("b")).alias("base"))
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the blocks under ``path``: doc_id, start, n_tokens and ids_crc32."""
    return _with_start(_read_back(spark, path))


# ---- keys to places, over all files ------------------------------------------------------------------

INDEX_MAGIC = b"PSINDEX1"
INDEX_HEADER = struct.Struct("<8sIIIQQ")


def pack_index(width: int, h: np.ndarray, keys: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray, part: np.ndarray, byte: np.ndarray, n: np.ndarray) -> bytes:
    """A shard of the key index: perfect hash, then fingerprint, file, place and count by slot.

    Keys whose 64-bit hashes collide stand apart, with the keys themselves.
    """
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    twin = h[order][1:] == h[order][:-1]
    same[order[1:][twin]] = same[order[:-1][twin]] = True
    kept = np.flatnonzero(~same)
    index = PerfectHash.build(h[kept])
    slot = index.slot(h[kept])
    columns = [np.zeros(len(kept), kind) for kind in ("<u4", "<u4", "<u8", "<u8")]
    for c, v in zip(columns, ((h >> np.uint64(32)), part, byte, n)):
        c[slot] = v[kept]
    odd = np.flatnonzero(same)
    extra = [keys[odd].astype("<i8"), nulls[odd].astype("u1"), ordinals[odd].astype("<u4"), part[odd].astype("<u4"), byte[odd].astype("<u8"), n[odd].astype("<u8")]
    levels = index.tobytes()
    return INDEX_HEADER.pack(INDEX_MAGIC, width, len(levels), 0, len(kept), len(odd)) + levels + b"".join(c.tobytes() for c in [*columns, *extra])


def find_in_index(data: bytes, doc_id: int | None, ordinal: int = 0) -> tuple[int, int, int, int] | None:
    """(id width, file, byte, count) of a key in an index shard, or None."""
    magic, width, levels, _, n, odd = INDEX_HEADER.unpack_from(data)
    if magic != INDEX_MAGIC:
        raise ValueError("not a key index")
    at, got = INDEX_HEADER.size + levels, []
    for kind, count in (("<u4", n), ("<u4", n), ("<u8", n), ("<u8", n), ("<i8", odd), ("u1", odd), ("<u4", odd), ("<u4", odd), ("<u8", odd), ("<u8", odd)):
        got.append(np.frombuffer(data, kind, count, at))
        at += got[-1].nbytes
    twin = np.flatnonzero((got[4] == (doc_id or 0)) & (got[5] == (doc_id is None)) & (got[6] == ordinal))
    if len(twin):
        return (width, *(int(c[twin[0]]) for c in got[7:]))
    h = _one_hash(doc_id, ordinal)
    slot = int(PerfectHash.frombytes(data[INDEX_HEADER.size : INDEX_HEADER.size + levels]).slot(h)[0]) if n else -1
    if slot < 0 or got[0][slot] != int(h[0]) >> 32:
        return None
    return (width, *(int(c[slot]) for c in got[1:4]))


def _one_hash(doc_id: int | None, ordinal: int) -> np.ndarray:
    return _key_hash(np.array([doc_id or 0], np.int64), np.array([doc_id is None], np.uint8), np.array([ordinal], np.uint32))


def _write_index(rows: DataFrame, path: str, width: int, index_docs: int) -> None:
    spark = rows.sparkSession
    shards = max(1, -(-rows.count() // index_docs))
    dealt = rows.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "doc_id", "ordinal", "part", "byte", "n_tokens")

    def build(table: pa.Table) -> pa.Table:
        only("token blocks")
        h, ordinal, part, byte, n = (table[c].to_numpy() for c in ("h", "ordinal", "part", "byte", "n_tokens"))
        ids = table["doc_id"].combine_chunks()
        data = pack_index(width, h.view(np.uint64), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), ordinal, part, byte, n)
        return pa.table([table["shard"].slice(0, 1).combine_chunks(), pa.array([data], pa.binary())], ["shard", "data"])

    built = dealt.groupBy("shard").applyInArrow(build, "shard long, data binary")
    built.select(F.lit(shards).alias("of"), "shard", F.col("data").cast("string").alias("value")).write.partitionBy("of", "shard").text(f"{path}-index")


def _listed(spark: SparkSession, path: str) -> list:
    """Names and paths of what a folder of any store holds; empty if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(folder)] if fs.exists(folder) else []


def _bytes_of(spark: SparkSession, path: str, at: int = 0, n: int | None = None) -> bytes:
    """A range of a file of any store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(at)
        read = jvm.org.apache.commons.io.IOUtils.toByteArray
        return bytes(read(stream) if n is None else read(stream, n))
    finally:
        stream.close()


def lookup(spark: SparkSession, path: str, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
    """Ids of one document of the blocks under ``path``, end id included, or None.

    One shard of the key index and the document's own ids are read, whatever the corpus holds. An absent
    key passes the stored fingerprint once in 2 ** 32.
    """
    of = next((name for name, _ in _listed(spark, f"{path}-index") if name.startswith("of=")), None)
    if of is None:
        return None
    shard = int(_one_hash(doc_id, ordinal).view(np.int64)[0]) % int(of[3:])
    file = next((p for name, p in _listed(spark, f"{path}-index/{of}/shard={shard}") if name.startswith("part-")), None)
    place = find_in_index(_bytes_of(spark, file), doc_id, ordinal) if file else None
    if place is None:
        return None
    width, part, byte, n = place
    payload = next(p for name, p in _listed(spark, path) if name.startswith(f"part-{part:05d}-"))
    return np.frombuffer(_bytes_of(spark, payload, byte, n * width), f"<u{width}")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, path: str | None = None, index_docs: int = INDEX_DOCS, slice_chars: int = SLICE, kept: int = KEPT_PIECES) -> DataFrame:
    """Write the token blocks of ``docs`` (to the shared folder if no path is given) and digest what they hold.

    The key index over all files goes beside them, to ``path`` with ``-index``; ``lookup`` reads both.
    ``slice_chars`` and ``kept`` weigh a worker's memory against its time; the ids don't depend on them.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-blocks")
    write_token_ids(docs, path, tokenizer, end_id, slice_chars=slice_chars, kept=kept)
    rows = _read_back(spark, path)
    encoder = encoder_for(tokenizer or default_tokenizer(), end_id)
    _write_index(rows, path, int(encoder.width[2:]), index_docs)
    return _with_start(rows)
