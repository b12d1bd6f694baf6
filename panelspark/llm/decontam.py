"""Benchmark decontamination as a prefix-filtered set join with exact verification.

A benchmark window is a set of shingles (pairs of neighbouring words; the word itself where a window has
one). Containment must be complete, so the necessary prefix of a window, its shingles ordered from rare to
common over the whole corpus, is its rarest shingle alone. Documents are joined to windows on that shingle;
its offset in the window and the lengths bound where the window can lie, and there the words are compared.

The benchmark is taken in blocks of bounded size. One block, the usual case, is one counting pass and one
matching pass over the documents; further blocks add passes, and what a document gathers is carried along.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import materialize, only

#: Text bytes of the benchmark that one block holds, and so what is sent to every worker at a time.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters, and blanks the rest.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], window: int, least: int = 1) -> Iterator[tuple[bytes, ...]]:
    if len(words) >= max(window, least):
        yield from zip(*(words[i:] for i in range(window)))
    elif len(words) >= max(1, least):
        yield tuple(words)


def shingles(window: tuple[bytes, ...]) -> list:
    return list(zip(window, window[1:])) if len(window) > 1 else list(window)


def _frequencies(docs: DataFrame, vocabulary: dict) -> Counter:
    """Documents that hold each shingle of the vocabulary; counted in the partitions, then summed."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontamination")
        known, found = sent.value, Counter()
        single = any(isinstance(x, bytes) for x in known)
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                held = set(filter(known.__contains__, zip(words, words[1:])))
                if single:
                    held.update(filter(known.__contains__, words))
                found.update(held)
        yield pa.RecordBatch.from_arrays([pa.array([known[x] for x in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["s", "n"])

    rows = docs.select("b").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    numbers = {i: x for x, i in vocabulary.items()}
    out = Counter({numbers[r.s]: r.n for r in rows.collect()})  # at most the block's shingles
    sent.destroy()
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def prefix_indexes(docs: DataFrame, benchmark: DataFrame, window: int, least: int, text: str, block_bytes: int) -> Iterator[dict]:
    """For each block of the benchmark: rarest shingle -> (its offset, window, items) of the windows it stands for."""
    n_blocks = blocks_of(benchmark, block_bytes)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("b")).where("b is not null")
    # A text travels once; the ids of its copies are dealt over the blocks as texts of their own.
    alike = items.distinct().withColumn("copy", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    listed = alike.groupBy("b", "copy").agg(F.collect_list("item").alias("items"))
    place = F.pmod(F.xxhash64("b", "copy"), F.lit(n_blocks))
    for at in range(n_blocks):
        owners: dict[tuple, set] = defaultdict(set)
        for row in listed.where(place == at).toLocalIterator():  # one block of about block_bytes
            for w in windows_of(words_of(bytes(row.b)), window, least):
                owners[w].update([*row["items"], None])
        vocabulary = {x: i for i, x in enumerate(dict.fromkeys(s for w in owners for s in shingles(w)))}
        common = _frequencies(docs.select(F.col(text).cast("binary").alias("b")), vocabulary) if vocabulary else Counter()
        prefix: dict = defaultdict(list)
        for w, who in owners.items():
            offset = min((common[s], vocabulary[s], i) for i, s in enumerate(shingles(w)))[2]
            prefix[shingles(w)[offset]].append((offset, w, sorted(x for x in who if x is not None)))
        yield dict(prefix)


def has_words(index: dict) -> bool:
    """Whether some window of the index has one word, and so a shingle that is a word."""
    return any(isinstance(x, bytes) for x in index)


def occurrences(words: list[bytes], index: dict, single: bool) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, items) of windows in a document: its shingles probe the index, words decide."""
    n = len(words)
    at = [(i, p) for i, p in enumerate(zip(words, words[1:])) if p in index]
    if single:
        at += [(i, w) for i, w in enumerate(words) if w in index]
    for i, shingle in at:
        for offset, w, who in index[shingle]:
            start = i - offset
            if 0 <= start <= n - len(w) and tuple(words[start : start + len(w)]) == w:
                yield start, start + len(w), who


STATE = T.StructType([T.StructField("k", T.LongType()), T.StructField("b", T.BinaryType()), T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType()))])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: int = 1, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    ``docs`` is read once to count and once to match, for each block of the benchmark. A document word is
    hit if some window of an item covers it where the document has all the window's words in order.
    Items of fewer than ``window`` words are one window; those of fewer than ``least`` are passed over.

    A null text has no words. Repeated documents each get their row; a null document id stays null.
    Repeated item ids count once; an item without an id hits words but is not listed. Without items, or
    without documents, no row is contaminated and no row comes, respectively. Other columns are ignored.
    """
    state = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("binary").alias("b"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    n_blocks = blocks_of(benchmark, block_bytes)
    for at, prefix in enumerate(prefix_indexes(docs, benchmark, window, least, text, block_bytes)):
        state = _match(state, prefix, last=at == n_blocks - 1)
        if at % 4 == 3 and at < n_blocks - 1:
            state = materialize(state, "decontamination")
    return state


def _match(state: DataFrame, prefix: dict, last: bool) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(prefix)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontamination")
        index, single = sent.value, has_words(sent.value)
        for batch in batches:
            rows = []
            for k, b, hit, items in zip(*(batch.column(i) for i in range(4))):
                b, hit, found = b.as_py(), hit.as_py(), set(items.as_py() or ())
                words = words_of(b)
                n, cover = len(words), bytearray(hit or b"")
                for start, end, who in occurrences(words, index, single):
                    cover = cover or bytearray(n)
                    cover[start:end] = b"\x01" * (end - start)
                    found.update(who)
                rows.append((k.as_py(), n, bytes(cover), sorted(found), b))
            if not rows:
                continue
            k, n, cover, found, b = zip(*rows)
            if last:
                hits = [c.count(1) for c in cover]
                digests = [hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits]), pa.array(found, pa.list_(pa.string()))], RESULT.names)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(b, pa.binary()), pa.array(cover, pa.binary()), pa.array(found, pa.list_(pa.string()))], STATE.names)

    return state.mapInArrow(match, RESULT if last else STATE)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, least: int = 1, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` less the rows whose text holds a window of the benchmark; all columns stay.

    Windows are found as in ``contamination``; items of fewer than ``least`` words are passed over. A null
    text holds none and stays, as do repeated rows and rows without an id; without items all rows stay.
    """
    out = docs
    for prefix in prefix_indexes(docs, benchmark, window, least, text, block_bytes):
        out = out.where(~_holder(docs.sparkSession.sparkContext.broadcast(prefix))(F.col(text).cast("binary")))
    return out


def _holder(sent):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        only("decontamination")
        index, single = sent.value, has_words(sent.value)
        return texts.map(lambda b: next(occurrences(words_of(b), index, single), None) is not None)

    return holds
