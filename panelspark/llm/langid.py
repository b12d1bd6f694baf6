"""Language identification with a linear-chain conditional random field over words.

A word's emission sums weights of its hashed character n-grams (of two to four bytes, with the word's
borders, so affixes are n-grams too) and of the word itself. Learned transitions tie neighbouring words;
forward-backward gives each word a posterior, also in text that switches language, and a document takes
the language with the largest share of its letters.

Everything runs on arrays: texts of a batch are one byte buffer, chains are cut into blocks whose
transfer matrices are multiplied for all blocks at once, then joined, then expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import only

#: Labelled documents that training may use in all, and characters that one of them may have.
SAMPLE_DOCS, SAMPLE_CHARS = 900, 3000
#: Documents of a language that training uses, if it has so many, however many languages there are.
SAMPLE_LEAST = 8
#: Hash buckets of features, words of a block, letters handled at a time.
DIMENSIONS, BLOCK, SLICE = 1 << 18, 32, 1 << 19
PASSES, RATE = 8, 0.5
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (DIMENSIONS, languages)
    transitions: np.ndarray  # log, (languages, languages)


@dataclass
class Words:
    """Words of some texts: feature numbers of each byte place, and where each word and text begins."""

    places: np.ndarray  # (n, 3) feature numbers, for letters and the border before each word
    first: np.ndarray  # place where each word begins in ``places``
    word: np.ndarray  # feature number of the whole word
    letters: np.ndarray
    text: np.ndarray  # text of each word


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n + 1, ODD, np.uint64), np.full(n + 1, INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def _bucket(code: np.ndarray, salt: int) -> np.ndarray:
    x = (code.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(ODD)
    return (x >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int32)


def words_of(texts: list[str]) -> Words:
    """Runs of ASCII letters and of bytes of other characters, lower-cased."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"    " + b" ".join(raw) + b" ", np.uint8)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    # Signs that are no letters: U+0080 to U+00BF, U+2000 to U+207F and U+3000 to U+303F.
    lead, low = data[:-2], data[1:-1]
    for width, signs in ((2, lead == 0xC2), (3, ((lead == 0xE2) & ((low == 0x80) | (low == 0x81))) | ((lead == 0xE3) & (low == 0x80)))):
        at = np.flatnonzero(signs)
        for i in range(width):
            letter[at + i] = False
    s = np.where(letter, data, np.uint8(32)).astype(np.uint64)
    edge = np.diff(letter.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros((0, 3), np.int32), empty, empty, empty, empty)
    two = s[1:] | s[:-1] << np.uint64(8)
    three, four = two[1:] | s[:-2] << np.uint64(16), two[2:] | s[1:-2] << np.uint64(16) | s[:-3] << np.uint64(24)
    # Grams end at each letter and at the border after a word.
    sizes = end - begin + 1
    first = np.cumsum(sizes) - sizes
    at = np.repeat(begin - first, sizes) + np.arange(sizes.sum())
    places = np.stack([_bucket(two[at - 1], 1), _bucket(three[at - 2], 2), _bucket(four[at - 3], 3)], axis=1)
    p, q = _powers(len(s))
    total = np.concatenate([[np.uint64(0)], np.cumsum(s * p[: len(s)])])
    word = _bucket((total[end] - total[begin]) * q[begin], 4)
    bounds = 4 + np.cumsum([0, *[len(r) + 1 for r in raw]])
    return Words(places, first, word, end - begin, np.searchsorted(bounds, begin, side="right") - 1)


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """(words, languages) scores: mean n-gram weight times the root of the length, plus the word's weight."""
    if not len(w.first):
        return np.zeros((0, weights.shape[1]))
    grams = weights[w.places[:, 0]] + weights[w.places[:, 1]] + weights[w.places[:, 2]]
    return (np.add.reduceat(grams, w.first, axis=0) / np.sqrt(w.letters + 1)[:, None] + weights[w.word]).astype(np.float64)


def forward_backward(e: np.ndarray, lengths: np.ndarray, log_t: np.ndarray) -> np.ndarray:
    """Posteriors of every step of chains that lie end to end in ``e``; lengths are positive.

    Blocks of every chain are filled up with steps that change nothing.
    """
    n, k = e.shape
    t = np.exp(log_t)
    blocks = -(-lengths // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    starts = np.cumsum(lengths) - lengths
    chain = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(n) - starts[chain]
    row, col = first_block[chain] + step // BLOCK, step % BLOCK
    nb = int(blocks.sum())
    x = np.ones((BLOCK, nb, k))
    x[col, row] = np.exp(e - e.max(axis=1, keepdims=True))
    real = np.zeros((BLOCK, nb), bool)
    real[col, row] = True

    def norm(a: np.ndarray) -> np.ndarray:
        return a / a.sum(axis=tuple(range(1, a.ndim)), keepdims=True)

    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for j in range(BLOCK):
        on = real[j]
        m[on] = norm((m[on] @ t) * x[j][on][:, None, :])
    # Chains' blocks one after another, all chains side by side.
    enter, leave = np.zeros((nb, k)), np.ones((nb, k))
    a = np.full((len(lengths), k), 1.0 / k)
    order = np.argsort(-blocks, kind="stable")
    deepest = int(blocks.max(initial=0))
    alive = np.searchsorted(-blocks[order], -np.arange(deepest), side="left")
    for b in range(deepest):
        who = order[: alive[b]]
        at = first_block[who] + b
        enter[at] = a[who]
        a[who] = norm(np.einsum("ni,nij->nj", a[who], m[at]))
    z = np.full((len(lengths), k), 1.0 / k)
    for b in range(deepest - 1, -1, -1):
        who = order[: alive[b]]
        at = first_block[who] + b
        leave[at] = z[who]
        z[who] = norm(np.einsum("nij,nj->ni", m[at], z[who]))
    forward = np.empty((BLOCK, nb, k))
    f = enter
    for j in range(BLOCK):
        f = np.where(real[j][:, None], norm((f @ t) * x[j]), f)
        forward[j] = f
    out = np.empty((BLOCK, nb, k))
    g = leave
    for j in range(BLOCK - 1, -1, -1):
        out[j] = norm(forward[j] * g)
        g = np.where(real[j][:, None], norm((x[j] * g) @ t.T), g)
    return out[col, row]


def train(sample: list[tuple[str, str]], passes: int = PASSES, seed: int = 5) -> Model:
    """Fit to (language, text) pairs: count-based start, then likelihood steps on spliced chains.

    Chains are made by joining runs of words of different texts, so that switches occur and the
    transitions can be learned beside the emissions.
    """
    languages = sorted({lang for lang, _ in sample})
    k, rng = len(languages), np.random.default_rng(seed)
    w = words_of([t for _, t in sample])
    gold_text = np.array([languages.index(lang) for lang, _ in sample], np.int64)
    if k == 0:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros((0, 0)))
    if k == 1 or not len(w.first):
        return Model(languages, np.zeros((DIMENSIONS, k), np.float32), np.zeros((k, k)))
    gold = gold_text[w.text]
    place_gold = np.repeat(gold, np.diff(np.append(w.first, len(w.places))))
    counts = np.stack([sum(np.bincount(w.places[place_gold == c, i], minlength=DIMENSIONS) for i in range(3)) + np.bincount(w.word[gold == c], minlength=DIMENSIONS) for c in range(k)], axis=1) + 0.5
    weights = np.log(counts / counts.sum(axis=0)) - np.log(counts.sum(axis=1, keepdims=True) / counts.sum()) + 0.0
    weights[counts.sum(axis=1) <= 0.5 * k] = 0.0
    weights *= 0.3
    # Runs of 8 to 64 words of one text, in random order, are the chains' pieces.
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(w.text) != 0) | (rng.random(len(gold) - 1) < 1 / 30)]))
    sizes = np.diff(np.append(cut, len(gold)))
    shuffled = rng.permutation(len(cut))
    order = np.concatenate([np.arange(cut[i], cut[i] + sizes[i]) for i in shuffled])
    y = gold[order]
    lengths = np.full(-(-len(order) // 256), 256)
    lengths[-1] = len(order) - 256 * (len(lengths) - 1)
    inside = np.ones(len(order), bool)
    inside[np.cumsum(lengths) - lengths] = False
    seen = np.zeros((k, k)) + 0.5
    np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
    log_t = np.log(seen / seen.sum(axis=1, keepdims=True))
    step_t = np.full((k, k), 1e-6)
    scale = (1 / np.sqrt(w.letters + 1))[:, None]
    widths = np.diff(np.append(w.first, len(w.places)))
    cells = np.full((DIMENSIONS, k), 1e-4)
    back = np.argsort(order)
    for _ in range(passes):
        e = emissions(w, weights)[order]
        post = forward_backward(e, lengths, log_t)
        d = -post
        d[np.arange(len(y)), y] += 1
        # Expected label pairs from the posteriors of neighbours.
        both = post[:-1][:, :, None] * np.exp(log_t)[None] * (np.exp(e[1:] - e[1:].max(axis=1, keepdims=True)))[:, None, :]
        both *= (post[1:] / np.maximum(both.sum(axis=1), 1e-300))[:, None, :]
        grad_t = seen - 0.5 - both[inside[1:]].sum(axis=0)
        step_t += (grad_t / len(y)) ** 2
        log_t = log_t + 0.1 * RATE * (grad_t / len(y)) / np.sqrt(step_t)
        dw = d[back]
        grams = np.repeat((dw * scale).astype(np.float32), widths, axis=0)
        grad = np.stack([sum(np.bincount(w.places[:, i], weights=grams[:, c], minlength=DIMENSIONS) for i in range(3)) + np.bincount(w.word, weights=dw[:, c], minlength=DIMENSIONS) for c in range(k)], axis=1)
        cells += grad * grad
        weights = weights + 0.1 * RATE * grad / np.sqrt(cells)
    return Model(languages, weights.astype(np.float32), log_t)


def classify(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, share of letters) of each text; ('und', 0.0) for texts without a letter."""
    out = [("und", 0.0)] * len(texts)
    if not model.languages:
        return out
    lo, limit = 0, SLICE * 16 // max(16, len(model.languages) ** 2)
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < limit):
            size += len(texts[hi] or "")
            hi += 1
        some = [t or "" for t in texts[lo:hi]]
        w = words_of(some)
        if len(w.first):
            which, lengths = np.unique(w.text, return_counts=True)
            post = forward_backward(emissions(w, model.weights), lengths, model.transitions)
            mass = np.zeros((len(some), len(model.languages)))
            np.add.at(mass, w.text, post * w.letters[:, None])
            for i in which:
                best = int(mass[i].argmax())
                if some[i].isascii() or any(map(str.isalpha, some[i])):
                    out[lo + i] = (model.languages[best], float(min(1.0, mass[i, best] / mass[i].sum())))
        lo = hi
    return out


def training_sample(docs: DataFrame, docs_in_all: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, least: int = SAMPLE_LEAST) -> list[tuple[str, str]]:
    """About ``docs_in_all`` labelled texts, evenly by language, and of each language about ``least`` at least.

    ``docs`` has lang and text. Every label that stands at a text with a letter is learned, whatever its
    rank. A text is taken if a hash of it falls under its language's share, so the sample does not depend on
    the order or the number of rows; of a text longer than ``chars`` a piece of that length is learned from.
    """
    lettered = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    fit = lettered.select("lang", "text", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)).alias("h"))
    shares = fit.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first"))
    languages = shares.count()
    each = max(least, docs_in_all / max(1, languages))
    # The least hash of a language is in any case below its bound, so no language is without a text.
    bounds = shares.select("lang", F.greatest(F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * (1 << 30), F.col("first") + 1).alias("bound"))
    # One row a label, as in the model itself, which the driver holds whole; only texts taken leave their partition.
    taken = fit.join(F.broadcast(bounds), "lang").where("h < bound").groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    return sorted((r.lang, r.text) for r in taken.select("lang", "text").collect())


def held_out(doc_id: str = "doc_id"):
    """Documents that training must not see: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; needs a text column, keeps all others.

    Columns of those names are replaced. A null text, or one without a letter, is ``und`` with score 0.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language")
        for batch in batches:
            found = classify(batch.column(at).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def language_of(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred and score.

    The field is trained on labelled documents that are not held out, from their text and lang alone.
    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or has no letter, or
    where no labelled document is there to learn from. Repeated rows get equal answers; a null id is
    not held out; an empty table gives no rows; other columns are ignored.
    """
    known = docs.where(~held_out()).select("lang", "text")
    model = train(training_sample(known))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
