"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole segments of tokens (shape, groups, digits, check digit, words around) for every type
at once, and its dynamic program chooses boundaries and types jointly over segments of bounded length.
A segment of a type must begin and end with a token that bears a digit, an at-sign or a spelled-out one,
so between such tokens the labelling is forced and the program runs on islands of them, exactly and over
whole islands, however long.

Training data are generated here: address forms that the patterns do not cover (spelled-out at-signs,
phones without a plus, cards and addresses with other separators) among numbers that are nobody's.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import KEPT, only

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = "A-Za-z0-9._%+-"
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each at-sign with the address characters before it; linear however long their runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping per kind, in order of kind and place."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------------

LABELS = ("other", *KINDS)
#: Tokens that a segment may have; features are hashed into this many weights a label.
LONGEST, BUCKETS = 8, 1 << 12
#: Sentences generated for training, passes over them, and the posterior that a reported segment needs.
SENTENCES, PASSES, SURE = 320, 6, 0.95
AT = re.compile(r"[(\[{]?at[)\]}]", re.IGNORECASE)
DOT = re.compile(r"[(\[{]?dot[)\]}]", re.IGNORECASE)
TOKEN = re.compile(r"\S+")
#: A token bears a digit or an at-sign, spelled out or not.
BEARING = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]", re.IGNORECASE)
EDGE = ".,;:!?\"'"
DIGITS, LOWER, UPPER = re.compile(r"[0-9]+"), re.compile(r"[a-z\u0080-\U0010ffff]+"), re.compile(r"[A-Z]+")


def _shape(s: str) -> str:
    s = LOWER.sub("a", UPPER.sub("A", s))
    return DIGITS.sub(lambda m: str(min(len(m.group()), 9)), s)


@lru_cache(maxsize=1 << 14)
def _features(tokens: tuple[str, ...], before: str, after: str) -> tuple[int, ...]:
    """Feature numbers of a whole segment."""
    span = " ".join(tokens).strip(EDGE)
    digits = NOT_DIGIT.sub("", span)
    groups = DIGITS.findall(span)
    seps = "".join(sorted(set(DIGITS.sub("", _shape(span)))))[:8]
    spelled = bool(AT.search(span)) or " at " in span
    parts = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    long = 13 <= len(digits) <= 19
    names = (
        f"shape={_shape(span)[:24]}", f"n={len(tokens)}", f"digits={min(len(digits), 20)}", f"groups={len(groups)}|{len(digits)}", f"sizes={[min(len(g), 6) for g in groups][:6]}",
        f"seps={seps}", f"at={'@' in span}|{spelled}|{bool(DOT.search(span))}|{'.' in span}", f"parts={parts}|{seps}", f"luhn={long and luhn(digits)}|{long}", f"first={_shape(tokens[0])[:8]}",
        f"last={_shape(tokens[-1])[:8]}", f"before={before.lower().strip(EDGE)[:10]}", f"after={after.lower().strip(EDGE)[:10]}", "bias",
    )
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in names)


Island = tuple[list[str], list[str]]


def _segments(tokens: list[str], before: str, after: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    n = len(tokens)
    around = [before, *tokens, after]
    segs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - LONGEST), j)]
    return segs, np.array([_features(tuple(tokens[i:j]), around[i], around[j + 1]) for i, j in segs])


class Field:
    """Weights of segments and of label pairs."""

    def __init__(self):
        self.w = np.zeros((len(LABELS), BUCKETS))
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, segs: list[tuple[int, int]], feats: np.ndarray) -> np.ndarray:
        s = self.w[:, feats].sum(axis=2).T
        s[[j - i > 1 for i, j in segs], 0] = -np.inf
        return s

    def forward(self, n: int, segs: list[tuple[int, int]], s: np.ndarray, pick=None) -> np.ndarray:
        """Log sums (or maxima, with back pointers in ``pick``) of the labellings that end at each place."""
        alpha = np.full((n + 1, len(LABELS)), -np.inf)
        alpha[0, 0] = 0.0
        into = np.full((n + 1, len(LABELS)), -np.inf)
        into[0] = self.t[0]
        by_end: dict[int, list[int]] = {}
        for q, (_, j) in enumerate(segs):
            by_end.setdefault(j, []).append(q)
        for j in range(1, n + 1):
            qs = by_end[j]
            terms = np.stack([into[segs[q][0]] + s[q] for q in qs])
            if pick is None:
                alpha[j] = np.logaddexp.reduce(terms, axis=0)
                into[j] = np.logaddexp.reduce(alpha[j][:, None] + self.t, axis=0)
            else:
                best = terms.argmax(axis=0)
                alpha[j] = terms[best, np.arange(len(LABELS))]
                through = alpha[j][:, None] + self.t
                pick[j] = ([qs[b] for b in best], through.argmax(axis=0))
                into[j] = through.max(axis=0)
        return alpha

    def backward(self, n: int, segs: list[tuple[int, int]], s: np.ndarray) -> np.ndarray:
        """Log sums of what follows a segment of each label that ends at each place."""
        beta = np.full((n + 1, len(LABELS)), -np.inf)
        beta[n] = 0.0
        by_start: dict[int, list[int]] = {}
        for q, (i, _) in enumerate(segs):
            by_start.setdefault(i, []).append(q)
        for i in range(n - 1, -1, -1):
            ahead = np.logaddexp.reduce(np.stack([s[q] + beta[segs[q][1]] for q in by_start[i]]), axis=0)
            beta[i] = np.logaddexp.reduce(self.t + ahead[None, :], axis=1)
        return beta

    def marginals(self, n: int, segs: list[tuple[int, int]], s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of each segment with each label, and expected counts of label pairs."""
        alpha, beta = self.forward(n, segs, s), self.backward(n, segs, s)
        total = np.logaddexp.reduce(alpha[n])
        into = np.stack([self.t[0] if i == 0 else np.logaddexp.reduce(alpha[i][:, None] + self.t, axis=0) for i in range(n)])
        p = np.exp(np.stack([into[i] + s[q] + beta[j] for q, (i, j) in enumerate(segs)]) - total)
        pairs = np.zeros_like(self.t)
        for i in range(n):
            ahead = np.logaddexp.reduce(np.stack([s[q] + beta[j] for q, (a, j) in enumerate(segs) if a == i]), axis=0)
            pairs += np.exp(alpha[i][:, None] + self.t + ahead[None, :] - total)
        return p, pairs

    def best(self, n: int, segs: list[tuple[int, int]], s: np.ndarray) -> list[tuple[int, int]]:
        """(segment, label) of the best labelling."""
        pick: dict[int, tuple] = {}
        alpha = self.forward(n, segs, s, pick)
        out, j, y = [], n, int(alpha[n].argmax())
        while j > 0:
            q = pick[j][0][y]
            out.append((q, y))
            j = segs[q][0]
            y = int(pick[j][1][y]) if j else 0
        return out[::-1]


def _made(rng: random.Random) -> tuple[list[str], int]:
    """Tokens of one generated item and its label."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    pick = rng.randrange(22)
    if pick < 3:
        at, dot = rng.choice(["(at)", "[at]", "{at}"]), rng.choice(["(dot)", "[dot]", "{dot}"])
        name, host, top = word() + rng.choice(["", d(2)]), word(), rng.choice(["com", "org", "net", "de"])
        return rng.choice([f"{name}{at}{host}{dot}{top}", f"{name} {at} {host} {dot} {top}", f"{name} {at} {host}.{top}", f"{name}@{host}{dot}{top}", f"{name} @ {host}.{top}"]).split(), 1
    if pick < 5:
        a = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice(["[.]", "(.)", "[dot]"]).join(a).split(), 2
    if pick < 8:
        a = d(15)
        a += next(x for x in "0123456789" if luhn(a + x))
        return rng.choice([".", "/", "_", "  ", " - "]).join(a[i : i + 4] for i in (0, 4, 8, 12)).split(), 3
    if pick < 12:
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"({d(3)}){d(3)}-{d(4)}"]).split(), 4
    plain = [f"{rng.randint(1900, 2099)}", f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 23)}:{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}.", d(rng.randint(1, 7)), f"#{d(6)}", f"{d(2)}%", f"{d(2)}.{d(4)}, -{d(2)}.{d(4)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", d(16), d(10), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"@{word()}", f"{word()}@{d(2)}", hashlib.sha1(d(9).encode()).hexdigest(), f"AKIA{d(3)}{word().upper()}{d(4)}", f"{d(3)} {d(2)}", f"pp. {d(3)}-{d(3)}", f"{word()}={d(4)}{word()}{d(3)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", f"{d(1)} {d(1)} {d(2)} {d(1)} {d(3)}"]
    return rng.choice(plain).split(), 0


@lru_cache(maxsize=1)
def trained(sentences: int = SENTENCES, passes: int = PASSES, seed: int = 11) -> Field:
    """The field fitted by its likelihood to generated islands of one to three items."""
    rng, field, data = random.Random(seed), Field(), []
    cues = {1: ["mail", "contact", "to"], 2: ["host", "server", "from"], 3: ["card", "visa", "no"], 4: ["call", "phone", "tel"]}
    for _ in range(sentences):
        tokens, gold = [], []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            words, label = _made(rng)
            if rng.random() < 0.3:
                words = [*words[:-1], words[-1] + rng.choice(".,;")]
            spans = [(len(tokens), len(tokens) + len(words), label)] if label else [(len(tokens) + i, len(tokens) + i + 1, 0) for i in range(len(words))]
            gold += spans
            tokens += words
        first = gold[0][2]
        before = rng.choice(cues[first]) if first and rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(5))
        segs, feats = _segments(tokens, before, "".join(rng.choice("aeinorst") for _ in range(5)))
        place = {x: q for q, x in enumerate(segs)}
        data.append((len(tokens), segs, feats, [(place[(i, j)], y) for i, j, y in gold]))
    gw, gt = np.full_like(field.w, 1e-3), np.full_like(field.t, 1e-3)
    for _ in range(passes):
        rng.shuffle(data)
        for n, segs, feats, gold in data:
            p, pairs = field.marginals(n, segs, field.scores(segs, feats))
            y = np.zeros_like(p)
            y[[q for q, _ in gold], [c for _, c in gold]] = 1
            seen, last = np.zeros_like(field.t), 0
            for _, c in gold:
                seen[last, c] += 1
                last = c
            step = y - p
            grad = np.zeros_like(field.w)
            for c in range(len(LABELS)):
                grad[c] = np.bincount(feats.ravel(), weights=np.repeat(step[:, c], feats.shape[1]), minlength=BUCKETS)
            grad -= 1e-4 * field.w
            gw += grad * grad
            field.w += 0.3 * grad / np.sqrt(gw)
            gt += (seen - pairs) ** 2
            field.t += 0.3 * (seen - pairs) / np.sqrt(gt)
    return field


def _token_before(text: str, place: int, least: int) -> re.Match | None:
    """The last token between two places of a text."""
    while place > least and text[place - 1].isspace():
        place -= 1
    start = place
    while start > least and not text[start - 1].isspace():
        start -= 1
    return TOKEN.match(text, start, place) if start < place else None


def _islands(text: str) -> Iterator[tuple[list[re.Match], str, str]]:
    """Runs of tokens that bear digits or at-signs, with as many plain tokens between two as a segment can hold.

    A plain token beside a spelled-out at or dot belongs to the run too.
    """
    at, end = BEARING.search(text), 0
    while at:
        start = at.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        token = TOKEN.match(text, start)
        run = [token]
        if AT.fullmatch(token.group().strip(EDGE)) or token.group() == "@":  # its name stands alone before it
            name = _token_before(text, token.start(), end)
            if name:
                run.insert(0, name)
        while True:
            nxt = TOKEN.search(text, run[-1].end())
            if not nxt:
                break
            if BEARING.search(nxt.group()):
                run.append(nxt)
                continue
            word = run[-1].group().strip(EDGE)
            if AT.fullmatch(word) or DOT.fullmatch(word) or word == "@":
                run.append(nxt)
                continue
            after = TOKEN.search(text, nxt.end())
            if after and (AT.fullmatch(after.group().strip(EDGE)) or DOT.fullmatch(after.group().strip(EDGE)) or after.group() == "@"):
                run.append(nxt)
                continue
            plain, ahead = [nxt], after
            while ahead and not BEARING.search(ahead.group()) and len(plain) < LONGEST - 2:
                plain.append(ahead)
                ahead = TOKEN.search(text, ahead.end())
            if ahead and BEARING.search(ahead.group()):
                run += [*plain, ahead]
                continue
            break
        head = _token_before(text, run[0].start(), 0)
        yield run, head.group() if head else "", nxt.group() if nxt else ""
        end = run[-1].end()
        at = BEARING.search(text, end)


#: Tokens whose segments are scored at a time.
SCORED = 256


def _dense(field: Field, tokens: list[str], before: str, after: str) -> np.ndarray:
    """(token, length, label) scores of the segments that end with each token, of one token first."""
    n, around = len(tokens), [before, *tokens, after]
    out = np.full((n, LONGEST, len(LABELS)), -np.inf)
    for lo in range(0, n, SCORED):
        segs = [(i, j) for j in range(lo + 1, min(n, lo + SCORED) + 1) for i in range(max(0, j - LONGEST), j)]
        feats = np.array([_features(tuple(tokens[i:j]), around[i], around[j + 1]) for i, j in segs])
        ends, sizes = np.array([j - 1 for _, j in segs]), np.array([j - i - 1 for i, j in segs])
        out[ends, sizes] = field.scores(segs, feats)
    return out


def decode(tokens: list[str], before: str, after: str) -> list[tuple[int, int, int]]:
    """(first token, end token, label) of sure segments, by one dynamic program over all the tokens."""
    field, n = trained(), len(tokens)
    s, t, y = _dense(field, tokens, before, after), field.t, np.arange(len(LABELS))
    top, size, prev = np.full((n + 1, len(LABELS)), -np.inf), np.zeros((n + 1, len(LABELS)), np.int64), np.zeros((n + 1, len(LABELS)), np.int64)
    best, alpha, total = np.empty_like(top), np.empty_like(top), np.empty_like(top)
    best[0] = alpha[0] = t[0]
    for j in range(1, n + 1):
        m = min(LONGEST, j)
        terms = best[j - m : j][::-1] + s[j - 1, :m]
        size[j] = terms.argmax(axis=0)
        top[j] = terms[size[j], y]
        through = top[j][:, None] + t
        prev[j], best[j] = through.argmax(axis=0), through.max(axis=0)
    out, j, label = [], n, int(top[n].argmax())
    while j > 0:
        i = j - 1 - int(size[j][label])
        if label:
            out.append((i, j, label))
        label, j = int(prev[i][label]), i
    if not out:
        return []
    for j in range(1, n + 1):
        m = min(LONGEST, j)
        total[j] = np.logaddexp.reduce(alpha[j - m : j][::-1] + s[j - 1, :m], axis=0)
        alpha[j] = np.logaddexp.reduce(total[j][:, None] + t, axis=0)
    beta = np.zeros((n + 1, len(LABELS)))
    for i in range(n - 1, -1, -1):
        k = np.arange(min(LONGEST, n - i))
        ahead = np.logaddexp.reduce(s[i + k, k] + beta[i + 1 + k], axis=0)
        beta[i] = np.logaddexp.reduce(t + ahead[None, :], axis=1)
    z = np.logaddexp.reduce(total[n])
    return [(i, j, c) for i, j, c in reversed(out) if alpha[i][c] + s[j - 1, j - i - 1, c] + beta[j][c] - z >= np.log(SURE)]


@lru_cache(maxsize=1 << 12)
def _decoded(tokens: tuple[str, ...], before: str, after: str) -> list[tuple[int, int, int]]:
    return decode(list(tokens), before, after)


def _forget() -> None:
    _features.cache_clear()
    _decoded.cache_clear()


KEPT["pii"] = _forget


def field_spans(text: str) -> list[Span]:
    out = []
    for run, before, after in _islands(text):
        tokens = tuple(m.group() for m in run)
        if not any(NOT_DIGIT.sub("", t) for t in tokens) and not any("@" in t or AT.search(t) for t in tokens):
            continue
        for i, j, y in (_decoded if sum(map(len, tokens)) < 400 else decode)(tokens, before, after):
            start, end = run[i].start(), run[j - 1].end()
            while start < end and text[start] in EDGE:
                start += 1
            while end > start and text[end - 1] in EDGE:
                end -= 1
            if start < end:
                out.append((KINDS[y - 1], start, end))
    return out


def find_pii(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and what the field adds beside them."""
    if not text or not BEARING.search(text):
        return [], []
    base = base_spans(text)
    extra, at = [], sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in at], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in at], np.int64)) if at else np.zeros(0, np.int64)
    for kind, a, b in field_spans(text):
        i = int(np.searchsorted(starts, b))
        if i == 0 or ends[i - 1] <= a:
            extra.append((kind, a, b))
    return base, sorted({*base, *extra}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Counts and digest are of the base patterns; ``spans`` lists these and the field's. Spans are counted in
    code points, ends exclusive. A null text counts as empty; null or repeated ids stay as they are; an
    empty table gives no rows; other columns are ignored. Every worker fits the field once, alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pii")
        for batch in batches:
            found = [find_pii(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(x) for _, x in found], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
