"""Corpus operators against brute force on small documents with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import common, decontam, langid, linededup, maxscore, mixing, pii, secrets, simhash, substr, tokens
from panelspark.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string, start long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def corpus(seed=0):
    """Rows with shared passages, exact and near copies, repeated ids, nulls, blanks and a long text."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    texts = base + [base[3], base[3] + " tail", f"{base[5]} {passage}", f"{passage} {base[6]}", "", "  \n\t ", None, "é ü ß 中文", "A" * 5000, prose(rng, 4000), base[7].replace("w1", "W1"), "one", "one two"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 0, "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[2], (7, "another text under a used id", "en", "s1", 0, "x", 1), (None, base[4], "en", "s1", 0, "x", 1), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def test_empty_tables_give_no_rows(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (decontam.contamination(empty, bench), secrets.secret_spans(empty), simhash.near_duplicates(empty), tokens.token_output(empty), pii.pii_spans(empty), linededup.line_dedup(empty), langid.language_of(empty), substr.substring_dedup(empty), mixing.mix_sources(empty.withColumn("size", F.lit(0).cast("long")))):
        assert out.count() == 0
    assert maxscore.topk_search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 100])
def test_decontamination(spark, docs, block_bytes):
    rows = corpus()
    long = rows[42][1].split()
    items = [(1, " ".join(long[-30:])), (2, " ".join(long[-12:]).upper()), (3, "one"), (4, "ONE, two!"), (5, None), (6, ""), (7, "absent words here"), (None, rows[8][1]), (2, "repeat of w1 w2")]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    want = []
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            s = split(text)
            for win in [s[j : j + 10] for j in range(len(s) - 9)] if len(s) >= 10 else [s] if s else []:
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert multiset(got.drop("items")) == Counter(want)


SECRETS = [
    'password = "abcdef" x', "PassWord:abc", "token=api_key=abcdefg", "secret: pass token: 123456", "AKIA" + "A" * 16, "AKIA" + "Z" * 15, "xAKIAAKIA" + "Q1" * 9, "0123456789abcdef01234567 and 0123456789abcdef0123456", "é" * 7 + " passwd='q/w+e=r' 中 api-key=zzzzzzz apikey:zzzzzz",
    "token " * 300, None, "", "secret=" + "a" * 100000, "password=a password=b password=cccccc", "key 9fK2xQ7LmZ4tR8vB1nW6yD3sH5jC0pG",
]


def base_secrets(t):
    a = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, "assign", m.end()) for m in a.finditer(t) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(0, SECRETS[0]), (None, SECRETS[1])]
    got = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        s = base_secrets(t or "")
        n = [sum(x[1] == k for x in s) for k in range(3)]
        want.append((i, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()).hexdigest()))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert "random:4:35" in next(r.spans for r in got if r.doc_id == len(SECRETS) - 1)
    for r in got:
        t = (dict(rows)[r.doc_id] if r.doc_id is not None else SECRETS[1]) or ""
        assert {f"{k}:{a}:{b}" for a, _, k, b in base_secrets(t)} <= set(r.spans.split(",")) | {""} or not base_secrets(t)


def test_secret_candidates_are_measured_in_linear_time(spark):
    import time

    rng = random.Random(5)
    t = "image " + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    small = secrets.secret_spans(spark.createDataFrame([(0, t[:2000])], "doc_id long, text string"))
    assert small.first().spans == "random:6:2000"
    began = time.time()
    assert secrets.secret_spans(spark.createDataFrame([(0, t)], "doc_id long, text string")).first().spans == "random:6:1000006"
    assert time.time() - began < 120


def test_random_strings_stand_out_from_structured_ones(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    real = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(60)]
    real = [x for x in real if re.search("[0-9]", x) and re.search("[a-z]", x)]
    fake = [f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i % 10}" for i in range(60)]
    rows = [(i, f"see {t} now") for i, t in enumerate(real + fake)]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random" in got[i] for i in range(len(real))) >= 0.9 * len(real)
    assert sum("random" in got[i] for i in range(len(real), len(rows))) == 0


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 2])
def test_simhash(docs, bucket_rows):
    rows = corpus()
    fps = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        h = [xxhash.xxh64(" ".join(w[j : j + 4]).encode(), seed=42).intdigest() for j in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << p for p in range(64) if 2 * sum(x >> p & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = Counter((rows[i][0], f"{fps[i]:016x}", least[comp[i]]) for i in range(len(rows)))
    assert multiset(simhash.near_duplicates(docs, bucket_rows=bucket_rows)) == want


@pytest.mark.parametrize(("lanes", "radius"), [(1, 4), (8, 95)])
def test_bucket_links_span_all_pairs(lanes, radius):
    rng = np.random.default_rng(0)
    fps = np.repeat(rng.integers(0, 2**63, (12, lanes), dtype=np.uint64), 40, axis=0)
    for r in range(len(fps)):
        for b in rng.integers(0, 64 * lanes, rng.integers(0, 4 if lanes == 1 else 60)):
            fps[r, b >> 6] ^= np.uint64(1) << np.uint64(b & 63)

    def roots(links):
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        return [find(i) for i in range(len(fps))]

    for keys in (np.zeros(480, int), np.repeat(np.arange(12), 40), np.sort(rng.integers(0, 60, 480))):
        a, b = simhash.bucket_links(fps, keys, radius)
        assert (keys[a] == keys[b]).all() and (np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= radius).all()
        near = [(i, j) for i in range(480) for j in np.flatnonzero((keys == keys[i]) & (np.bitwise_count(fps ^ fps[i]).sum(axis=1) <= radius))]
        x, y = roots(zip(a, b)), roots(near)
        assert len(set(zip(x, y))) == len(set(x)) == len(set(y))


def test_near_copies_leave_one(spark):
    rng = random.Random(3)
    rows = []
    for g in range(30):
        words = prose(rng, 300, 5000).split()
        for c in range(3):
            copy = list(words)
            for _ in range(3 * (c > 0)):
                copy[rng.randrange(300)] = "changed"
            rows.append((3 * g + c, " ".join(copy)))
    rows += [(200, rows[0][1]), (None, rows[3][1]), (3, rows[3][1]), (300, None), (301, ""), (302, "short")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [*range(0, 90, 3), 300, 302]


@pytest.mark.parametrize("most", [common.MAP_MOST, common.MAP_ROW])
def test_key_maps_miss_no_key(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAP_MOST", most)
    keys = spark.range(4000).select(F.when(F.col("id") > 0, F.xxhash64("id")).alias("h"))
    rows = spark.range(20000).select("id", F.when(F.col("id") > 0, F.xxhash64("id")).alias("h")).withColumn("part", F.lit("own"))
    got = {r.id: r._may for r in common.may_be_in(rows, "h", common.key_map(keys.where("h is not null"), "h", 4000)).collect()}
    assert len(got) == 20000 and all(got[i] for i in range(1, 4000)) and got[0] is False
    assert sum(got[i] for i in range(4000, 20000)) < (0.2 if most > common.MAP_ROW else 0.9) * 16000
    empty = common.may_be_in(rows, "h", common.key_map(keys.limit(0), "h", 0))
    assert empty.columns == ["id", "h", "part", "_may"] and empty.where("_may").isEmpty() and empty.count() == 20000


def test_stars_keep_components():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (300, 280), (300, 900)):
        names = rng.integers(-(1 << 62), 1 << 62, n)
        a, b = names[rng.integers(0, n, m)], names[rng.integers(0, n, m)]
        if n == 300 and m == 280:  # a long chain in mixed order
            a, b = names[:280], names[1:281]
        root = {x: x for x in [*a, *b]}
        for _ in range(n):
            for x, y in zip(a, b):
                root[x] = root[y] = min(root[x], root[y])
        member, least = simhash.stars(a, b)
        assert dict(zip(member, least)) == {x: r for x, r in root.items() if x != r}


def sets_of(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block_docs", [simhash.BLOCK_DOCS, 40])
def test_near_copies_are_those_of_counted_similarity(spark, monkeypatch, block_docs):
    monkeypatch.setattr(simhash.verified_links, "__defaults__", (block_docs, simhash.BLOCK_SHINGLES))
    rng = random.Random(21)
    texts = []
    for _ in range(150):  # pairs about the threshold: shared runs of words
        words = prose(rng, rng.randint(60, 300), 9000).split()
        texts.append(" ".join(words))
        cut = int(len(words) * rng.choice([0.85, 0.9, 0.95, 0.98]))
        texts.append(" ".join(words[:cut] + prose(rng, len(words) - cut, 9000).split()))
    base = prose(rng, 200, 9000).split()
    for _ in range(120):  # one group of many copies, each a little different
        copy = list(base)
        copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    phrase = "one phrase of five words "
    texts += [prose(rng, 300, 9000) + " " + phrase * 60 for _ in range(2)]
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.group for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: find(i) for i in range(len(texts))}
    pairs = lambda of: {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.99 * len(pairs(want))
    assert got[len(texts) - 1] != got[len(texts) - 2]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 9), (9, 8), (8, 7), (5, 5), (7, 7), (20, 30), (30, 20), (None, 4)] + [(100, 100 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 20: 20, 30: 20} | dict.fromkeys(range(100, 160), 100) | dict.fromkeys(range(1000, 1061), 1000)
    assert got == want


def test_token_blocks_read_back(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokens.token_output(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    crc = Counter((i, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == crc


def test_encoder_equals_the_library():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    rng = random.Random(2)
    pieces = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "中", "!", "\x1c", "\x85", "\xa0", "<|endoftext|>", "-", "́", "\U0001f600"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_block_lookup():
    ids, ordinals = [None, -5, 3, 3, 1 << 40], [0, 0, 0, 1, 0]
    payloads = [np.arange(n, dtype="<u2").tobytes() for n in (1, 0, 3, 4, 5)]
    data = tokens.pack_block(2, 7, ids, ordinals, payloads, "<u2")
    block = next(tokens.blocks(data + b"\n"))
    assert (block.part, block.seq, block.n_ids) == (2, 7, 13)
    for i, o, p in zip(ids, ordinals, payloads):
        assert block.get(i, o).tobytes() == p
    assert all(block.get(i) is None for i in range(100, 400))
    h = tokens._mix(np.arange(50000, dtype=np.uint64))
    assert sorted(tokens.PerfectHash.build(h).slot(h)) == list(range(50000))


def test_lookup_by_key(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    path = f"file://{tmp_path}/blocks"
    tokens.token_output(docs, path=path, index_docs=10).count()
    texts = {}
    for i, t, *_ in corpus():
        texts.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    for i in (0, 2, 7, 40, 49, None):
        assert sorted(tokens.lookup(spark, path, i, o).tolist() for o in range(len(texts[i]))) == sorted(texts[i])
        assert tokens.lookup(spark, path, i, len(texts[i])) is None
    assert tokens.lookup(spark, path, 12345) is None and tokens.lookup(spark, f"{path}-absent", 1) is None


def test_keys_of_one_hash_stand_apart():
    ids, ordinals = np.arange(6), np.zeros(6, np.int64)
    h = tokens._key_hash(ids, np.zeros(6, np.uint8), ordinals.astype(np.uint32))
    h[4] = h[1]
    data = tokens.pack_index(2, h, ids, np.zeros(6, bool), ordinals, ids + 10, ids + 100, ids + 1000)
    assert [tokens.find_in_index(data, i) for i in range(6)] == [(2, i + 10, i + 100, i + 1000) for i in range(6)]
    assert tokens.find_in_index(data, 6) is None and tokens.find_in_index(data, None) is None


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(t):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda t: 8 <= len(d) <= 15}[kind]
            if ok(m.group()):
                out.append((kind, *m.span()))
    return out


def test_pii_patterns_equal_regular_expressions():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("01234567890123456789..  --++()@@ab%\né") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == base_pii(t), t


def test_pii_field_adds_and_stays_calm(spark):
    add = {"call (555) 123-4567 now": "phone:5:19", "mail bob (at) example (dot) com please": "email:5:31", "card 4539.1488.0343.6467 ok": "card:5:24"}
    calm = ["in 2024-01-05 at 12:30 we paid 1,234.56", "version 3.0.12 and 7 8 9 10", "password=e3b3ed3cc8548923d6", "", None, "no digits at all"]
    rows = list(enumerate([*add, *calm]))
    got = {r.doc_id: r for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base_pii(t or "")).encode()).hexdigest()
        assert (add[t] in got[i].spans) if t in add else got[i].spans == ""


def test_pii_segments_hold_plain_tokens_and_cross_parts():
    card = "card 4539 - 1488 - 0343 - 6467 ok"
    assert ("card", 5, 30) in pii.find_pii(card)[1]
    phone, found = "(555) 123-4567", 0
    for n in [*range(58, 67), 71, 72, 73, 76, 77, 128, 700]:  # the program runs over all the numbers before it
        text = "12% " * n + phone + " 30%" * 12
        found += ("phone", 4 * n, 4 * n + len(phone)) in pii.find_pii(text)[1]
    assert found == 16


def test_pii_program_equals_the_plain_one():
    rng, field = random.Random(12), pii.trained()
    words = ["12", "(555)", "123-4567", "at", "(at)", "mail", "bob", "x@y", "0043", "99.1", "4539", "-", "host", "1.2.3.4"]
    for n in (1, 2, 7, 8, 9, 30):
        for _ in range(10):
            tokens = [rng.choice(words) for _ in range(n)]
            segs, feats = pii._segments(tokens, "a", "b")
            s = field.scores(segs, feats)
            p, _ = field.marginals(n, segs, s)
            want = [(*segs[q], y) for q, y in field.best(n, segs, s) if y and p[q, y] >= pii.SURE]
            assert pii.decode(tokens, "a", "b") == want



def test_pii_is_linear_in_long_runs():
    for t in ("a" * 200000 + "@", "1" * 200000, "1." * 50000, "+1" + " " * 200000, "a@" * 30000):
        pii.find_pii(t)


def test_mixing(docs):
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    a, b = (mixing.mix_sources(sized).select("doc_id", "text", "source", "size", "source_size", "target", "taken").toPandas() for _ in range(2))
    key = ["doc_id", "text", "source", "taken"]
    assert Counter(map(str, a[key].values.tolist())) == Counter(map(str, b[key].values.tolist()))
    assert (a["size"] == a.text.map(lambda t: len(WORD.findall(t or "")))).all() and (a.taken <= 2 * a["size"]).all()
    g = a.assign(source=a.source.fillna("~")).groupby("source").agg(S=("size", "sum"), T=("target", "first"), K=("taken", "sum"), n=("source_size", "first"))
    assert (g.n == g.S).all() and ((g.K - g["T"]).abs() <= 0.5 + 1e-9).all() and g["T"].sum() == pytest.approx(1.5 * g.S.sum())
    weights = dict(zip(sorted(g.index), [3, 1, 2, 3, 1]))
    level = {s: g["T"][s] / weights[s] for s in g.index if g["T"][s] < 2 * g.S[s] - 1e-9}
    assert max(level.values()) == pytest.approx(min(level.values()))
    whole = mixing.mixture(sized).groupBy("doc_id", "text").count().toPandas()
    assert whole["count"].max() <= 4


def test_splitting_tree_keeps_quotas():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 64):
        cap = rng.integers(0, 50, n)
        for q in (0, int(cap.sum()) // 2, int(cap.sum())):
            s = mixing.split_quota(cap, q, np.random.default_rng(1))
            assert s.sum() == q and (s >= 0).all() and (s <= cap).all()
    big = mixing.split_quota(np.array([10**12, 10**12]), 10**12, np.random.default_rng(2))
    assert big.sum() == 10**12 and abs(big[0] - 5 * 10**11) < 10**7


def test_hypergeometric_draws():
    rng = np.random.default_rng(3)
    for good, bad, sample in ((30, 50, 20), (50, 30, 70), (5, 400, 100), (200, 300, 490)):
        mine = np.array([mixing.hypergeometric(rng, good, bad, sample) for _ in range(4000)])
        lo, hi = max(0, sample - bad), min(good, sample)
        pmf = np.array([math.comb(good, z) * math.comb(bad, sample - z) / math.comb(good + bad, sample) for z in range(lo, hi + 1)])
        count = np.bincount(mine - lo, minlength=len(pmf))
        big = 4000 * pmf >= 5
        assert ((count[big] - 4000 * pmf[big]) ** 2 / (4000 * pmf[big])).sum() < big.sum() + 4.5 * math.sqrt(2 * big.sum())
    good, bad, sample = 4 * 10**12, 6 * 10**12, 10**11
    mine = np.array([mixing.hypergeometric(rng, good, bad, sample) for _ in range(400)], float)
    sd = math.sqrt(sample * 0.4 * 0.6 * (1 - sample / (good + bad)))
    assert abs(mine.mean() - 0.4 * sample) < 4 * sd / 20 and 0.85 < mine.std() / sd < 1.15


def test_mixing_deals_equal_rows_apart(spark):
    rows = [(1, "s", 10)] * 3000 + [(None, None, 3)] * 40 + [(i, "s", 10) for i in range(2, 500)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix_sources(sized)
    assert mixed.where("doc_id = 1").groupBy("shard").count().agg(F.max("count")).first()[0] < 100
    again = mixing.mix_sources(sized.repartition(7))
    key = ["doc_id", "source", "taken"]
    assert multiset(mixed.select(key)) == multiset(again.select(key))


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [prose(rng, rng.randint(1, 25), 3000) for _ in range(60)]
    near = [" ".join("changed" if i == 3 else w for i, w in enumerate(t.split())) for t in lines]
    rows = [(i, "\n".join(rng.choice([lines, near])[rng.randrange(60)] for _ in range(4))) for i in range(60)]
    rows += [(70, rows[0][1]), (71, None), (72, ""), (73, "\n\n  \n"), (None, lines[0] + "\nunseen line of this text"), (5, rows[5][1])]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).toPandas()

    def features(t):
        return frozenset(m.group(1) for m in re.finditer(r"(?<!\S)(?=(\S.{0,8}))", t.lower()))

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, sets = {}, {}
    for i in order:
        for j, t in enumerate((rows[i][1] or "").split("\n")):
            if t.strip():
                first.setdefault(t, (rows[i][0] is None, rows[i][0], j))
                sets[t] = features(t)
    root = {t: t for t in first}
    for _ in range(6):
        for a in first:
            for b in first:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    keep = {}
    for t, f in first.items():
        keep[root[t]] = min(keep.get(root[t], f), f)
    want = []
    for i, t in rows:
        own = (t or "").split("\n") if t is not None else []
        stay = [x for j, x in enumerate(own) if not x.strip() or keep[root[x]] == (i is None, i, j)]
        want.append((-1 if i is None else i, len(own), len(own) - len(stay), "\n".join(stay)))
    got = [(-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in got.itertuples()]
    assert Counter(got) == Counter(want)


def test_line_buckets_are_searched_whole():
    rng = random.Random(9)
    shared = [f"t{i}w" for i in range(24)]
    lines = []
    for g in range(1500):
        own = [f"{g + 1000}o{i}" for i in range(14)]
        lines += [" ".join(shared + own), " ".join(shared + own[:-3] + [f"{g + 1000}n{i}" for i in range(3)])]
    rng.shuffle(lines)
    sets = [np.unique(x) for x in np.split(*(lambda h, s: (h, s[1:]))(*linededup.shingles(lines, False)))]
    of = [set(x.tolist()) for x in sets]
    pairs = linededup.similar(sets, 0.8)
    assert len(pairs) == 1500 and all(len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]) for a, b in pairs)
    for n in (2, 3, 40):  # any sets at all: the components are those of all pairs
        some = [np.unique(np.array(rng.sample(range(12), rng.randint(5, 10)))) for _ in range(n)]
        root, want = list(range(n)), list(range(n))
        for out, links in ((root, linededup.similar(some, 0.8)), (want, [(a, b) for a in range(n) for b in range(a) if len(set(some[a]) & set(some[b])) >= 0.8 * len(set(some[a]) | set(some[b]))])):
            for _ in range(n):
                for a, b in links:
                    out[a] = out[b] = min(out[a], out[b])
        assert root == want


def test_line_bucket_of_thousands(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK_LINES", 1024)
    rng = random.Random(9)
    shared = [f"t{i}w" for i in range(24)]
    rows = []
    for g in range(1500):
        own = [f"{g + 1000}o{i}" for i in range(14)]
        rows += [(2 * g, " ".join(shared + own)), (2 * g + 1, " ".join(shared + own[:-3] + [f"{g + 1000}n{i}" for i in range(3)]))]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id for r in got.where("n_removed = 0").collect()}
    assert {2 * g for g in range(1500)} <= kept and len(kept) - 1500 < 0.03 * 1500


def test_line_dedup_reads_all_of_a_line(spark, tmp_path):
    from panelspark.llm.queries import op7_line_dedup

    lines = ["https://www.alpenglow.org/a/first-page", "https://www.marmalade.net/quite/another", "東京は日本の首都です。人口は世界でも最大級。", "東京は日本の首都ですが、昔は江戸と呼ばれていた。", "0123456789abcdefghijklm", "012345678zyxwvutsrqpon"]
    long = "".join(random.Random(2).choices("abcdefghij", k=200))
    rows = [*enumerate(lines), (10, long), (11, long[:150] + "X" + long[151:]), (12, "a b"), (13, "A B"), (14, "a c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id for r in op7_line_dedup(spark, str(tmp_path)).where("n_removed > 0").collect()}
    assert gone == {11, 13}


def generated(lang, rng, n):
    parts = {"en": ["the", "th", "ing", "ed", "and", "er", "wh", "on"], "fr": ["eau", "oi", "é", "que", "le", "ment", "ou", "aux"], "de": ["sch", "ei", "ung", "der", "ü", "und", "ch", "ß"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(6)
    langs = ["en", "fr", "de"]
    rows = [(i, generated(langs[i % 3], rng, rng.randint(15, 60)), langs[i % 3] if i % 7 else None) for i in range(300)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... 456", "fr"), (1003, "\U0001f600 \U0001f600", None), (None, rows[0][1], "en")]
    got = langid.language_of(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    by = got[got.doc_id.notna()].set_index("doc_id")
    assert all(by.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(300))
    assert np.mean([by.lang_pred[i] == langs[i % 3] for i in range(300) if by.held_out[i]]) > 0.97
    assert (by.loc[[1000, 1001, 1002, 1003], "lang_pred"] == "und").all() and got.score.between(0, 1).all()
    assert len(got) == len(rows) and got[got.doc_id.isna()].lang_pred.iloc[0] == by.lang_pred[0]


def test_rare_and_short_labels_are_learned(spark):
    rng = random.Random(16)
    own = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4)] for _ in range(150)]
    rows = [(3 * i, generated("en", rng, 40), "en") for i in range(400)] + [(3 * i, " ".join(rng.choice(["zq", "xv", "qx"]) for _ in range(3)), "zz") for i in range(400, 406)]
    rows += [(3 * i, generated("fr", rng, 5000), "fr") for i in range(500, 504)] + [(2000 + i, " ".join(rng.choices(own[i], k=40)), f"l{i:03}") for i in range(150)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.training_sample(known.select("lang", "text")), passes=2)
    assert len(model.languages) == 153
    assert [langid.classify([t], model)[0][0] for t in ("qx zq zq xv", " ".join(own[7] * 3))] == ["zz", "l007"]


def test_forward_backward_equals_the_plain_recursion():
    rng = np.random.default_rng(7)
    lengths, k = np.array([1, 31, 32, 33, 100, 2]), 3
    e, t = rng.normal(size=(lengths.sum(), k)), np.log(rng.dirichlet(np.ones(k), size=k))
    got, at = langid.forward_backward(e, lengths, t), 0
    for n in lengths:
        x, f, b = np.exp(e[at : at + n]), np.zeros((n, k)), np.ones((n, k))
        f[0] = (np.full(k, 1 / k) @ np.exp(t)) * x[0]
        for i in range(1, n):
            f[i] = (f[i - 1] @ np.exp(t)) * x[i]
            f[i] /= f[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = np.exp(t) @ (x[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b
        np.testing.assert_allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True), atol=1e-9)
        at += n


def test_code_switching_is_labelled_by_word():
    rng = random.Random(8)
    model = langid.train([(lang, generated(lang, rng, 80)) for lang in ("en", "fr", "de") for _ in range(30)])
    text = generated("en", rng, 30) + " " + generated("de", rng, 30)
    w = langid.words_of([text])
    post = langid.forward_backward(langid.emissions(w, model.weights), np.array([len(w.first)]), model.transitions)
    lang = [model.languages[i] for i in post.argmax(axis=1)]
    assert lang[:25].count("en") >= 23 and lang[-25:].count("de") >= 23


@pytest.mark.parametrize("tile", [(2048, 16384), (3, 7)])
def test_topk(spark, tile):
    rng = np.random.default_rng(9)
    v = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(60)]
    v += [(60, v[0][1]), (61, None), (62, [float("nan")] * 8), (63, [0.1, None] + [0.0] * 6), (64, [float("inf")] * 8), (65, [1.0] * 8), (65, [1.0] * 8), (0, v[0][1]), (80, [0.0] * 8)]
    got = maxscore.topk_search(spark.createDataFrame(v, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 5, tile=tile)
    ok = [(i, np.floor(64 * np.float32(x).astype(float)).astype(int)) for i, x in v if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = []
    for a, (i, x) in enumerate(ok):
        if i % 20 == 0:
            scored = sorted((-int(x @ y), j) for b, (j, y) in enumerate(ok) if b != a)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert multiset(got) == Counter(want)


def test_topk_prunes_without_losing():
    rng = np.random.default_rng(10)
    q, c = rng.integers(-9, 9, (40, 32)), rng.integers(-9, 9, (900, 32))
    q[:, :4] *= 30
    c[:, :4] *= 30
    qi, ci, s = maxscore.shard_topk(q, np.full(40, -1), c, np.arange(900), 10)
    full = q @ c.T
    for i in range(40):
        assert list(zip(-s[qi == i], ci[qi == i])) == sorted(zip(-full[i], range(900)))[:10]


def test_topk_abandons_candidates():
    rng = np.random.default_rng(11)
    q, c, stats = rng.integers(-60, 60, (30, 64)), rng.integers(-60, 60, (9000, 64)), [0, 0]
    qi, ci, s = maxscore.shard_topk(q, np.full(30, -1), c, np.arange(9000), 20, stats=stats)
    full = q @ c.T
    kth = np.sort(full, axis=1)[:, -20].astype(float)
    for i in range(30):
        assert list(zip(-s[qi == i], ci[qi == i])) == sorted(zip(-full[i], range(9000)))[:20]
    assert stats[0] == 30 * 9000 and stats[1] < 0.1 * stats[0]
    qi, ci, s = maxscore.shard_topk(q, np.full(30, -1), c, np.arange(9000), 20, kth)
    assert all((s[qi == i] >= kth[i]).all() and (qi == i).sum() == 20 for i in range(30))


CLASH = ["score", "lang_pred", "size", "target", "taken", "shard", "spans", "n_words", "kept", "fp", "node", "h", "t", "k", "b", "at", "id", "tile", "places", "uid", "root", "group", "key", "held_out", "start", "n_tokens", "component_id", "_key", "_th", "_id"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def test_columns_of_clashing_names(spark, docs):
    bench = spark.createDataFrame([(1, corpus()[42][1])], "item_id long, text string")
    plain = docs.select("doc_id", "text", "lang", "source")
    ops = [lambda d: decontam.contamination(d, clashing(bench)).drop("items"), secrets.secret_spans, simhash.near_duplicates, tokens.token_output, pii.pii_spans, linededup.line_dedup, langid.language_of, substr.substring_dedup]
    for op in ops:
        assert multiset(op(clashing(plain))) == multiset(op(plain))
    sized = plain.withColumn("size", mixing.word_count(F.col("text")))
    key = ["doc_id", "text", "target", "taken"]
    assert multiset(mixing.mix_sources(clashing(sized)).select(key)) == multiset(mixing.mix_sources(sized).select(key))
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert multiset(maxscore.topk_search(v.withColumns({c: F.lit(0) for c in ("uid", "shard", "block", "v", "score", "rank", "asks")}), F.col("vec_id") % 20 == 0)) == multiset(maxscore.topk_search(v, F.col("vec_id") % 20 == 0))


def test_pipeline_stages_keep_foreign_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang or "en", s, 0) for i, t, lang, s, *_ in corpus()] + [(900, "very long " * 60000, "en", "s1", 0)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([(0, corpus()[42][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.select(*[c for c in CLASH if c in out.columns and c not in ("doc_id",)]).distinct().collect() == [tuple("clash" for _ in CLASH)]
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.tokenize(spark, docs, str(tmp_path)).count() == len(rows)


def test_substring_dedup_settles_passages_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(substr, "BATCH_WORDS", 3000)
    rng = random.Random(31)
    header, passage = prose(rng, 22, 9000), prose(rng, 60, 9000)
    rows = [(i, f"{header} {prose(rng, rng.randint(0, 40), 9000)} {passage if i % 3 else ''} {'echo ' * rng.randint(0, 30)}") for i in range(300)]
    rng.shuffle(rows)
    starts = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 12):
            starts[tuple(w[j : j + 13])] = min(starts.get(tuple(w[j : j + 13]), i), i)
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {p for j in range(len(w) - 12) if starts[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())] += 1
    assert multiset(substr.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_substring_dedup(docs):
    rows = corpus()
    starts = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j : j + 13])
                starts[k] = min(starts.get(k, i), i)
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {p for j in range(len(w) - 12) if i is not None and starts[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert multiset(substr.substring_dedup(docs)) == Counter(want)
    assert sum(x[2] for x in want) > 100


def test_decontamination_stage_takes_short_items(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, "zebra quilt harbour")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(0, "see the zebra quilt harbour here"), (1, "zebra harbour quilt"), (2, None)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == {1, 2}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, generated("en", rng, 60), "en", f"s{i % 3}", 0) for i in range(60)]
    item = " ".join(generated("fr", rng, 40).split()[:20])
    rows += [(100, rows[5][1], "en", "s0", 0), (101, rows[1][1] + " " + item, "en", "s1", 0), (102, "... 123", "en", "s1", 0), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen.append({r.doc_id for r in docs.collect()})
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert seen[0] == set(range(60)) | {100, 101}
    assert seen[1] == seen[0] - {100}
    assert seen[2] == seen[1] - {101}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
