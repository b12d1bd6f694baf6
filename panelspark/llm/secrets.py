"""Secret scan in built-in functions: fixed patterns, and a randomness test battery for what they miss.

Spark returns the texts of all matches but not their places. Each pattern is therefore matched together
with the gap before it, anchored to the end of the match before (``\\G``), which keeps the scan linear;
places are running sums of lengths in code points.

Other long strings of code characters that hold a letter and a digit are candidates. The encoding inferred
from its characters gives a candidate's alphabet; chi-squared uniformity over it, a runs test around its
middle and a serial-correlation test give a p-value of being random, Bonferroni-combined. A string from a
generator passes all three. A candidate is reported unless it is called structured, and that is decided for
all of the corpus by Benjamini-Hochberg within strata of length: of the strings dismissed as structured, an
expected share of at most ``RATE`` are random ones, missed secrets. In doubt a string is reported. Short
strings, on which the tests have little power, don't set the threshold of long ones; only counts of
p-values on a fixed grid reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import materialize

#: Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_-]{20,}={0,2}"

#: (encoding, pattern, alphabet): the first whose pattern fits a whole candidate, less its padding.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_+/-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_+/"),
)
#: Lengths at which strata begin; false-discovery rate among strings called structured.
STRATA, RATE = (20, 32, 48, 96), 0.05
#: Steps of the grid of p-values per power of ten, and its end.
GRID, LAST = 50, 600
BLOCK = 256


def running(lengths: Column) -> Column:
    """Running sums of an array of longs, in blocks so that long arrays stay cheap."""

    def sums(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: sums(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    return F.transform(F.array(F.struct(blocks.alias("b"))), lambda s: _joined(s["b"], sums))[0]


def _joined(blocks: Column, sums) -> Column:
    offsets = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    moved = F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda b, o: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x: x + o))
    return F.flatten(moved)


def _none() -> Column:
    return F.array().cast("array<string>")


def matches(text: Column, pattern: str, maybe: Column) -> tuple[Column, Column]:
    """Gaps before the matches of ``pattern``, and the matches; none where ``maybe`` is false."""
    gap, whole = F.lit(rf"\G(?s)(.*?)(?:{pattern})"), F.lit(rf"\G(?s:.*?)({pattern})")
    return F.when(maybe, F.regexp_extract_all(text, gap, 1)).otherwise(_none()), F.when(maybe, F.regexp_extract_all(text, whole, 1)).otherwise(_none())


def _spans(gaps: Column, found: Column) -> Column:
    """Structs (start, end, s) of matches."""
    ends = running(F.zip_with(gaps, found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long")))
    return F.zip_with(ends, found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("s")))


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds ``z`` (a published rational approximation)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # Fixed values of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    tail = 0.3989422804014327 * F.exp(-x * x / 2) * t * reduce(lambda acc, c: F.lit(c) + t * acc, reversed(b[:-1]), F.lit(b[-1]))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _coded(c: Column) -> Column:
    bare = F.regexp_replace(c["s"], "=+$", "")
    alphabet = F.coalesce(*[F.when(bare.rlike(p), F.lit(a)) for _, p, a in ENCODINGS])
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), bare.alias("s"), alphabet.alias("alphabet"), F.char_length(bare).alias("n"), F.char_length(alphabet).cast("double").alias("m"))


def _measured(c: Column) -> Column:
    letters = F.split(c["s"], "")
    codes = F.transform(letters, lambda x: (F.instr(c["alphabet"], x) - 1).cast("double"))
    # One pass over the string for each letter that it has, and it has no more than its alphabet.
    times = F.transform(F.array_distinct(letters), lambda x: (c["n"] - F.char_length(F.replace(c["s"], x, F.lit("")))).cast("double"))
    squares = F.aggregate(times, F.lit(0.0), lambda acc, n: acc + n * n)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].cast("double").alias("n"), c["m"].alias("m"), codes.alias("x"), squares.alias("squares"))


def _summed(c: Column) -> Column:
    x = c["x"]
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / c["n"]
    high = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v >= c["m"] / 2).cast("double"))
    steps = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changes = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + ((s["a"] >= c["m"] / 2) != (s["b"] >= c["m"] / 2)).cast("double"))
    cross = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["a"] * s["b"])
    square = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
    first, last = F.element_at(x, 1), F.element_at(x, -1)
    # Sums of products around the mean, from plain sums.
    around = cross - mean * (2 * mean * c["n"] - first - last) + (c["n"] - 1) * mean * mean
    spread = square - c["n"] * mean * mean
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["n"].alias("n"), c["m"].alias("m"), c["squares"].alias("squares"), high.alias("high"), (changes + 1).alias("runs"), around.alias("around"), spread.alias("spread"))


def _tested(c: Column) -> Column:
    n, df = c["n"], c["m"] - 1
    chi = c["m"] * c["squares"] / n - n
    z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mixed = 2 * c["high"] * (n - c["high"]) / n
    var = mixed * (mixed - 1) / (n - 1)
    z_runs = F.when(var > 0, (c["runs"] - 1 - mixed) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(9.0))
    z_serial = F.when(c["spread"] > 0, (c["around"] / F.greatest(c["spread"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    least = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))
    p = F.least(F.lit(1.0), F.greatest(3 * least, F.lit(10.0 ** (-LAST / GRID))))
    stratum = reduce(lambda acc, i: F.when(n >= STRATA[i], F.lit(i)).otherwise(acc), range(len(STRATA)), F.lit(0))
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), stratum.alias("stratum"), F.floor(-F.log10(p) * GRID).cast("int").alias("cell"))


def candidates(text: Column, base: Column, maybe: Column) -> Column:
    """Structs (start, end, stratum, cell) of candidates beside the base spans; ``cell`` is the p-value's place on the grid."""
    gaps, found = matches(text, CANDIDATE, maybe)
    mixed = F.filter(_spans(gaps, found), lambda c: c["s"].rlike("[0-9]") & c["s"].rlike("[A-Za-z]"))
    apart = F.filter(mixed, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    coded = F.filter(F.transform(apart, _coded), lambda c: c["alphabet"].isNotNull() & (c["n"] >= STRATA[0]))
    return F.transform(F.transform(F.transform(coded, _measured), _summed), _tested)


def thresholds(cells: DataFrame, rate: float = RATE) -> list[int]:
    """For each stratum the first grid cell that is structured, by Benjamini-Hochberg on the grid's upper ends."""
    counts: dict[int, dict[int, int]] = {i: {} for i in range(len(STRATA))}
    for r in cells.groupBy("stratum", "cell").count().collect():  # at most strata x grid cells
        counts[r["stratum"]][r["cell"]] = r["count"]
    out = []
    for i in range(len(STRATA)):
        total, seen, first = sum(counts[i].values()), 0, LAST + 1
        for cell in sorted(counts[i], reverse=True):
            seen += counts[i][cell]
            if 10.0 ** (-cell / GRID) <= rate * seen / total:
                first = cell
        out.append(first)
    return out


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    Counts and digest are of the fixed patterns; ``spans`` lists these and the strings called random, by
    start and then kind, in code points with exclusive ends. A null text counts as empty; null or repeated
    ids stay as they are; an empty table gives no rows; other columns are ignored. Every text is scanned
    once; what it yields is stored, and the corpus-wide thresholds come from there.
    """
    t = F.col("t")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    maybe = t.rlike("(?i)password|passwd|secret|token|api_?key")
    a_gap, a_all = matches(t, ASSIGN + VALUE, maybe)
    k_gap, k_all = matches(t, ACCESS, F.contains(t, F.lit("AKIA")))
    h_gap, h_all = matches(t, HEX, t.rlike("[0-9a-f]{24}"))
    found = rows.select("doc_id", "t", a_gap.alias("ag"), a_all.alias("am"), k_gap.alias("kg"), k_all.alias("km"), h_gap.alias("hg"), h_all.alias("hm"))
    valued = F.filter(_spans(F.col("ag"), F.col("am")), lambda c: F.char_length(F.regexp_replace(c["s"], F.lit("^" + ASSIGN), F.lit(""))) >= 6)
    kinds = {"a": valued, "k": _spans(F.col("kg"), F.col("km")), "h": _spans(F.col("hg"), F.col("hm"))}
    spans = found.select("doc_id", "t", *[F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k, c in kinds.items()])
    base = F.flatten(F.array("a", "k", "h"))
    narrow = spans.select("doc_id", "a", "k", "h", candidates(t, base, t.rlike("[0-9]")).alias("c"))
    stored = materialize(narrow, "secrets")
    first = thresholds(stored.select(F.explode("c").alias("c")).select("c.stratum", "c.cell"))
    limit = F.array(*[F.lit(x) for x in first])

    def listed(columns: list[tuple[int, Column]]) -> Column:
        def tag(i: int):
            return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))

        tagged = [F.transform(c, tag(i)) for i, c in columns]
        named = F.transform(F.array_sort(F.flatten(F.array(*tagged))), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    fixed = [(0, F.col("a")), (1, F.col("k")), (2, F.col("h"))]
    random = F.filter("c", lambda c: c["cell"] < F.element_at(limit, c["stratum"] + 1))
    counts = [F.size(k).cast("long").alias(f"n_{n}") for k, n in zip("akh", KINDS)]
    return stored.select("doc_id", *counts, F.sha2(listed(fixed), 256).alias("base_sha256"), listed([*fixed, (3, random)]).alias("spans"))
