"""Signal search: rewards, allocation, survivors, promotion, a ledger and the generation loop."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators.evaluation import fit_curve, response_curve, turnover
from panelspark.plans.dsl import Program, Proposer, compile_signals, validate


def net_rate(curve: Mapping[int, float], roundtrip: float) -> float:
    """Best of (A(k) - round-trip cost) / k."""
    return max(((a - roundtrip) / k for k, a in curve.items() if a is not None and math.isfinite(a)), default=-math.inf)


def reward(terms: Mapping[str, float], weights: Mapping[str, tuple[float, float]] = {"net_rate": (1.0, 5e-6), "similarity": (-0.5, 0.5)}) -> float:
    """Sum of weight times term over scale."""
    return sum(w * terms[k] / scale for k, (w, scale) in weights.items() if k in terms)


def allocate(history: Mapping[str, Sequence[float]], arms: Sequence[str], n: int, c: float = 1.0) -> dict[str, int]:
    """Upper-confidence allocation: untried arms first, then mean reward plus an exploration term."""
    counts = {a: len(history.get(a, ())) for a in arms}
    means = {a: float(np.mean(history[a])) if counts[a] else 0.0 for a in arms}
    out: dict[str, int] = defaultdict(int)
    for _ in range(n):
        total = sum(counts.values()) + 1
        best = max(arms, key=lambda a: (counts[a] == 0, means[a] + c * math.sqrt(math.log(total) / max(counts[a], 1)), -arms.index(a)))
        out[best] += 1
        counts[best] += 1
    return dict(out)


def select_survivors(candidates: Sequence[Mapping], corr: Callable[[str, str], float], keep: int, most: float = 0.7, per_column: int = 3) -> list[Mapping]:
    """Best first, skipping those too like a kept one or whose columns are used up."""
    kept, used = [], defaultdict(int)
    for c in sorted(candidates, key=lambda c: (-c["reward"], c["hash"])):
        if len(kept) == keep:
            break
        if any(used[x] >= per_column for x in c["columns"]) or any(abs(corr(c["hash"], k["hash"])) > most for k in kept):
            continue
        kept.append(c)
        for x in c["columns"]:
            used[x] += 1
    return kept


def promotable(ledger: DataFrame, days: int = 20, capture: float = 0.5, share: float = 0.2, low: int = 5, high: int = 50) -> DataFrame:
    """Ledger rows that pass the promotion filters, ranked by train net rate and cut at a fifth of the eligible, within bounds."""
    ok = ledger.where((F.col("a0") > 0) & (F.col("median_peak") > 0) & (F.col("test_days") >= days) & (F.col("net_rate") > 0) & (F.col("capture") >= capture))
    w = Window.partitionBy("roll_id")
    ranked = ok.withColumns({"_n": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy(F.col("train_net_rate").desc(), "cand_hash"))})
    return ranked.where(F.col("rank") <= F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(F.col("_n") * share)))).drop("_n")


def pooled_direction(history: DataFrame) -> DataFrame:
    """Per candidate the sign of the inverse-variance pooled effect, or of the latest one where nothing pools."""
    ok = (F.col("se") > 0) & F.col("effect").isNotNull()
    w = F.when(ok, 1 / (F.col("se") * F.col("se")))
    g = history.groupBy("cand_hash").agg((F.sum(w * F.col("effect")) / F.sum(w)).alias("pooled"), F.max_by("effect", "roll_id").alias("latest"))
    return g.select("cand_hash", F.signum(F.coalesce("pooled", "latest")).cast("int").alias("direction"), "pooled")


def bridge(promotions: DataFrame) -> DataFrame:
    """One entry per program: the strongest absolute t gives the direction, the first roll its start."""
    return promotions.groupBy("cand_hash").agg(F.max_by("direction", F.struct(F.abs("select_alpha_tstat"), "roll_id")).alias("direction"), F.min("valid_from").alias("valid_from"), F.max(F.abs("select_alpha_tstat")).alias("abs_t"), F.count(F.lit(1)).alias("n_rolls"))


def enumerate_pairs(panel: DataFrame, features: Sequence[str], target: str, top: int = 20) -> DataFrame:
    """Products, sums, differences and singles of standardised features by their mean product with the target.

    One aggregation computes all moments; features are few, and the templates follow from the moments.
    """
    w = Window.partitionBy("timestamp")
    z = panel.where(F.col(target).isNotNull()).select("timestamp", F.col(target).alias("_y"), *[((F.col(f) - F.avg(f).over(w)) / (F.stddev_pop(f).over(w) + 1e-10)).alias(f) for f in features])
    names = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    single = {f: F.avg(F.col(f) * F.col("_y")) for f in features}
    product = {(a, b): F.avg(F.col(a) * F.col(b) * F.col("_y")) for a, b in names}
    got = z.agg(*[c.alias(f"s{i}") for i, c in enumerate(single.values())], *[c.alias(f"p{i}") for i, c in enumerate(product.values())]).first()
    s = {f: got[f"s{i}"] or 0.0 for i, f in enumerate(features)}
    rows = [("single", f, None, s[f]) for f in features] + [("product", a, b, got[f"p{i}"] or 0.0) for i, (a, b) in enumerate(names)]
    rows += [("sum", a, b, (s[a] + s[b]) / math.sqrt(2)) for a, b in names] + [("difference", a, b, (s[a] - s[b]) / math.sqrt(2)) for a, b in names]
    rows.sort(key=lambda r: (-abs(r[3]), r[0], r[1], r[2] or ""))
    return panel.sparkSession.createDataFrame([(t, a, b, float(abs(v)), 1 if v >= 0 else -1) for t, a, b, v in rows[:top]], "template string, a string, b string, score double, direction int")


def search(panel: DataFrame, residuals: DataFrame, proposer: Proposer, columns: Sequence[str], generations: int = 3, batch: int = 8, keep: int = 4, ks: Sequence[int] = (1, 6, 36), roundtrip: float = 1e-3) -> pd.DataFrame:
    """Generations of programs: a batch is compiled into one plan, stored once, and measured curve by curve.

    Returns the ledger: one row per evaluated program.
    """
    from pyspark import StorageLevel

    ledger, parents, seen = [], [], set()
    for generation in range(generations):
        batch_of = {f"s{i}": p for i, p in enumerate(p for p in proposer.propose(batch, list(columns), parents) if p.identity not in seen)}
        for p in batch_of.values():
            validate(p, columns)
            seen.add(p.identity)
        if not batch_of:
            break
        signals = compile_signals(batch_of).apply(panel).select("timestamp", "symbol", *batch_of).persist(StorageLevel.DISK_ONLY)
        for name, p in batch_of.items():
            signal = signals.select("timestamp", "symbol", F.col(name).alias("signal"))
            curve = {r["k"]: r["a"] for r in response_curve(signal, residuals, ks, stride=max(ks)).collect()}
            values = {k: a for k, a in curve.items() if a is not None}
            flip = -1 if values and sum(values.values()) < 0 else 1
            rate = net_rate({k: flip * a for k, a in values.items()}, roundtrip)
            known = sorted(values)
            fit = fit_curve(np.interp(np.arange(1, known[-1] + 1), [0, *known], [0.0, *(flip * values[k] for k in known)])) if known else {}
            ledger.append({"generation": generation, "cand_hash": p.identity, "candidate_json": p.to_json(), "direction": flip, "net_rate": rate, "reward": reward({"net_rate": max(rate, -1.0)}), "half_life_bars": fit.get("half_life"), "program": p})
        signals.unpersist()
        best = sorted(ledger, key=lambda r: (-r["reward"], r["cand_hash"]))[:keep]
        parents = [r["program"] for r in best]
    return pd.DataFrame([{k: v for k, v in r.items() if k != "program"} for r in ledger])


def signal_turnover(weights: DataFrame) -> DataFrame:
    """Mean half turnover, without the first bar; one row."""
    t = turnover(weights)
    first = t.agg(F.min("timestamp")).first()[0]
    return t.where(F.col("timestamp") > F.lit(first)).agg((F.avg("turnover") / 2).alias("turnover"))


__all__ = ["Program", "allocate", "bridge", "enumerate_pairs", "net_rate", "pooled_direction", "promotable", "reward", "search", "select_survivors", "signal_turnover"]
