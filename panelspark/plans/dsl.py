"""Signal programs: a small expression language over panel columns, compiled to staged column formulas.

A program is an S-expression of tuples: ``("col", name)``, ``(op, operands..., window)`` or
``("where", (cmp, operand, threshold), then, otherwise)``, with up to two gate conditions. Equal subtrees
are compiled once; stages alternate between a symbol's history and a timestamp's cross-section, so a batch
of programs sorts each axis as often as its deepest program does.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.plans.formula import Formula, across, lag, mean, percent_rank, std, total

#: Bounds of a program.
WINDOWS, DEPTH, NODES, GATES = (6, 36, 144, 432), 4, 24, 2


@dataclass(frozen=True)
class Operator:
    arity: int
    windowed: bool
    build: Callable[..., str]


def _m(w: int) -> int:
    return max(2, w // 2)


#: The registry is the extension point: an operator builds SQL text from its operands' column names.
OPERATORS: dict[str, Operator] = {
    "neg": Operator(1, False, lambda x: f"-{x}"),
    "abs": Operator(1, False, lambda x: f"abs({x})"),
    "sign": Operator(1, False, lambda x: f"CAST(sign({x}) AS DOUBLE)"),
    "square": Operator(1, False, lambda x: f"sign({x}) * {x} * {x}"),
    "sqrt": Operator(1, False, lambda x: f"sign({x}) * sqrt(abs({x}))"),
    "log1p": Operator(1, False, lambda x: f"sign({x}) * ln(1 + abs({x}))"),
    "tanh": Operator(1, False, lambda x: f"tanh({x})"),
    "add": Operator(2, False, lambda a, b: f"{a} + {b}"),
    "sub": Operator(2, False, lambda a, b: f"{a} - {b}"),
    "mul": Operator(2, False, lambda a, b: f"{a} * {b}"),
    "div": Operator(2, False, lambda a, b: f"{a} / (abs({b}) + 1e-10)"),
    "roll_mean": Operator(1, True, lambda x, w: mean(x, w, _m(w))),
    "roll_std": Operator(1, True, lambda x, w: std(x, w, _m(w))),
    "roll_sum": Operator(1, True, lambda x, w: total(x, w, _m(w))),
    "roll_zscore": Operator(1, True, lambda x, w: f"({x} - ({mean(x, w, _m(w))})) / (({std(x, w, _m(w))}) + 1e-10)"),
    "roll_delta": Operator(1, True, lambda x, w: f"{x} - {lag(x, w)}"),
    "cs_rank": Operator(1, False, lambda x: f"({percent_rank(x)}) - 0.5"),
    "cs_zscore": Operator(1, False, lambda x: f"({x} - {across(f'avg({x})')}) / ({across(f'stddev_samp({x})')} + 1e-10)"),
    "cs_demean": Operator(1, False, lambda x: f"{x} - {across(f'avg({x})')}"),
}
CONDITIONS: dict[str, Callable[[str, float], str]] = {
    "gt": lambda x, t: f"{x} > {t!r}",
    "lt": lambda x, t: f"{x} < {t!r}",
    "abs_gt": lambda x, t: f"abs({x}) > {t!r}",
    "abs_lt": lambda x, t: f"abs({x}) < {t!r}",
}


class InvalidProgram(ValueError):
    pass


@dataclass(frozen=True)
class Program:
    expr: tuple
    gates: tuple = ()

    def to_json(self) -> str:
        return json.dumps({"expr": self.expr, "gates": self.gates}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Program:
        def fixed(x):
            return tuple(map(fixed, x)) if isinstance(x, list) else x

        data = json.loads(text)
        return Program(fixed(data["expr"]), fixed(data.get("gates", [])))

    @property
    def identity(self) -> str:
        return hashlib.sha1(self.to_json().encode()).hexdigest()[:16]


def children(node: tuple) -> list[tuple]:
    if node[0] == "col":
        return []
    if node[0] == "where":
        return [node[1][1], node[2], node[3]]
    return [x for x in node[1:] if isinstance(x, tuple)]


def nodes(program: Program) -> list[tuple]:
    out, todo = [], [program.expr, *[g[1] for g in program.gates]]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += children(node)
    return out


def depth(node: tuple) -> int:
    return 1 + max(map(depth, children(node)), default=0)


def columns(program: Program) -> set[str]:
    return {n[1] for n in nodes(program) if n[0] == "col"}


def validate(program: Program, known: Iterable[str]) -> None:
    """Raise InvalidProgram unless operators, arities, windows, columns and sizes are within bounds."""
    known = set(known)

    def check(node) -> None:
        if not isinstance(node, tuple) or not node or not isinstance(node[0], str):
            raise InvalidProgram(f"not an expression: {node!r}")
        if node[0] == "col":
            if len(node) != 2 or node[1] not in known:
                raise InvalidProgram(f"unknown column: {node!r}")
        elif node[0] == "where":
            if len(node) != 4:
                raise InvalidProgram("where takes a condition and two branches")
            condition(node[1])
            check(node[2])
            check(node[3])
        else:
            op = OPERATORS.get(node[0])
            if op is None:
                raise InvalidProgram(f"unknown operator: {node[0]}")
            if len(node) != 1 + op.arity + op.windowed:
                raise InvalidProgram(f"{node[0]} takes {op.arity} operands")
            if op.windowed and node[-1] not in WINDOWS:
                raise InvalidProgram(f"window {node[-1]!r} is not one of {WINDOWS}")
            for x in node[1 : 1 + op.arity]:
                check(x)

    def condition(c) -> None:
        if not isinstance(c, tuple) or len(c) != 3 or c[0] not in CONDITIONS or not isinstance(c[2], (int, float)):
            raise InvalidProgram(f"not a condition: {c!r}")
        check(c[1])

    check(program.expr)
    for g in program.gates:
        condition(g)
    if len(program.gates) > GATES or len(nodes(program)) > NODES or max(depth(program.expr), *[depth(g[1]) for g in program.gates], 0) > DEPTH:
        raise InvalidProgram("the program is too large")


class Compiler:
    """Shares subtrees of all its programs; a node's stage is one more than its operands'."""

    def __init__(self):
        self.names: dict[tuple, tuple[str, int]] = {}
        self.stages: list[dict[str, str]] = []

    def _put(self, key: tuple, text: str, stage: int) -> tuple[str, int]:
        name = f"e{len(self.names)}"
        while len(self.stages) < stage:
            self.stages.append({})
        self.stages[stage - 1][name] = text
        self.names[key] = (name, stage)
        return self.names[key]

    def node(self, node: tuple) -> tuple[str, int]:
        if node in self.names:
            return self.names[node]
        if node[0] == "col":
            return node[1], 0
        if node[0] == "where":
            cmp, x, t = node[1]
            (x, i), (a, j), (b, k) = map(self.node, (x, node[2], node[3]))
            return self._put(node, f"CASE WHEN {CONDITIONS[cmp](x, float(t))} THEN {a} ELSE {b} END", 1 + max(i, j, k))
        op = OPERATORS[node[0]]
        done = [self.node(x) for x in node[1 : 1 + op.arity]]
        return self._put(node, op.build(*[n for n, _ in done], *node[1 + op.arity :]), 1 + max(s for _, s in done))

    def signal(self, program: Program, name: str) -> None:
        """Gate (closed rows are 0, unless the value is missing), z-score by timestamp, clip at 3."""
        raw, at = self.node(program.expr)
        if program.gates:
            gates = [(g, self.node(g[1])) for g in program.gates]
            test = " AND ".join(CONDITIONS[g[0]](n, float(g[2])) for g, (n, _) in gates)
            raw, at = self._put(("gated", program), f"CASE WHEN {raw} IS NULL THEN NULL WHEN {test} THEN {raw} ELSE 0 END", 1 + max(at, *[s for _, (_, s) in gates]))
        z, at = self._put(("z", program), f"({raw} - {across(f'avg({raw})')}) / ({across(f'stddev_samp({raw})')} + 1e-10)", at + 1)
        while len(self.stages) < at + 1:
            self.stages.append({})
        self.stages[at][name] = f"CASE WHEN {z} IS NOT NULL THEN least(greatest({z}, -3), 3) END"


def compile_expression(expr: tuple, name: str = "value") -> Formula:
    """The bare expression as a formula."""
    c = Compiler()
    at, stage = c.node(expr)
    stages = c.stages + [{name: at}] if stage else [{name: at}]
    return Formula(tuple(stages), (name,))


def compile_signals(programs: dict[str, Program]) -> Formula:
    """Signals of several programs in one plan."""
    c = Compiler()
    for name, program in programs.items():
        c.signal(program, name)
    return Formula(tuple(s for s in c.stages if s), tuple(programs))


def signals(panel: DataFrame, programs: dict[str, Program]) -> DataFrame:
    """(timestamp, symbol, one column per program) for validated programs."""
    for p in programs.values():
        validate(p, panel.columns)
    return compile_signals(programs).apply(panel).select("timestamp", "symbol", *programs)


def causal(panel: DataFrame, program: Program, share: float = 0.75, tolerance: float = 1e-8) -> bool:
    """Whether the signal at the stamp after ``share`` of the stamps is the same without the later rows."""
    stamps = panel.select("timestamp").distinct()
    cut = stamps.select(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), share, 100000)).first()[0]
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    whole = signals(panel, {"a": program}).where(at == cut)
    short = signals(panel.where(at <= cut), {"b": program}).where(at == cut)
    worst = whole.join(short, ["timestamp", "symbol"], "full_outer").agg(F.max(F.abs(F.coalesce(F.col("a"), F.lit(1e9)) - F.coalesce(F.col("b"), F.lit(1e9))))).first()[0]
    return worst is None or worst <= tolerance


class Proposer:
    """Source of candidate programs."""

    def propose(self, n: int, known: list[str], parents: list[Program]) -> list[Program]:
        raise NotImplementedError


class RandomProposer(Proposer):
    """Seeded programs: fresh ones, and parents with a subtree, leaf, wrapper or gate changed."""

    def __init__(self, seed: int = 0, fresh: float = 0.5):
        self.rng, self.fresh = random.Random(seed), fresh

    def _tree(self, known: list[str], budget: int) -> tuple:
        if budget <= 1 or self.rng.random() < 0.3:
            return ("col", self.rng.choice(known))
        name = self.rng.choice(sorted(OPERATORS))
        op = OPERATORS[name]
        return (name, *[self._tree(known, budget - 1) for _ in range(op.arity)], *([self.rng.choice(WINDOWS)] if op.windowed else []))

    def _gate(self, known: list[str]) -> tuple:
        return (self.rng.choice(sorted(CONDITIONS)), ("col", self.rng.choice(known)), round(self.rng.uniform(-1, 1), 2))

    def _swap(self, node: tuple, at: int, new: tuple) -> tuple[tuple, int]:
        if at == 0:
            return new, -1
        at, out = at - 1, []
        for x in node:
            if isinstance(x, tuple) and node[0] not in ("col", "where") and at >= 0:
                x, at = self._swap(x, at, new)
            out.append(x)
        return tuple(out), at

    def _changed(self, p: Program, known: list[str]) -> Program:
        size, draw = len(nodes(Program(p.expr))), self.rng.random()
        if draw < 0.4:
            return Program(self._swap(p.expr, self.rng.randrange(size), self._tree(known, 2))[0], p.gates)
        if draw < 0.6:
            return Program((self.rng.choice(["neg", "tanh", "cs_rank", "sign"]), p.expr), p.gates)
        if draw < 0.8:
            return Program(p.expr, (*p.gates, self._gate(known))[-GATES:])
        return Program(p.expr, p.gates[:-1]) if p.gates else Program(self._tree(known, 3))

    def propose(self, n: int, known: list[str], parents: list[Program] = ()) -> list[Program]:
        out: dict[str, Program] = {}
        for _ in range(50 * n):
            if len(out) == n:
                break
            if not parents or self.rng.random() < self.fresh:
                p = Program(self._tree(known, DEPTH), (self._gate(known),) if self.rng.random() < 0.2 else ())
            else:
                p = self._changed(self.rng.choice(list(parents)), known)
            try:
                validate(p, known)
            except InvalidProgram:
                continue
            out[p.identity] = p
        return list(out.values())


def parse_programs(text: str) -> list[Program]:
    """Programs of a JSON array; of a truncated array, those that are complete."""
    start, out, decoder = text.find("["), [], json.JSONDecoder()
    at = start + 1
    while 0 < at < len(text):
        while at < len(text) and text[at] in " \n\r\t,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        if isinstance(value, dict) and "expr" in value:
            out.append(Program.from_json(json.dumps({"expr": value["expr"], "gates": value.get("gates", [])})))
    return out
