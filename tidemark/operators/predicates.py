"""A small predicate tree that becomes a Column, and travels as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
INVERSE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
SWAPPED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


class Predicate:
    """NULL operands never satisfy a comparison: three-valued logic keeps the same rows in a filter."""

    def column(self) -> Column:
        raise NotImplementedError

    def spec(self) -> dict:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return Junction("and", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Junction("or", (self, other))


@dataclass(frozen=True)
class Atom(Predicate):
    """column op literal."""

    name: str
    op: str
    value: Any

    def column(self) -> Column:
        return OPERATORS[self.op](F.col(self.name), F.lit(self.value))

    def inverted(self) -> Atom:
        return Atom(self.name, INVERSE[self.op], self.value)

    def spec(self) -> dict:
        return {"kind": "atom", "name": self.name, "op": self.op, "value": self.value}


@dataclass(frozen=True)
class JoinAtom(Predicate):
    """left column op right column."""

    left: str
    op: str
    right: str

    def column(self) -> Column:
        return OPERATORS[self.op](F.col(self.left), F.col(self.right))

    def swapped(self) -> JoinAtom:
        return JoinAtom(self.right, SWAPPED[self.op], self.left)

    def spec(self) -> dict:
        return {"kind": "join", "left": self.left, "op": self.op, "right": self.right}


@dataclass(frozen=True)
class Between(Predicate):
    """A range with each bound inclusive or strict; a missing bound is open."""

    name: str
    low: Any = None
    high: Any = None
    low_inclusive: bool = True
    high_inclusive: bool = True

    def column(self) -> Column:
        c, parts = F.col(self.name), []
        if self.low is not None:
            parts.append(c >= F.lit(self.low) if self.low_inclusive else c > F.lit(self.low))
        if self.high is not None:
            parts.append(c <= F.lit(self.high) if self.high_inclusive else c < F.lit(self.high))
        return reduce(lambda a, b: a & b, parts) if parts else c.isNotNull()

    def spec(self) -> dict:
        return {"kind": "between", "name": self.name, "low": self.low, "high": self.high, "low_inclusive": self.low_inclusive, "high_inclusive": self.high_inclusive}


@dataclass(frozen=True)
class Junction(Predicate):
    """and / or of any number of predicates; an empty one is its neutral element."""

    how: str
    parts: tuple[Predicate, ...]

    def column(self) -> Column:
        fold = (lambda a, b: a & b) if self.how == "and" else (lambda a, b: a | b)
        return reduce(fold, [p.column() for p in self.parts]) if self.parts else F.lit(self.how == "and")

    def spec(self) -> dict:
        return {"kind": self.how, "parts": [p.spec() for p in self.parts]}


def merge_ranges(atoms: list[Atom]) -> list[Predicate]:
    """Pairs of bounds on one column become one Between, the tightest of each side; the rest stays as it is."""
    out: list[Predicate] = []
    for name in dict.fromkeys(a.name for a in atoms):
        own = [a for a in atoms if a.name == name]
        lows = [(a.value, a.op == ">") for a in own if a.op in (">", ">=")]
        highs = [(a.value, a.op != "<") for a in own if a.op in ("<", "<=")]
        if lows and highs:
            (low, strict), (high, inclusive) = max(lows), min(highs)
            out.append(Between(name, low, high, not strict, inclusive))
            own = [a for a in own if a.op in ("=", "<>")]
        out += own
    return out


class Truth(Enum):
    """What is known of a predicate before any row is seen. ALWAYS_TRUE is for rows without NULLs in its columns."""

    UNKNOWN = "unknown"
    ALWAYS_TRUE = "always true"
    ALWAYS_FALSE = "always false"


def truth(p: Predicate) -> Truth:
    """From the predicate alone: empty ranges, bounds that no value meets, and what junctions make of their parts."""
    if isinstance(p, Between):
        if p.low is None and p.high is None:
            return Truth.ALWAYS_TRUE
        known = p.low is not None and p.high is not None
        empty = known and (p.low > p.high or (p.low == p.high and not (p.low_inclusive and p.high_inclusive)))
        return Truth.ALWAYS_FALSE if empty else Truth.UNKNOWN
    if not isinstance(p, Junction):
        return Truth.UNKNOWN
    stops, passes = (Truth.ALWAYS_FALSE, Truth.ALWAYS_TRUE) if p.how == "and" else (Truth.ALWAYS_TRUE, Truth.ALWAYS_FALSE)
    parts = [truth(x) for x in p.parts]
    if stops in parts or (p.how == "and" and _contradict([x for x in p.parts if isinstance(x, Atom)])):
        return stops
    return passes if all(x is passes for x in parts) else Truth.UNKNOWN


def _contradict(atoms: list[Atom]) -> bool:
    """Whether no row can meet all: two values for one column, a value outside the column's range, or an empty range."""
    for p in merge_ranges(atoms):
        if isinstance(p, Between) and truth(p) is Truth.ALWAYS_FALSE:
            return True
    values = [a for a in atoms if a.op == "="]
    return any(a.name == b.name and not OPERATORS[b.op](a.value, b.value) for a in values for b in atoms)


def to_json(p: Predicate) -> str:
    return json.dumps(p.spec())


def from_json(text: str) -> Predicate:
    def build(s: dict) -> Predicate:
        rest = {k: v for k, v in s.items() if k != "kind"}
        if s["kind"] in ("and", "or"):
            return Junction(s["kind"], tuple(build(x) for x in s["parts"]))
        return {"atom": Atom, "join": JoinAtom, "between": Between}[s["kind"]](**rest)

    return build(json.loads(text))
