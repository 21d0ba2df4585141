"""Workflow schemes: typed variables, operators, jobs, edges and forks, run step by step on the driver."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

OPERATORS: dict[str, Callable] = {
    "float=set": lambda a, b: float(a), "float=plus": lambda a, b: a + b, "float=minus": lambda a, b: a - b, "float=mult": lambda a, b: a * b, "float=divide": lambda a, b: a / b,
    "float=round": lambda a, b: math.copysign(math.floor(abs(a) + 0.5), a), "bool=set": lambda a, b: bool(a), "bool=and": lambda a, b: a and b, "bool=or": lambda a, b: a or b,
    "bool=not": lambda a, b: not a, "bool=gt": lambda a, b: a > b, "bool=lt": lambda a, b: a < b, "bool=ge": lambda a, b: a >= b, "bool=le": lambda a, b: a <= b, "bool=eq": lambda a, b: abs(a - b) < 1e-8,
    "string=set": lambda a, b: str(a), "string=join": lambda a, b: f"{a}{b}", "string=before_first": lambda a, b: a.split(b)[0], "string=after_first": lambda a, b: a.split(b, 1)[-1],
    "string=before_last": lambda a, b: a.rsplit(b, 1)[0], "string=after_last": lambda a, b: a.rsplit(b, 1)[-1],
    "string=nth_word": lambda a, b: (lambda w, n: w[n - 1 if n > 0 else n] if n and -len(w) <= n <= len(w) else "undefined")(a.split(","), int(b)),
    "float=count_words": lambda a, b: 0.0 if a == "undefined" else float(len(a.split(","))),
}


@dataclass
class Scheme:
    """Edges are (from, to, fork variable or None, to if true). Jobs and own operators are callables of the scheme.

    Of several edges out of a node the last one counts.
    """

    variables: dict[str, object]
    operators: dict[str, tuple[str, str, str | None, str | None]] = field(default_factory=dict)  # name -> (type, output, input1, input2)
    jobs: dict[str, Callable[[Scheme], None]] = field(default_factory=dict)
    edges: list[tuple[str, str, str | None, str | None]] = field(default_factory=list)
    effects: dict[str, Callable[[Scheme], None]] = field(default_factory=dict)
    current: str | None = None

    def __post_init__(self):
        self.start = dict(self.variables)

    def reset(self) -> None:
        self.variables = dict(self.start)

    def value(self, name: str | None):
        return self.variables.get(name, name) if name is not None else None

    def perform(self, name: str) -> None:
        kind, out, a, b = self.operators[name]
        if kind in self.effects:
            self.effects[kind](self)
        elif kind == "wait":
            time.sleep(max(0.0, float(self.value(a))))
        elif kind in OPERATORS:
            self.variables[out] = OPERATORS[kind](self.value(a), self.value(b))
        else:
            raise ValueError(f"{name}: no operator {kind}")

    def following(self, node: str) -> str | None:
        to = None
        for a, b, fork, if_true in self.edges:
            if a == node:
                to = if_true if fork and self.variables[fork] else b
        return to

    def run(self, start: str, most_steps: int = 10_000) -> list[str]:
        """The nodes passed, until one has no edge or is called EXIT."""
        self.current, passed = start, []
        while self.current and self.current != "EXIT" and len(passed) < most_steps:
            passed.append(self.current)
            if self.current in self.operators:
                self.perform(self.current)
            elif self.current in self.jobs:
                self.jobs[self.current](self)
            self.current = self.following(self.current)
        return passed
