"""Weighted finite-state transducers: arcs, composition, and the weight of a sequence.

Weights multiply along a path and add over paths. A machine reads symbols, writes one symbol
for each, and accepts in states with a final weight. ``compose`` feeds what one machine writes
to another; the result is a machine again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable
from dataclasses import dataclass

State = Hashable
#: (next state, symbol written, weight)
Arc = tuple[State, str, float]


@dataclass
class Machine:
    start: State
    arcs: dict[tuple[State, str], list[Arc]]
    final: dict[State, float]

    def weight(self, sequence: Iterable[list[tuple[str, float]]]) -> float:
        """Sum over all accepting paths; each place of the sequence offers symbols with weights of their own."""
        now: dict[State, float] = {self.start: 1.0}
        for offers in sequence:
            after: dict[State, float] = defaultdict(float)
            for state, value in now.items():
                for symbol, own in offers:
                    for to, _, weight in self.arcs.get((state, symbol), ()):
                        after[to] += value * own * weight
            now = after
        return sum(value * self.final.get(state, 0.0) for state, value in now.items())


def compose(a: Machine, b: Machine) -> Machine:
    """a, then b on what a writes; only pairs of states that can be reached. States are numbered."""
    by_state: dict[State, list[tuple[str, Arc]]] = defaultdict(list)
    for (state, symbol), arcs in a.arcs.items():
        by_state[state] += [(symbol, arc) for arc in arcs]
    number = {(a.start, b.start): 0}
    todo, arcs, final = [(a.start, b.start)], defaultdict(list), {}
    for pair in todo:
        x, y = pair
        if x in a.final and y in b.final:
            final[number[pair]] = a.final[x] * b.final[y]
        for symbol, (to, written, weight) in by_state[x]:
            for then, out, more in b.arcs.get((y, written), ()):
                if (to, then) not in number:
                    number[to, then] = len(number)
                    todo.append((to, then))
                arcs[number[pair], symbol].append((number[to, then], out, weight * more))
    return Machine(0, dict(arcs), final)


def copies(states: Iterable[State], symbols: Iterable[str]) -> dict[tuple[State, str], list[Arc]]:
    """Arcs that write what they read and stay where they are."""
    return {(s, x): [(s, x, 1.0)] for s in states for x in symbols}
