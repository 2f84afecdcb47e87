"""Probabilistic automata from example strings, by merging compatible prefix-tree states.

The examples form a prefix tree with counts.  First, from the start on, each
state joins the first compatible one that is as deep, so that a few examples
that differ from the first character on still add up.  Then states are taken in
order of their first example; one joins the first kept state that is compatible
with it, and is kept itself if there is none.  Whatever two joined states lead
to by one symbol is joined too.  Two states are compatible if their
frequencies, and those of all states behind the two, differ by no more than
Hoeffding's bound allows, and if the lengths of what is still to come differ by
no more than the bound for distributions (Dvoretzky, Kiefer, Wolfowitz) does.
So strings of one length give a chain of states that knows where it has to end,
and free lengths give loops.

Likelihoods are smoothed by the frequencies of symbols in all examples; a step
never seen leads where most steps from its state lead.
"""

from __future__ import annotations

import math
from collections import Counter

SYMBOLS = 67  # the characters of candidates, the end, and any other


class Automaton:
    """States with counts of arrivals, ends and steps; scores strings by mean log2 likelihood."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.step: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.end, self.seen = [0], [0]
        for text in sorted(examples):
            at = 0
            self.seen[0] += 1
            for c in text:
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.taken.append({})
                    self.end.append(0)
                    self.seen.append(0)
                at = self.step[at][c]
                self.seen[at] += 1
            self.end[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.rest = self._rests()
        self._merge()
        total = Counter()
        for taken in self.taken:
            total.update(taken)
        self.symbols, self.all = total, sum(self.seen)
        self.usual = [max(sorted(t), key=t.get) if t else None for t in self.taken]

    def _rests(self) -> list[dict[int, int]]:
        """Numbers of examples by how much of them is still to come, for each state; a child's number follows its parent's."""
        rest: list[dict[int, int]] = [{0: n} if n else {} for n in self.end]
        for at in range(len(self.step) - 1, -1, -1):
            for child in self.step[at].values():
                for k, n in rest[child].items():
                    rest[at][k + 1] = rest[at].get(k + 1, 0) + n
        return rest

    def _lengths_differ(self, a: int, b: int) -> bool:
        one, other, n1, n2, gap = self.rest[a], self.rest[b], self.seen[a], self.seen[b], 0.0
        most = self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        if most >= 1:
            return False
        for k in sorted(one.keys() | other.keys()):
            gap += one.get(k, 0) / n1 - other.get(k, 0) / n2
            if abs(gap) > most:
                return True
        return False

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _of(self, a: int) -> int:
        """The state that a has joined."""
        while self.joined[a] != a:
            self.joined[a] = a = self.joined[self.joined[a]]
        return a

    def _compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            a, b = pair = tuple(map(self._of, todo.pop()))
            if a == b or pair in met:
                continue
            met.add(pair)
            n1, n2 = self.seen[a], self.seen[b]
            if self._differ(self.end[a], n1, self.end[b], n2) or self._lengths_differ(a, b):
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if self._differ(self.taken[a].get(c, 0), n1, self.taken[b].get(c, 0), n2):
                    return False
                if c in self.step[a] and c in self.step[b]:
                    todo.append((self.step[a][c], self.step[b][c]))
        return True

    def _join(self, a: int, b: int) -> None:
        """b and all that both lead to by equal symbols join a and its successors."""
        todo = [(a, b)]
        while todo:
            a, b = map(self._of, todo.pop())
            if a == b:
                continue
            self.joined[b] = a
            self.seen[a] += self.seen[b]
            self.end[a] += self.end[b]
            for mine, other in ((self.rest[a], self.rest[b]), (self.taken[a], self.taken[b])):
                for k, n in other.items():
                    mine[k] = mine.get(k, 0) + n
            for c, state in self.step[b].items():
                if c in self.step[a]:
                    todo.append((self.step[a][c], state))
                else:
                    self.step[a][c] = state

    def _merge(self) -> None:
        self.joined = list(range(len(self.step)))
        layer = [0]
        while layer:
            kept: list[int] = []
            for state in layer:
                same = next((a for a in kept if self._of(state) != a and self._compatible(a, state)), None)
                if same is not None:
                    self._join(same, state)
                elif self._of(state) not in kept:
                    kept.append(self._of(state))
            layer = list(dict.fromkeys(self._of(self.step[a][c]) for a in kept for c in sorted(self.step[a])))
        kept = [0]
        known = {0}
        while True:
            edge = next((self._of(self.step[a][c]) for a in kept for c in sorted(self.step[a]) if self._of(self.step[a][c]) not in known), None)
            if edge is None:
                break
            same = next((a for a in kept if self._compatible(a, edge)), None)
            if same is None:
                kept.append(edge)
                known.add(edge)
            else:
                self._join(same, edge)
                kept = list(dict.fromkeys(map(self._of, kept)))
                known = set(kept)
        number = {a: i for i, a in enumerate(kept)}
        self.seen, self.end = [self.seen[a] for a in kept], [self.end[a] for a in kept]
        self.taken = [self.taken[a] for a in kept]
        self.step = [{c: number[self._of(b)] for c, b in self.step[a].items()} for a in kept]
        del self.rest, self.joined

    def score(self, text: str, weight: float = 4.0) -> float:
        """Mean log2 probability of the characters and the end; the symbols of all examples count ``weight`` in each state."""
        at, total, all_ = 0, 0.0, self.all + SYMBOLS
        for c in text:
            total += math.log2((self.taken[at].get(c, 0) + weight * (self.symbols[c] + 1) / all_) / (self.seen[at] + weight))
            at = self.step[at][c if c in self.step[at] else self.usual[at]] if self.usual[at] else 0
        total += math.log2((self.end[at] + weight * (sum(self.end) + 1) / all_) / (self.seen[at] + weight))
        return total / (len(text) + 1)

    def accepts(self, text: str) -> bool:
        """Whether every step has been seen, and an end behind the last."""
        at = 0
        for c in text:
            at = self.step[at].get(c, -1)
            if at < 0:
                return False
        return self.end[at] > 0
