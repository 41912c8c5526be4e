"""Weighted letter-to-letter transducers in the max-plus semiring: composition and best paths."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable


class Fst:
    """States are any hashable values; an arc reads one symbol, writes one and adds its weight."""

    def __init__(self, start, finals: Iterable | None = None):
        self.start, self.finals = start, None if finals is None else set(finals)  # None: all states are final
        self.arcs: dict = defaultdict(lambda: defaultdict(list))

    def add(self, state, read: str, write: str, to, weight: float = 0.0) -> None:
        self.arcs[state][read].append((write, weight, to))

    def is_final(self, state) -> bool:
        return self.finals is None or state in self.finals

    def __matmul__(self, other: Fst) -> Fst:
        """Composition: what this machine writes the other one reads; weights add up."""
        out = Fst((self.start, other.start), ())
        todo, seen = [out.start], {out.start}
        while todo:
            p, q = state = todo.pop()
            if self.is_final(p) and other.is_final(q):
                out.finals.add(state)
            for read, arcs in self.arcs[p].items():
                for middle, w, to in arcs:
                    for write, v, into in other.arcs[q].get(middle, ()):
                        out.add(state, read, write, (to, into), w + v)
                        if (to, into) not in seen:
                            seen.add((to, into))
                            todo.append((to, into))
        return out

    def best(self, text: Iterable[str]) -> tuple[float, tuple[str, ...]]:
        """Weight and output of the best accepting path; of equal weights the first arc added wins."""
        now = {self.start: (0.0, None)}
        for x in text:
            following: dict = {}
            for state, (w, path) in now.items():
                for write, v, to in self.arcs[state].get(x, ()):
                    if to not in following or w + v > following[to][0]:
                        following[to] = (w + v, (path, write))
            now = following
        ends = [v for s, v in now.items() if self.is_final(s)]
        if not ends:
            return float("-inf"), ()
        w, path = max(ends, key=lambda v: v[0])
        out = []
        while path is not None:
            path, write = path
            out.append(write)
        return w, tuple(reversed(out))
