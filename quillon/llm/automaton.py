"""A generalised suffix automaton, of words or of bytes."""

from __future__ import annotations


class Automaton:
    """States of all runs of the sequences that were added; ``next`` by state and symbol, suffix ``link`` and longest ``len`` by state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def extend(self, last: int, symbol: int) -> int:
        """The state of the run that ends in ``last``, one symbol longer."""
        nxt, link, length = self.next, self.link, self.len
        if symbol in nxt[last]:
            q = nxt[last][symbol]
            return q if length[q] == length[last] + 1 else self._split(last, symbol, q)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p != -1:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
        return new

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A state of its own for the runs of q that are one longer than those of p."""
        nxt, link, length = self.next, self.link, self.len
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = clone
            p = link[p]
        return clone
