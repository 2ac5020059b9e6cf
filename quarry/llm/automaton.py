"""A generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Recognises exactly the substrings of the sequences added to it. For each state: the length of its
    longest string, its suffix link and where that string first ended (a running number over all
    added symbols), so a match can be traced to the sequence it came from."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.end = [-1]
        self.size = 0

    def add(self, sequence: Iterable[Hashable]) -> None:
        nxt, link, length, end = self.next, self.link, self.length, self.end
        last, pos = 0, self.size
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:  # the string is known already, from an earlier sequence
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, c, q)
                pos += 1
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            end.append(pos)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur
            pos += 1
        self.size = pos

    def _split(self, p: int, c: Hashable, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.end.append(self.end[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, sequence: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each symbol."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        for c in sequence:
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                n = 0
            else:
                v = to
                n += 1
            yield v, n
