"""Suffix automaton of a set of strings, with the strings that are suffixes of what has been read."""

from __future__ import annotations

from array import array
from collections.abc import Iterable


class SuffixAutomaton:
    """Its states are classes of substrings of the strings; after reading a text it is in the state of the longest suffix that is one.

    ``step`` has the next state by ``state << 8 | byte``. ``links`` leads to the state of the longest shorter suffix in another class (-1 from the start),
    ``longest`` is the length of a state's longest substring. ``ends`` has, of each state, the strings that are suffixes of that one,
    longest first, as (length, value); those that are longer than the suffix read are not met.
    """

    def __init__(self, strings: Iterable[tuple[bytes, int]]):
        step: dict[int, int] = {}
        out = [bytearray()]
        links, longest = array("i", [-1]), array("i", [0])

        def state(length: int, link: int, edges: bytearray) -> int:
            links.append(link)
            longest.append(length)
            out.append(edges)
            return len(links) - 1

        def cloned(p: int, c: int, q: int) -> int:
            """The state of the shorter substrings of q, which those of p lead to by c."""
            made = state(longest[p] + 1, links[q], bytearray(out[q]))
            for e in out[q]:
                step[made << 8 | e] = step[q << 8 | e]
            links[q] = made
            while p >= 0 and step.get(p << 8 | c) == q:
                step[p << 8 | c] = made
                p = links[p]
            return made

        ends: dict[int, list[tuple[int, int]]] = {}
        last_of: list[tuple[int, bytes, int]] = []
        for text, value in strings:
            last = 0
            for c in text:
                q = step.get(last << 8 | c)
                if q is not None:
                    last = q if longest[q] == longest[last] + 1 else cloned(last, c, q)
                    continue
                made, p = state(longest[last] + 1, 0, bytearray()), last
                while p >= 0 and (p << 8 | c) not in step:
                    step[p << 8 | c] = made
                    out[p].append(c)
                    p = links[p]
                if p >= 0:
                    q = step[p << 8 | c]
                    links[made] = q if longest[q] == longest[p] + 1 else cloned(p, c, q)
                last = made
            last_of.append((len(text), text, value))
        for length, text, value in last_of:  # states may have been cloned since
            at = 0
            for c in text:
                at = step[at << 8 | c]
            ends.setdefault(at, []).append((length, value))
        self.step, self.links, self.longest = step, links, longest
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(links)
        for s in sorted(range(1, len(links)), key=longest.__getitem__):
            above = self.ends[links[s]]
            self.ends[s] = (*sorted(ends[s], reverse=True), *above) if s in ends else above
