"""A suffix automaton over word hashes, for many short reference texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """All substrings of the texts added so far; states grow in proportion to the words added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, words: Iterable[int]) -> None:
        """Adds one text; its substrings do not run over into other texts."""
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the longest text of ``state`` followed by ``word``, parting it from ``target`` if needed."""
        want = self.length[state] + 1
        if self.length[target] == want:
            return target
        copy = len(self.next)
        self.next.append(self.next[target].copy())
        self.link.append(self.link[target])
        self.length.append(want)
        self.link[target] = copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def statistics(self, words: Iterable[int]) -> Iterator[int]:
        """For each word, the length of the longest match that ends with it."""
        state = size = 0
        forward, link, length = self.next, self.link, self.length
        for word in words:
            step = forward[state].get(word)
            while step is None and state:
                state = link[state]
                size = length[state]
                step = forward[state].get(word)
            if step is None:
                size = 0
            else:
                state = step
                size += 1
            yield size
