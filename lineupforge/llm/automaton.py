"""Suffix automata over words."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of several word sequences, with the number of places at which each starts.

    A state stands for the substrings that end at the same places; link is the state of its longest proper suffix that
    ends elsewhere too, length that of its longest substring."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of what p and word make, when q also stands for longer substrings."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words, times: int = 1) -> None:
        """Adds a sequence that occurs so often. Counts hold after finish()."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Passes counts on to suffixes, longest first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, words, window: int, least: int = 1) -> list[int]:
        """Starts of the windows of a streamed sequence that occur at least so often here: the matching statistic (the
        longest suffix read so far that occurs) reaches the window's length in a state of that count."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] >= least:
                out.append(i - window + 1)
        return out
