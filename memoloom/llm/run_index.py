"""Run-length compressed Burrows-Wheeler index of many short texts, and matching statistics streamed against it.

The index keeps the runs of the transform (character, start, how many such characters come before) and the suffix
positions at both ends of every run. A stream goes through its text from the right. While the character equals that of the
current run, the last-to-first step keeps the match; else it moves to the nearest run end of that character above or
below, whichever shares more with the current match, which the sampled positions tell. All texts of a batch advance
together.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 7  # nine bits each
_LIMITS = np.array([1 << 9 * k for k in range(_SYMBOLS)], np.uint64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Characters from 1 on, each text closed by 0; the place of each closing 0."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes) - 1
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    text[ends] = 0
    return text, ends


class RunIndex:
    def __init__(self, texts: list[bytes]):
        text, ends = joined(texts)
        n = len(text)
        self.size = n
        rest = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # characters before the closing 0
        self.words = np.zeros(n, np.uint64)
        for k in range(_SYMBOLS):
            symbol = np.zeros(n, np.uint64)
            symbol[: max(n - k, 0)] = text[k:]
            symbol[rest < k] = 0
            self.words |= symbol << np.uint64(9 * (_SYMBOLS - 1 - k))
        order = self._suffixes(rest)
        before = text[order - 1]
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        tails = np.r_[heads[1:], n] - 1
        self.start, self.char = heads, before[heads].astype(np.int64)
        self.first, self.last = order[heads], order[tails]
        by_char = np.lexsort((np.arange(len(heads)), self.char))
        self.keys = self.char[by_char] * len(heads) + by_char
        sizes = (tails - heads + 1)[by_char]
        earlier = np.cumsum(sizes) - sizes  # smaller characters, and the same one in earlier runs
        self.target = np.empty(len(heads), np.int64)
        self.target[by_char] = earlier
        self.end = tails

    def _suffixes(self, rest: np.ndarray) -> np.ndarray:
        """Suffixes in order, each up to its closing 0, equal ones by place."""
        n = len(rest)
        rank = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        reach, longest = _SYMBOLS, int(rest.max()) + 1
        while reach < longest:
            following = np.zeros(n, np.int64)
            following[: n - reach] = rank[reach:] + 1
            following[rest < reach] = 0
            pairs = rank * (n + 1) + following
            known = int(rank.max())
            rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            reach *= 2
            if int(rank.max()) == n - 1 or (int(rank.max()) == known and reach >= longest):
                break
        return np.argsort(rank, kind="stable")

    def _common(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Characters that the text shares from places i and j on, up to a limit each."""
        common = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        while len(live):
            a, b = i[live] + common[live], j[live] + common[live]
            inside = (a < self.size) & (b < self.size)
            live, a, b = live[inside], a[inside], b[inside]
            same = _SYMBOLS - np.searchsorted(_LIMITS, self.words[a] ^ self.words[b], "right")
            common[live] += same
            live = live[(same == _SYMBOLS) & (common[live] < limit[live])]
        return np.minimum(common, limit)

    def matches(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(statistics, ends): for every character of the joined texts the length of the longest match that starts there."""
        stream, ends = joined(texts)
        starts = np.r_[0, ends[:-1] + 1]
        out = np.zeros(len(stream), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that the running ones are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        many = len(texts)
        row, place, length = np.zeros(many, np.int64), np.full(many, self.first[0]), np.zeros(many, np.int64)
        runs = len(self.start)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.searchsorted(-lengths, -back, "right")
            at = starts[:live] + lengths[:live] - back
            char = stream[at].astype(np.int64)
            run = np.searchsorted(self.start, row[:live], "right") - 1
            odd = np.flatnonzero(self.char[run] != char)
            lost = odd[:0]
            if len(odd):
                key = np.searchsorted(self.keys, char[odd] * runs + run[odd])
                above = self.keys[np.maximum(key - 1, 0)]
                below = self.keys[np.minimum(key, runs - 1)]
                has_above = (key > 0) & (above // runs == char[odd])
                has_below = (key < runs) & (below // runs == char[odd])
                above, below = above % runs, below % runs
                here, limit = place[odd], length[odd]
                up = np.where(has_above, self._common(here, self.last[above], limit), -1)
                down = np.where(has_below, self._common(here, self.first[below], limit), -1)
                upward = up >= down
                run[odd] = np.where(upward, above, below)
                row[odd] = np.where(upward, self.end[above], self.start[below])
                place[odd] = np.where(upward, self.last[above], self.first[below])
                length[odd] = np.maximum(up, down)
                lost = odd[(up < 0) & (down < 0)]
            row[:live] = self.target[run] + row[:live] - self.start[run]
            place[:live] -= 1
            length[:live] += 1
            if len(lost):  # a character that the index does not have
                row[lost], place[lost], length[lost] = 0, self.first[0], 0
            out[at] = length[:live]
        return out, ends
