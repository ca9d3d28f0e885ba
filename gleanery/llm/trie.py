"""Double-array tries over word symbols, walked by all text positions at once."""

from __future__ import annotations

from collections import Counter

import numpy as np

RADIX = 128                 # a word is two steps, its number's quotient and remainder, so children lie close together
WINDOW, TRIES = 64, 4       # free places tried at once for a node's children, and how often


class Trie:
    """Phrases of one length under a root for each language.

    The child of state s by step c is t = base[s] + c where check[t] == s. State 0
    and the last place stay unused, so that places outside the arrays can be clipped.
    """

    def __init__(self, phrases: list[tuple[str, bytes]]):
        self.phrases = sorted(phrases)
        split = [p.split(b" ") for _, p in self.phrases]
        self.depth = len(split[0]) if split else 0
        common = Counter(w for words in split for w in words).most_common()
        self.symbol = {w: i + 1 for i, (w, _) in enumerate(common)}     # frequent words lie close together
        rows = np.array([[self.symbol[w] for w in words] for words in split], np.int32).reshape(len(split), self.depth)
        del split
        langs = sorted({lang for lang, _ in self.phrases})
        self.root = {lang: i + 1 for i, lang in enumerate(langs)}
        self.top = len(langs) + 1                                       # nothing lies here or beyond
        self.base = np.zeros(self.top + 1, np.int32)
        self.check = np.full(self.top + 1, -1, np.int32)
        self.check[: self.top] = -2
        state = np.array([self.root[lang] for lang, _ in self.phrases], np.int64)
        for level in range(self.depth):
            for step in steps(rows[:, level]):
                state = self._place(state, step)
        self.base, self.check = self.base[: self.top + 1].copy(), self.check[: self.top + 1].copy()
        self.leaf = state

    def _room(self, top: int) -> None:
        if top + 2 > len(self.check):
            more = max(top + 2, len(self.check) * 3 // 2) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _free(self, count: int) -> np.ndarray:
        """At least ``count`` free places, in order."""
        self._room(self.top + count)
        return np.flatnonzero(self.check[: self.top + count] == -1)

    def _place(self, parent: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Give every distinct (parent, step) a state; returns the state of each row."""
        width = int(step.max(initial=0)) + 1
        edges, row = np.unique(parent * width + step, return_inverse=True)
        parents, moves = edges // width, edges % width
        target = np.zeros(len(edges), np.int64)
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])) if len(edges) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(edges)))
        order = np.argsort(-sizes, kind="stable")
        many = int(np.count_nonzero(sizes > 1))
        for done, node in enumerate(order[:many]):
            if done % 500 == 0:
                free = self._free(WINDOW * TRIES)[-WINDOW * TRIES:]         # the least crowded places
            own = slice(starts[node], starts[node] + sizes[node])
            base = self._fit(moves[own], free)
            target[own] = base + moves[own]
            self.base[parents[starts[node]]] = base
            self.check[target[own]] = parents[starts[node]]
        single = starts[order[many:]]
        places = self._free(len(single))[: len(single)]
        target[single] = places
        self.base[parents[single]] = places - moves[single]
        self.check[places] = parents[single]
        if len(target):
            self.top = max(self.top, int(target.max()) + 1)
        return target[row.reshape(-1)]

    def _fit(self, moves: np.ndarray, free: np.ndarray) -> int:
        """A base that puts all children on free places."""
        for at in range(0, len(free), WINDOW):
            bases = free[at:at + WINDOW] - moves[0]
            self._room(int(bases[-1] + moves[-1]))
            good = (self.check[bases[:, None] + moves] == -1).all(axis=1)
            if good.any():
                base = int(bases[np.argmax(good)])
                self.top = max(self.top, base + int(moves[-1]) + 1)
                return base
        base = self.top - int(moves[0])
        self._room(base + int(moves[-1]))
        self.top = base + int(moves[-1]) + 1
        return base

    def symbols(self, words: list[bytes], codes: np.ndarray) -> np.ndarray:
        """Symbols of a text whose code k + 1 is words[k] and 0 a border; 0 for words of no phrase."""
        known = np.zeros(len(words) + 1, np.int32)
        known[1:] = [self.symbol.get(w, 0) for w in words]
        return known[codes]

    def walk(self, lang: str, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, accepting states): where a phrase starts; all positions advance level by level."""
        root = self.root.get(lang)
        if root is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        padded = np.concatenate([text, np.zeros(self.depth, text.dtype)])
        position = np.flatnonzero(text)
        state = np.full(len(position), root, np.int32)
        last = len(self.check) - 1
        for level in range(self.depth):
            symbol = padded[position + level]
            alive = symbol > 0
            position, state, symbol = position[alive], state[alive], symbol[alive]
            for side in (0, 1):
                child = np.clip(self.base[state] + steps(symbol)[side], 0, last)
                alive = self.check[child] == state
                position, state, symbol = position[alive], child[alive], symbol[alive]
        return position, state


def steps(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two moves of a symbol."""
    return (symbol - 1) // RADIX, (symbol - 1) % RADIX
