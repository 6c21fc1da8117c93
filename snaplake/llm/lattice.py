"""Lattices of vocabulary pieces over many words at once, in NumPy.

A word of n characters has nodes 0..n; a piece that matches characters i..j-1 is an edge from i to j.  Pieces are found
by walking one trie from all positions together, a character at a time.
"""

from __future__ import annotations

import math

import numpy as np

#: Characters that the vocabulary lacks share a piece for each 128 code points, in so many classes.
BLOCKS = 256


class PieceTrie:
    """Trie over `pieces` and every character they hold; characters beyond these have a piece for their class, so every word has a path."""

    def __init__(self, pieces: list[str]):
        characters = sorted({ch for p in pieces for ch in p})
        self.pieces = [*characters, *sorted({p for p in pieces if len(p) > 1})]
        self.n_blocks = BLOCKS
        self.size = len(self.pieces) + self.n_blocks
        #: Character -> number of its own piece.
        self.column = {ch: i for i, ch in enumerate(characters)}
        children: dict[str, set[str]] = {}
        for p in self.pieces[len(characters) :]:
            for k in range(1, len(p)):
                children.setdefault(p[:k], set()).add(p[k])
        # states with children come first and have a row of the table; characters that only ever start a piece need no column in it
        self.inner = len(children)
        states = {p: i for i, p in enumerate(children)}
        used = sorted({ch for c in children.values() for ch in c})
        step = {ch: i for i, ch in enumerate(used)}
        self.next = np.full((self.inner, len(used) + 1), -1, np.int32)
        for p, following in children.items():
            for ch in following:
                self.next[states[p], step[ch]] = states.setdefault(p + ch, len(states))
        self.terminal = np.full(len(states), -1, np.int32)
        for i, p in enumerate(self.pieces):
            if p in states:
                self.terminal[states[p]] = i
        #: For each character's own piece: the state it leads to (-1: no longer piece begins so) and its column of the table.
        self.root = np.array([states.get(ch, -1) if ch in children else -1 for ch in characters] + [-1], np.int32)
        self.step = np.array([step.get(ch, len(used)) for ch in characters] + [len(used)], np.int32)
        self.longest = max(map(len, self.pieces), default=1)
        #: Piece -> number, for walks in plain Python.
        self.number: dict[str, int] = {}

    def own(self, ch: str) -> int:
        """Number of a character's own piece, or of its class's."""
        found = self.column.get(ch)
        return len(self.pieces) + (ord(ch) >> 7) % self.n_blocks if found is None else found

    def edges(self, words: list[str]) -> Lattice:
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(code, return_inverse=True)
        known = np.array([self.column.get(chr(x), len(self.root) - 1) for x in distinct.tolist()], np.int32)
        own = np.array([self.own(chr(x)) for x in distinct.tolist()], np.int32)[back]
        step, root = self.step[known][back], self.root[known][back]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        n = len(code)
        local = (np.arange(n) - (ends - lengths)[word]).astype(np.int32)
        left = lengths[word].astype(np.int32) - local
        at, state = np.arange(n, dtype=np.int32), root
        found_at, found_len, found_piece = [at], [np.ones(n, np.int32)], [own]
        for k in range(1, self.longest):
            ok = (state >= 0) & (state < self.inner)
            at, state = at[ok], state[ok]
            ok = left[at] > k
            at, state = at[ok], state[ok]
            if not len(at):
                break
            state = self.next[state, step[at + k]]
            hit = np.where(state >= 0, self.terminal[state], -1)
            where = hit >= 0
            found_at.append(at[where])
            found_len.append(np.full(int(where.sum()), k + 1, np.int32))
            found_piece.append(hit[where].astype(np.int32))
        at, size, piece = map(np.concatenate, (found_at, found_len, found_piece))
        start = at + word[at]  # every word has one node more than characters
        stop_local = local[at] + size
        by = np.lexsort((start + size, stop_local))
        numbers = np.arange(len(words))
        return Lattice(start[by], (start + size)[by], piece[by], stop_local[by], local[at][by], (ends - lengths) + numbers, ends + numbers)

    def long_word(self, word: str, p: np.ndarray) -> np.ndarray:
        """log of the summed probability of a word of any length under each column of p [pieces, columns].

        Values of the last `longest` nodes are held and scaled as the word is read, so neither memory nor range depend on its length.
        """
        if not self.number:
            self.number = {x: i for i, x in enumerate(self.pieces) if len(x) > 1}
        ring = [np.zeros(p.shape[1]) for _ in range(self.longest + 1)]
        ring[0] = np.ones(p.shape[1])
        log = np.zeros(p.shape[1])
        for j in range(1, len(word) + 1):
            total = ring[(j - 1) % len(ring)] * p[self.own(word[j - 1])]
            for size in range(2, min(j, self.longest) + 1):
                if (k := self.number.get(word[j - size : j])) is not None:
                    total = total + ring[(j - size) % len(ring)] * p[k]
            ring[j % len(ring)] = total
            if j % 16 == 0:
                scale = np.maximum.reduce(ring)
                for x in ring:
                    x /= scale
                log += np.log(scale)
        return log + np.log(ring[len(word) % len(ring)])


class Lattice:
    """Edges (start node, stop node, piece) sorted by the stop's place in its word; first and last node of each word."""

    def __init__(self, start, stop, piece, stop_local, start_local, first, last):
        self.start, self.stop, self.piece, self.start_local, self.first, self.last = start, stop, piece, start_local, first, last
        self.n_nodes = int(last[-1]) + 1 if len(last) else 0
        self.cuts = [*np.flatnonzero(np.diff(stop_local, prepend=-1)), len(start)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over all segmentations: value of each node for each column of p [pieces, columns]."""
        alpha = np.zeros((self.n_nodes, p.shape[1]))
        alpha[self.first] = 1.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            stop = self.stop[a:b]
            heads = np.flatnonzero(np.diff(stop, prepend=-1))
            alpha[stop[heads]] = np.add.reduceat(alpha[self.start[a:b]] * p[self.piece[a:b]], heads, axis=0)
        return alpha

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations, with words weighted; p has one column.  In logs, so words may be long."""
        q = np.log(p[:, 0])[self.piece]
        alpha, beta = np.full(self.n_nodes, -math.inf), np.full(self.n_nodes, -math.inf)
        alpha[self.first] = beta[self.last] = 0.0
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            stop = self.stop[a:b]
            heads = np.flatnonzero(np.diff(stop, prepend=-1))
            alpha[stop[heads]] = np.logaddexp.reduceat(alpha[self.start[a:b]] + q[a:b], heads)
        by = np.lexsort((self.start, -self.start_local))
        start, stop, q_by = self.start[by], self.stop[by], q[by]
        bounds = [*np.flatnonzero(np.diff(self.start_local[by], prepend=-1)), len(start)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            heads = np.flatnonzero(np.diff(start[a:b], prepend=-1))
            beta[start[a:b][heads]] = np.logaddexp.reduceat(beta[stop[a:b]] + q_by[a:b], heads)
        whole = np.repeat(np.log(weight) - alpha[self.last], self.last - self.first + 1)
        return np.bincount(self.piece, np.exp(alpha[self.start] + q + beta[self.stop] + whole[self.start]), minlength=len(p))
