"""Finite transducers over symbol strings, run in parallel.

A transducer is a table of next states and a table of outputs. A string is cut into chunks; a chunk is a function
from states to states. The functions of a string's chunks are composed by a parallel prefix scan, which gives each
chunk its entry state, and then all chunks of all strings run at once, one symbol per step.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np


class Transducer:
    """next: (states, symbols) table; out: same shape, 0/1; symbol *nop* leaves every state as it is."""

    def __init__(self, start: Hashable, symbols: int, step: Callable[[Hashable, int], tuple[Hashable, bool]]):
        """Compile: follow *step* from *start* over all symbols until no new state appears."""
        states = [start]
        number = {start: 0}
        rows: list[list[tuple[int, bool]]] = []
        while len(rows) < len(states):
            row = []
            for sym in range(symbols):
                to, out = step(states[len(rows)], sym)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append((number[to], out))
            rows.append(row)
        self.states = states
        self.symbols = symbols
        self.next = np.array([[to for to, _ in row] for row in rows], np.uint8)
        self.out = np.array([[out for _, out in row] for row in rows], bool)
        assert len(states) < 256

    def run(self, sym: np.ndarray, off: np.ndarray, nop: int = 0, chunk: int = 1024) -> np.ndarray:
        """Outputs for the strings sym[off[k]:off[k+1]], as a mask like *sym*; each string starts in state 0."""
        n = np.diff(off)
        out = np.zeros(len(sym), bool)
        if not len(sym):
            return out
        k = -(-n // chunk)  # chunks of each string
        first = np.cumsum(k) - k
        string = np.repeat(np.arange(len(n)), k)
        nth = np.arange(len(string)) - first[string]
        begin = off[:-1][string] + nth * chunk
        length = np.minimum(off[1:][string] - begin, chunk)
        entry = np.zeros(len(string), np.uint8)
        many = np.flatnonzero(k[string] > 1)
        if len(many):
            grid = self._grid(sym, begin[many], length[many], nop)
            f = self._functions(grid)
            entry[many] = self._entries(f, string[many])
        order = np.argsort(length, kind="stable")[::-1]  # long chunks first, so that short ones drop out of the tail
        grid = self._grid(sym, begin[order], length[order], nop)
        hit = np.zeros(grid.shape, bool)
        state = entry[order].astype(np.int32)
        left = np.searchsorted(-length[order], -np.arange(1, grid.shape[0] + 1), side="right")
        nxt, emit, width = self.next.ravel(), self.out.ravel(), self.symbols
        for j in range(grid.shape[0]):
            m = left[j]
            at = state[:m] * width + grid[j, :m]
            hit[j, :m] = emit[at]
            state[:m] = nxt[at]
        step, col = np.nonzero(hit)
        out[begin[order][col] + step] = True
        return out

    @staticmethod
    def _grid(sym: np.ndarray, begin: np.ndarray, length: np.ndarray, nop: int) -> np.ndarray:
        """Symbols of the chunks: one column per chunk, padded with *nop*."""
        most = int(length.max())
        at = begin[None, :] + np.arange(most)[:, None]
        inside = np.arange(most)[:, None] < length[None, :]
        return np.where(inside, sym[np.minimum(at, len(sym) - 1)], nop).astype(np.int32)

    def _functions(self, grid: np.ndarray) -> np.ndarray:
        """For each chunk the state it ends in from every state it may begin in."""
        s = len(self.states)
        f = np.repeat(np.arange(s, dtype=np.int32)[None, :], grid.shape[1], axis=0)
        nxt = self.next.ravel()
        for j in range(grid.shape[0]):
            f = nxt[f * self.symbols + grid[j][:, None]].astype(np.int32)
        return f

    @staticmethod
    def _entries(f: np.ndarray, string: np.ndarray) -> np.ndarray:
        """Exclusive prefix composition of the chunk functions inside each string, applied to state 0."""
        g = f.copy()
        gap = 1
        while True:
            can = np.flatnonzero(string[gap:] == string[:-gap]) + gap
            if not len(can):
                break
            g[can] = np.take_along_axis(g[can], g[can - gap], axis=1)  # first the earlier function, then the later
            gap *= 2
        entry = np.zeros(len(f), np.uint8)
        same = np.flatnonzero(string[1:] == string[:-1]) + 1
        entry[same] = g[same - 1, 0]
        return entry
