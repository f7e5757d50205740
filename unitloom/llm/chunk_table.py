"""A table of distinct chunks, each tokenized once, that joins ids back by position."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np


class _Places(dict):
    """chunk -> place; an unknown chunk gets the next place and waits to be tokenized."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.waiting.append(chunk)
        return place


class ChunkTable:
    """``tokenize`` maps a list of chunks to their lists of ids; the table starts anew beyond ``most`` chunks."""

    def __init__(self, tokenize: Callable[[list[str]], Iterable[Iterable[int]]], most: int = 1_000_000):
        self.tokenize, self.most = tokenize, most
        self._clear()

    def _clear(self):
        self.places, self.flat, self.starts, self.sizes = _Places(), array("i"), array("q"), array("i")

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, given as their chunks, and the number of ids of each text."""
        if len(self.places) > self.most:
            self._clear()
        find = self.places.__getitem__
        places = [np.fromiter(map(find, chunks), dtype=np.int64, count=len(chunks)) for chunks in texts]
        if self.places.waiting:
            for ids in self.tokenize(self.places.waiting):
                self.starts.append(len(self.flat))
                self.flat.extend(ids)
                self.sizes.append(len(self.flat) - self.starts[-1])
            self.places.waiting.clear()
        # views, not copies; none outlives this call, as the arrays cannot grow while one does
        flat, starts, sizes = (np.frombuffer(part, part.typecode) if part else np.zeros(0, part.typecode) for part in (self.flat, self.starts, self.sizes))
        chunk = np.concatenate(places) if places else np.zeros(0, np.int64)
        count = sizes[chunk] if len(chunk) else np.zeros(0, np.int32)
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[chunk] - (ends - count), count) + np.arange(total) if total else np.zeros(0, np.int64)
        bounds = np.cumsum([len(p) for p in places], dtype=np.int64)
        upto = np.concatenate([[0], ends])[bounds] if len(bounds) else np.zeros(0, np.int64)
        return (flat[at] if total else np.zeros(0, np.int32)), np.diff(upto, prepend=0)
