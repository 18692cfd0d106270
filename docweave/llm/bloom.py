"""Scalable Bloom filters: a chain of layers that grows with its history."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np


class BloomLayer:
    """One filter of fixed size; full when half of its bits are set."""

    def __init__(self, capacity: int, error: float):
        self.capacity, self.error = int(capacity), float(error)
        self.n_hashes = max(1, math.ceil(-math.log2(error)))
        self.n_bits = max(64, math.ceil(capacity * self.n_hashes / math.log(2)))
        self.bits = np.zeros((self.n_bits + 7) // 8, np.uint8)
        self.count = self.n_set = 0

    @property
    def fill(self) -> float:
        return self.n_set / self.n_bits

    @property
    def full(self) -> bool:
        return self.count >= self.capacity or self.fill >= 0.5

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            steps = h1[:, None] + np.arange(self.n_hashes, dtype=np.uint64) * (h2 | np.uint64(1))[:, None]
        return steps % np.uint64(self.n_bits)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        places = self._places(h1, h2)
        byte = self.bits[places >> np.uint64(3)]
        return ((byte >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        places = np.unique(self._places(h1, h2))
        byte, mask = places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)
        self.n_set += int(((self.bits[byte] & mask) == 0).sum())
        np.bitwise_or.at(self.bits, byte, mask)
        self.count += len(h1)


class BloomChain:
    """Layers of geometrically growing size and shrinking error.

    Layer ``i`` holds ``capacity * growth**i`` keys at the error
    ``bound * (1 - tightening) * tightening**i``; a new layer starts when the
    last one is full. However long the history gets, the chance that a key
    never added is taken for a known one stays below ``bound``.
    """

    def __init__(self, capacity: int = 4096, bound: float = 1e-3, growth: int = 2, tightening: float = 0.5):
        self.capacity, self.bound, self.growth, self.tightening = capacity, bound, growth, tightening
        self.layers: list[BloomLayer] = []

    def _grow(self) -> BloomLayer:
        i = len(self.layers)
        layer = BloomLayer(self.capacity * self.growth**i, self.bound * (1 - self.tightening) * self.tightening**i)
        self.layers.append(layer)
        return layer

    @property
    def compounded_error(self) -> float:
        """Bound over the layers so far, each taken as full."""
        return 1 - math.prod(1 - x.error for x in self.layers)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for layer in reversed(self.layers):
            rest = np.flatnonzero(~found)
            if not len(rest):
                break
            found[rest] = layer.contains(h1[rest], h2[rest])
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = 0
        while at < len(h1):
            layer = self.layers[-1] if self.layers else self._grow()
            if layer.full:
                layer = self._grow()
            take = max(1, min(len(h1) - at, layer.capacity - layer.count))
            layer.add(h1[at : at + take], h2[at : at + take])
            at += take

    def pieces(self, size: int = 1 << 22) -> Iterator[dict]:
        """The state in rows of at most ``size`` bytes."""
        for no, x in enumerate(self.layers):
            data = x.bits.tobytes()
            for piece, at in enumerate(range(0, len(data), size)):
                yield {"layer": no, "piece": piece, "capacity": x.capacity, "error": x.error, "n_keys": x.count, "n_set": x.n_set, "bits": data[at : at + size]}

    def restore(self, layer: int, piece: int, capacity: int, error: float, n_keys: int, n_set: int, bits: bytes, size: int = 1 << 22) -> None:
        """Take in one piece; all pieces have to come before the next use."""
        while len(self.layers) <= layer:
            self.layers.append(BloomLayer(capacity, error))
        x = self.layers[layer]
        if (x.capacity, x.error) != (capacity, error):
            x = self.layers[layer] = BloomLayer(capacity, error)
        x.count, x.n_set = n_keys, n_set
        at = piece * size
        x.bits[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
