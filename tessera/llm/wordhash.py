"""Word boundaries and word hashes of a text, computed on its bytes as arrays."""

from __future__ import annotations

import numpy as np

#: An odd base, so that powers can be divided out modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept and doubled when longer texts come."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers.get("up", ())), 1 << 12)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin, and where they end (exclusive)."""
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class Spans:
    """Hashes of any byte ranges of one text: a polynomial over prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])
