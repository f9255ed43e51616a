"""64-bit hashes of all words of many texts at once, from prefix sums over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z; ASCII white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n, and their inverses, modulo 2 ** 64."""
    if n >= len(_powers[0]):
        _powers[0] = np.cumprod(np.full(n + 1, _BASE, np.uint64)) * np.uint64(_INVERSE)
        _powers[1] = np.cumprod(np.full(n + 1, _INVERSE, np.uint64)) * np.uint64(_BASE)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(sizes: list[int], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with about that size together."""
    first = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of anything but ASCII white space, A-Z lower-cased) of all texts, and each text's number of words."""
    raw = [t.encode() for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=sums[1:])
    edge = np.diff(SPACE[data].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    last = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return hashes, np.diff(np.searchsorted(starts, last), prepend=0)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at every place of one text; of all its words if they are fewer."""
    width = min(n, len(hashes))
    m = len(hashes) - width + 1
    out = np.full(m, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m])
    return out
