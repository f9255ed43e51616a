"""A static range asymmetric numeral system over token ids.

One frequency table is shared by all blocks. A block interleaves LANES states:
token i belongs to lane i mod LANES, and all lanes advance one token a step, so
numpy codes a step of all lanes at once. Blocks are independent of each other;
inside a block, a checkpoint (all states and the place in the word stream)
stands before every CHECKPOINT steps, so that stretches decode in parallel too.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PRECISION = 20
LANES = 512
CHECKPOINT = 128
LOW = np.uint64(1 << 31)
MAGIC = b"RNB1"
_HEAD = struct.Struct("<4sIIII")
_U32, _PREC, _MASK = np.uint64(32), np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** PRECISION, at least 1 where counts is over 0."""
    counts = counts.astype(np.float64)
    if not counts.any():
        return np.zeros(len(counts), np.uint32)
    goal = 1 << PRECISION
    if np.count_nonzero(counts) > goal:
        raise ValueError(f"more than {goal} symbols")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (goal / counts.sum()))), 0).astype(np.int64)
    order, left = np.argsort(-f, kind="stable"), goal - int(f.sum())
    if left > 0:
        f[order[0]] += left
    for i in order:  # the largest give what the least were raised by
        if left >= 0:
            break
        give = min(-left, int(f[i]) // 2)
        f[i] -= give
        left += give
    return f.astype(np.uint32)


class Table:
    def __init__(self, freqs: np.ndarray):
        self.f = freqs.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A block: header, checkpoints, words, and the CRC-32 of all before it."""
    n = len(ids)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
    states: list[np.ndarray] = []
    f_all, c_all = table.f[ids], table.c[ids]
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        f, c, y = f_all[a:b], c_all[a:b], x[: b - a]
        out = y >= (f << np.uint64(63 - PRECISION))
        if out.any():
            words[t] = y[out].astype(np.uint32)
            y = np.where(out, y >> _U32, y)
        q = y // f
        x[: b - a] = (q << _PREC) + (y - q * f) + c
        if t % CHECKPOINT == 0:
            states.append(x.copy())
    states.reverse()
    ends = np.cumsum([0, *map(len, words)])[: max(steps, 0) : CHECKPOINT] if steps else np.empty(0)
    stream = np.concatenate(words) if words else np.empty(0, np.uint32)
    body = b"".join([_HEAD.pack(MAGIC, n, LANES, len(states), len(stream)), ends.astype("<u4").tobytes(), *(s.astype("<u8").tobytes() for s in states), stream.astype("<u4").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the stretches first to last (not included) of a block; all by default. ValueError if the checksum fails."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("block checksum")
    magic, n, lanes, marks, n_words = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = _HEAD.size
    ends = np.frombuffer(block, "<u4", marks, at)
    states = np.frombuffer(block, "<u8", marks * lanes, at + 4 * marks).reshape(marks, lanes)
    words = np.frombuffer(block, "<u4", n_words, at + 4 * marks + 8 * marks * lanes).astype(np.uint64)
    last = marks if last is None else min(last, marks)
    begin, stop = min(n, first * CHECKPOINT * lanes), min(n, last * CHECKPOINT * lanes)
    out = np.empty(max(0, stop - begin), np.uint32)
    for k in range(first, last):
        x, w = states[k].astype(np.uint64), int(ends[k])
        for t in range(k * CHECKPOINT, min((k + 1) * CHECKPOINT, -(-n // lanes))):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            y = x[: b - a]
            slot = y & _MASK
            s = table.slots[slot]
            out[a - begin : b - begin] = s
            y = table.f[s] * (y >> _PREC) + slot - table.c[s]
            more = np.flatnonzero(y < LOW)
            if len(more):
                y[more] = (y[more] << _U32) | words[w : w + len(more)]
                w += len(more)
            x[: b - a] = y
    return out
