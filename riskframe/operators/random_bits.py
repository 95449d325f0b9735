"""The random numbers of Spark's samplers, for whole arrays of rows at a time.

Spark's sampler advances a 64-bit xor-shift state; a step is linear over bits,
so any number of steps is one 64 x 64 bit matrix. Tables of its powers of two
(by byte) take a state to any row at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_MASK = (1 << 64) - 1
_U = np.uint64
#: Numbers a lane draws one after the other; lanes advance together.
LANE = 16


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << _U(21))
    s ^= s >> _U(35)
    s ^= s << _U(4)
    return s


def _step_int(s: int) -> int:
    s ^= (s << 21) & _MASK
    s ^= s >> 35
    return s ^ ((s << 4) & _MASK)


@cache
def _jump(power: int) -> np.ndarray:
    """Tables (byte of the state x its value) of 2 ** power steps."""
    units = _U(1) << np.arange(64, dtype=np.uint64)
    ends = _step(units) if power == 0 else _jumped(_jumped(units, power - 1), power - 1)
    out = np.zeros((8, 256), dtype=np.uint64)
    for bit in range(64):
        byte, low = divmod(bit, 8)
        has = (np.arange(256) >> low) & 1 == 1
        out[byte, has] ^= ends[bit]
    return out


def _jumped(s: np.ndarray, power: int) -> np.ndarray:
    """States 2 ** power steps later."""
    t = _jump(power)
    out = t[0][(s & _U(255)).astype(np.int64)]
    for byte in range(1, 8):
        out = out ^ t[byte][((s >> _U(8 * byte)) & _U(255)).astype(np.int64)]
    return out


def _murmur3(data: bytes, seed: int) -> int:
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = seed & 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = (rot(h ^ (rot(k, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


class XorShift:
    """Spark's ``XORShiftRandom``."""

    def __init__(self, state: int):
        self.state = state

    @classmethod
    def of(cls, seed: int) -> XorShift:
        data = (seed & _MASK).to_bytes(8, "big")
        low = _murmur3(data, 0x3C074A61)
        return cls(_murmur3(data, low) << 32 | low)

    def _next(self, bits: int) -> int:
        self.state = _step_int(self.state)
        return self.state & ((1 << bits) - 1)

    def next_int(self) -> int:
        x = self._next(32)
        return x - (1 << 32) if x >> 31 else x

    def next_double(self) -> float:
        return ((self._next(26) << 27) + self._next(27)) * 2.0 ** -53

    def skipped(self, steps: int) -> XorShift:
        """The generator ``steps`` states later."""
        s = np.array([self.state], dtype=np.uint64)
        for power in range(steps.bit_length()):
            if steps >> power & 1:
                s = _jumped(s, power)
        return XorShift(int(s[0]))

    def doubles(self, n: int) -> np.ndarray:
        """The next ``n`` of ``next_double``."""
        lanes = -(-n // LANE)
        s = np.array([self.state], dtype=np.uint64)
        power = (2 * LANE).bit_length() - 1
        while len(s) < lanes:
            s = np.concatenate([s, _jumped(s, power)])
            power += 1
        s = s[:lanes]
        out = np.empty((LANE, lanes))
        for i in range(LANE):
            s = _step(s)
            high = (s & _U((1 << 26) - 1)) << _U(27)
            s = _step(s)
            out[i] = (high + (s & _U((1 << 27) - 1))).astype(np.float64) * 2.0 ** -53
        self.state = self.skipped(2 * n).state
        return out.T.reshape(-1)[:n]


class JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.state >> (48 - bits)
        return x - (1 << bits) if x >> (bits - 1) else x

    def next_long(self) -> int:
        x = ((self._next(32) << 32) + self._next(32)) & _MASK
        return x - (1 << 64) if x >> 63 else x
