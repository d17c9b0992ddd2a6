"""SHA-256 over arrays of messages, with states that can be stored and resumed.

Messages are runs of digests as hex text, 64 bytes each: one block of the hash. So the state before
each digest is a chaining value of 32 bytes, and a finished message ends with one block of padding.
Digests are rows of eight 32-bit words, states columns of the same.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_MASK = (1 << 32) - 1
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: The first 32 bits of the fractions of the square roots, and of the cube roots, of the first primes.
START = np.array([isqrt(p << 64) & _MASK for p in _primes(8)], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & _MASK for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def _schedule(block: np.ndarray) -> np.ndarray:
    w = np.empty((64, block.shape[1]), np.uint32)
    w[:16] = block
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10)))
    return w


def _compress(state: np.ndarray, w: np.ndarray) -> np.ndarray:
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + (w[t] + _ROUND[t : t + 1])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_bytes(digests: np.ndarray) -> np.ndarray:
    """Each digest as 64 characters."""
    raw = np.ascontiguousarray(digests, ">u4").view(np.uint8).reshape(len(digests), 32)
    return _HEX[np.stack([raw >> 4, raw & 15], 2)].reshape(len(digests), 64)


def started(n: int) -> np.ndarray:
    """States of n messages before their first digest."""
    return np.repeat(START[:, None], n, 1)


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states after one more digest each."""
    blocks = np.ascontiguousarray(hex_bytes(digests)).view(">u4").astype(np.uint32)
    return _compress(state, _schedule(np.ascontiguousarray(blocks.T)))


def finish(state: np.ndarray, n: int) -> np.ndarray:
    """Digests of messages of n digests."""
    padding = np.zeros((16, 1), np.uint32)
    padding[0], padding[15] = 1 << 31, n * 512
    return _compress(state, _schedule(padding)).T


def unpack(raw: bytes) -> np.ndarray:
    """Digests or states from their bytes."""
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def pack(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests, ">u4").tobytes()
