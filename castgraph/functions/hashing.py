"""64-bit hashes of many substrings at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PRIME = np.uint64((1 << 31) - 1)
BASES = ((0x2545F491, 0x1B873593), (0x5851F42D, 0x4C957F2D))  # two of each hash, modulo PRIME
_31 = np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _fold(x: np.ndarray) -> np.ndarray:
    """The same residue modulo PRIME, smaller."""
    return (x & PRIME) + (x >> _31)


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, k = base % int(PRIME), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(step) % PRIME
        step, k = step * step % int(PRIME), 2 * k
    return out


@lru_cache(4)
def _letters(k: int, j: int) -> np.ndarray:
    """A number below PRIME for each code point."""
    with np.errstate(over="ignore"):
        return (mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x1234567 * (k + 1))) >> np.uint64(32 * j)) & PRIME


def substring_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """Hash of codes[s:e] for each pair; codes are bytes or code points; k: one of two independent hashes.

    Two polynomials modulo a prime, read off prefix sums: no family of strings collides whatever the base, as with powers of two.
    """
    n = 1 << max(10, int(len(codes)).bit_length())
    with np.errstate(over="ignore"):
        out = mix((ends - starts).astype(np.uint64))
        for j, base in enumerate(BASES[k]):
            part = _letters(k, j)[codes]
            part *= _powers(base, n)[: len(codes)]
            high = part >> _31
            part &= PRIME
            part += high
            prefix = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(part, out=prefix[1:])
            d = _fold(_fold(prefix[ends] - prefix[starts]))
            d = _fold(_fold(_fold(d * _powers(pow(base, -1, int(PRIME)), n)[starts])))
            d[d >= PRIME] -= PRIME
            out = mix(out ^ d)
        return out
