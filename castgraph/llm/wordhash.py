"""Vectorised text primitives: character classes, and 64-bit hashes of many substrings at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from castgraph.functions.hashing import mix, substring_hashes

__all__ = ["mix", "substring_hashes", "token_classes", "word_classes"]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The White_Space property of Unicode. Fixed values.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _categories() -> np.ndarray:
    return np.array([unicodedata.category(chr(i)) for i in range(0x110000)], "U2")


@lru_cache(1)
def token_classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    major = _categories().astype("U1")
    out = np.zeros(0x110000, np.uint8)
    out[major == "L"], out[major == "N"] = LETTER, NUMBER
    out[WHITE] = SPACE
    return out


@lru_cache(1)
def word_classes() -> np.ndarray:
    """2: dropped (combining mark, invisible format); 1: letter or digit; 0: other."""
    out = np.array([chr(i).isalnum() for i in range(0x110000)], bool).astype(np.uint8)
    out[np.isin(_categories(), ["Mn", "Cf"])] = 2
    return out
