"""Word lists of whole texts, at C speed and with exact ASCII rules.

All functions take UTF-8 ``bytes``: ``bytes.lower`` folds A-Z alone and ``bytes.split`` cuts
at 0x20 and 0x09-0x0D alone, which ``str`` methods do not.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z; 0-9, a-z and every byte of a non-ASCII character stay; all else is a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)
S33 = np.uint64(33)


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a null text has none."""
    return text.translate(ALNUM).split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; a shorter text is one run; no words, none."""
    if len(words) == 0:
        return words
    n = min(width, len(words))
    last = len(words) - n + 1
    h = np.full(last, n, np.uint64)
    for i in range(n):
        h = mix(h * STEP + words[i : i + last])
    return np.unique(h)
