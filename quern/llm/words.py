"""Words of texts as arrays of 64-bit hashes, for operators that work in numpy.

Texts are handled as UTF-8 bytes: lower-casing bytes changes A-Z alone, and all bytes of other than
ASCII characters are above 0x7F, so they stay within words.
"""

from __future__ import annotations

import numpy as np
import xxhash

KEPT_WORDS = 400_000

_M = np.uint64(0x9E3779B97F4A7C15)
# A-Z to a-z; digits, letters and bytes above 0x7F as they are; all else to a space
_ALNUM = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class Hasher(dict):
    """Word to 64-bit hash; a bounded table of each worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


hashes = Hasher()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def by_space(text: str) -> list[bytes]:
    """Runs of characters other than x20 and x09 to x0D, A-Z lower-cased."""
    return utf8(text).lower().split()


def by_alnum(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return utf8(text).translate(_ALNUM).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` word hashes; none where there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _M + mix(words[i : i + n] + np.uint64(i + 1))
        return mix(h)
