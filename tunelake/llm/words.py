"""Words of texts as 64-bit hashes, for the operators that count them in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

CHUNK_BYTES = 4 << 20
CACHE_WORDS = 300_000


class _Hashes(dict):
    """word -> hash; what was used since the last change stays."""

    older: dict = {}

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        h = self.older.get(word)
        self[word] = h = xxhash.xxh3_64_intdigest(word) if h is None else h
        return h


_HASHES = _Hashes()


def split_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case: bytes methods know ASCII letters
    and white space only, which is what a word is defined by."""
    return text.lower().split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def chunks(texts, size: int = CHUNK_BYTES):
    """Lists of texts of about ``size`` bytes together, at least one each."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t) if t else 0
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part
