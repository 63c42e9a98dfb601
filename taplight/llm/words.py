"""Words of texts and their hashes, as arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from taplight.llm.common import holds_tables

#: Words whose hash a worker keeps.
KEPT_WORDS = 300_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_hashes: dict[bytes, int] = {}


def words_of(text: str) -> list[str]:
    """What stands between ASCII white space, unchanged."""
    return _WORD.findall(text)


def split_words(text: bytes) -> list[bytes]:
    """``words_of`` a text in UTF-8: splitting bytes knows ASCII white space alone."""
    return text.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; those of common words are kept by the worker."""
    holds_tables("words", _hashes.clear)
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    known = _hashes
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
