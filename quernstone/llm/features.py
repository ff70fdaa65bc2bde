"""Features of texts, as sets of hashed numbers."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

#: Buckets of words, and as many of their starts; what follows them are levels of shape features.
WORDS = 1 << 18
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPACED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
LEVELS = 12
#: The checksum that those of words' starts go on from.
START = zlib.crc32(b"^")


MARKS, SPACES = np.zeros(256, bool), np.zeros(256, bool)
MARKS[list(PUNCTUATION)] = True
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: The numbers of text_ids() are below this, those of meta_ids() below WORDS.
TEXT_IDS = 2 * WORDS + LEVELS * (len(PUNCTUATION) + 9)


def levels(shares: np.ndarray) -> np.ndarray:
    """0 for none, then by powers of two."""
    power = np.floor(np.log2(np.maximum(shares, 1e-300)) + LEVELS)
    return np.where(shares <= 0, 0, np.clip(power, 1, LEVELS - 1)).astype(np.int64)


def words_of(text: bytes) -> set[bytes]:
    return set(text.lower().translate(SPACED).split())


def numbers(words: set[bytes], buckets: int, start: int = 0) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(w, start) for w in words), np.int64, len(words)) % buckets)


def word_ids(text: bytes, buckets: int = WORDS) -> np.ndarray:
    """Distinct buckets of a text's lower-cased words."""
    return numbers(words_of(text), buckets)


def shape_ids(text: bytes) -> np.ndarray:
    """Levels of the shares of each mark, of capitals, digits and line ends, of repeated words and lines, and of lengths."""
    n = len(text)
    each = np.frombuffer(text, np.uint8)
    seen = np.bincount(each, minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum()
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    marked = np.count_nonzero(MARKS[each] & np.append(SPACES[each[1:]], True)) if n else 0
    more = [
        seen[65:91].sum() / max(1, letters),
        seen[48:58].sum() / max(1, n),
        seen[10] / max(1, n),
        seen[128:].sum() / max(1, n),
        marked / max(1, len(words)),
        1 - len(set(words)) / max(1, len(words)),
        sum(c - 1 for c in Counter(lines).values()) / max(1, len(lines)),
        n / max(1, len(words)) / 64,
        len(words) / 4096,
    ]
    shares = np.concatenate([seen[list(PUNCTUATION)] / max(1, n), more])
    return 2 * WORDS + np.arange(len(shares)) * LEVELS + levels(shares)


def text_ids(text: bytes | None) -> np.ndarray:
    """Buckets of a text's words and of the first four and five bytes of the longer ones, and its shape."""
    text = text or b""
    words = words_of(text)
    starts = {w[:4] for w in words if len(w) > 4} | {w[:5] for w in words if len(w) > 5}
    return np.concatenate([numbers(words, WORDS), WORDS + numbers(starts, WORDS, START), shape_ids(text)])


def meta_ids(values: dict[str, object]) -> np.ndarray:
    """A number for each (name, value); finite numbers above 0 count by powers of two."""
    said = [f"{k}={int(np.log2(v)) if isinstance(v, (int, float)) and 0 < v < np.inf else v}" for k, v in values.items()]
    return np.array([zlib.crc32(x.encode()) % WORDS for x in said], np.int64)
