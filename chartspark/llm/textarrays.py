"""Words of many texts as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Arrays of a chunk take some 40 bytes for each of these.
CHUNK_BYTES = 1 << 19
#: Any odd multiplier serves; both sides of a comparison use these.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits; bytes of other characters belong to words.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
POWERS = np.cumprod(np.full(1 << 16, FACTOR))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def with_seed(h: np.ndarray, seed: int) -> np.ndarray:
    """One of many hash functions of the same values."""
    return mixed(h ^ mixed(np.array([seed + 1], dtype=np.uint64) * FACTOR))


@dataclass
class Words:
    """Words of a run of texts: hash, first and end byte of each, and where each text's words begin."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, with one more at the end
    begins: np.ndarray  # byte offset of each text

    def prefixes(self, length: int) -> np.ndarray:
        """Hash of the first `length` bytes of each word; 0 for words that are not longer."""
        longer = self.ends - self.starts > length
        out = np.zeros(len(self.starts), dtype=np.uint64)
        at = self.starts[longer]
        total = np.full(len(at), np.uint64(length))
        for i in range(length):
            total += (self.data[at + i].astype(np.uint64) + np.uint64(1)) * POWERS[i]
        out[longer] = mixed(total)
        return out


def words_of(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """Lower-cased (A-Z) words between separator bytes; a null text has none. No word spans two texts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    buffer = texts.buffers()[2]
    data = LOWER[np.frombuffer(buffer, dtype=np.uint8)[low:high]] if buffer is not None else np.zeros(0, dtype=np.uint8)
    begins = offsets - low
    inside = ~separators[data]
    if not len(data) or not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none.astype(np.uint64), none, none, np.zeros(len(begins), dtype=np.int64), begins)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[begins] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    at = np.flatnonzero(inside)
    lengths = ends - starts
    word_first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(word_first, lengths)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * POWERS[place & 0xFFFF]
    hashes = mixed(np.add.reduceat(terms, word_first) + lengths.astype(np.uint64))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, begins), begins)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """`(first row, rows)`: slices of about `limit` bytes, one row at least."""
    sizes = np.array([0 if n is None else n for n in _lengths(texts)], dtype=np.int64)
    at, total = 0, np.cumsum(sizes)
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def _lengths(texts: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` neighbouring words, across texts as well; the caller drops those that span two."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = total * FACTOR + hashes[i : i + n]
    return mixed(total)


def hash_word(word: bytes) -> int:
    """The hash that `words_of` gives a word."""
    found = words_of(pa.array([word], type=pa.binary()), np.zeros(256, dtype=bool))
    return int(found.hashes[0]) if len(found.hashes) else 0
