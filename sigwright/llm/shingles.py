"""Words, hashed word shingles and MinHash signatures, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

GOLDEN = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at the ASCII blanks x20 and x09 to x0D; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ordered_shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-word shingles in text order; of the whole sequence where there are fewer words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(GOLDEN) + hashes[i : i + m]
        out ^= out >> np.uint64(29)
    return _mixed(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(ordered_shingles(word_hashes(words(text)), n))


class MinHasher:
    """Signatures of ``symbols`` b-bit minima (b = 16) under fixed random linear hashes."""

    def __init__(self, symbols: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, symbols, np.uint64)
        self.symbols = symbols

    def minima(self, hashes: np.ndarray, starts: np.ndarray | None = None, block: int = 1 << 13) -> np.ndarray:
        """Minima over all hashes, or over the runs that begin at ``starts``: symbols x runs."""
        if starts is None:
            low = None
            for at in range(0, len(hashes), block):
                part = (hashes[None, at : at + block] * self.a[:, None] + self.b[:, None]).min(1)
                low = part if low is None else np.minimum(low, part)
            return low[:, None]
        return np.stack([np.minimum.reduceat(hashes * a + b, starts) for a, b in zip(self.a, self.b, strict=True)])

    def symbols_of(self, minima: np.ndarray) -> np.ndarray:
        """The b-bit symbols of minima, runs x symbols."""
        return ((minima * np.uint64(GOLDEN)) >> np.uint64(48)).astype(np.uint16).T


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(64)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]


@dataclass
class FlatWords:
    """The words of several texts in flat arrays: 64-bit hashes (A-Z lower-cased), first and last (behind) byte
    within their text. Text i has the words first[i] to first[i + 1]."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def flat_words(texts: pa.Array) -> FlatWords:
    """The words of a column of texts; null has none. A word's hash sums a mixed number for each of its bytes and the
    byte's place, then mixes the sum."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    base = offsets - offsets[0]
    solid = np.concatenate([[False], ~_BLANK[data], [False]])
    opening = np.zeros(len(data) + 1, bool)
    opening[base] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | opening[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | opening[1:])) + 1
    first = np.searchsorted(start, base)
    lengths = end - start
    heads = np.cumsum(lengths) - lengths
    parts = np.arange(1, lengths.sum() + 1, dtype=np.uint64) - np.repeat(heads.astype(np.uint64), lengths)
    parts *= np.uint64(GOLDEN)
    parts += _BYTE[data[solid[1:-1]]]
    # a sum of products alone would be a polynomial, and different long words of few letters would share its value
    parts ^= parts >> np.uint64(32)
    parts *= np.uint64(0xD6E8FEB86659FD93)
    parts ^= parts >> np.uint64(29)
    h = _mixed(np.add.reduceat(parts, heads)) if len(heads) else np.zeros(0, np.uint64)
    shift = np.repeat(base[:-1], np.diff(first))
    return FlatWords(h, start - shift, end - shift, first)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of batches of about ``size`` bytes of text at most, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        at, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)
