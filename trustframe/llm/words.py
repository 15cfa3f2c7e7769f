"""Words and word hashes shared by the text operators.

A word is a maximal run of characters other than space and U+0009-U+000D. Hashes are 64-bit and the same in every
process, so they may be compared across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

CACHED_WORDS = 400_000
CACHED_WORD_BYTES = 48


class _WordHashes(dict):
    """Memo of word hashes, emptied at a fixed size."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


_HASHES = _WordHashes()


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a text as UTF-8; only A-Z are lower-cased. A null text has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; n = 1 gives the words themselves, mixed."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return out


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, a text without words has none."""
    h = hashes(words(text))
    return np.unique(ngrams(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def text_slices(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of bounded text (one longer document makes a slice of its own): bounded memory."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(sizes.astype(float)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def arrow_rows(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema):
    """A mapInArrow function that turns each bounded slice of (.., text) rows into columns of `schema`."""
    def run(batches):
        for part in text_slices(batches):
            columns = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    return run
