"""Hashes of words and of windows of words, for whole Arrow batches of texts at a time.

A word's hash is a polynomial over its bytes, a window's a polynomial over its words' hashes,
both modulo 2**64 with random coefficients for the 256 bytes; running sums give every word and
every window of a batch without a loop over them. The constants are fixed by seeds, so hashes agree
between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import lean

_MASK = (1 << 64) - 1
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so invertible
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
#: Bytes hashed at a time; a longer text is hashed whole.
SLICE = 1 << 19
#: Texts in a batch at most: their numbers have 16 bits.
ROWS = 1 << 16


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base**i and base**-i for i under n."""
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), SLICE)
            grown = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                grown.append(np.cumprod(x, dtype=np.uint64))
            self._up, self._down = grown
        return self._up[:n], self._down[:n]


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """hashes of the words of some texts, one text after the other; text i has those from
    ends[i - 1] to ends[i]. Word j is data[starts[j]:stops[j]]."""

    hashes: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def window_counts(self, k: int) -> np.ndarray:
        return np.maximum(self.counts - k + 1, 0)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words, and the index of each one's first word."""
        n = len(self.hashes)
        per_text = self.window_counts(k)
        total = int(per_text.sum())
        starts = np.arange(total) + np.repeat(self.ends - self.counts - (np.cumsum(per_text) - per_text), per_text)
        up, down = _word_powers.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        return mix((sums[starts + k] - sums[starts]) * down[starts] + np.uint64(k)), starts

    def whole(self, short: np.ndarray) -> np.ndarray:
        """The hashes of the whole word sequences of the texts at these indexes."""
        n = len(self.hashes)
        up, down = _word_powers.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        hi = self.ends[short]
        lo = hi - self.counts[short]
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def hash_words(texts: pa.Array, fold: bool = False) -> Words:
    """The words of a string column (null: none). fold: A-Z count as a-z."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(offsets)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), lengths, 0)
    table = _FOLDED if fold else _BYTES
    hashes, spans, counts, i = [], [], np.zeros(n, dtype=np.int64), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        raw = data[lo:hi]
        gap = _GAPS[raw]
        # a text's end parts words as a gap does
        first = np.zeros(hi - lo + 1, dtype=bool)
        first[offsets[i : j + 1] - lo] = True
        word = ~gap
        starts = word.copy()
        starts[1:] &= gap[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= gap[1:] | first[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        up, down = _byte_powers.get(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[raw] * up[: hi - lo], out=sums[1:])
        h = mix((sums[e] - sums[s]) * down[s])
        at = np.searchsorted(s, offsets[i : j + 1] - lo)
        per_text = np.diff(at)
        if texts.null_count and (lengths[i:j] != np.diff(offsets[i : j + 1])).any():
            valid = np.repeat(lengths[i:j] > 0, per_text)
            h, s, e = h[valid], s[valid], e[valid]
            per_text = np.where(lengths[i:j] > 0, per_text, 0)
        hashes.append(h)
        spans.append((s + lo, e + lo))
        counts[i:j] = per_text
        i = j
    if not hashes:
        return Words(np.zeros(0, dtype=np.uint64), np.cumsum(counts), data, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    return Words(np.concatenate(hashes), np.cumsum(counts), data, *(np.concatenate(x) for x in zip(*spans, strict=True)))


def ordered_sets(hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and their number."""
    out = hashes.copy()
    ends = np.cumsum(per_text)
    for lo, hi in zip((ends - per_text).tolist(), ends.tolist(), strict=True):
        out[lo:hi].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[(ends - per_text)[per_text > 0]] = True
    text = np.repeat(np.arange(len(per_text)), per_text)
    return out[new], np.bincount(text[new], minlength=len(per_text))


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, A-Z folded: (hashes, number per text). A shorter
    text has one shingle, its whole sequence; one without words none."""
    words = hash_words(texts, fold=True)
    counts = words.counts
    hashes, _ = words.windows(k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    per_text = words.window_counts(k)
    if len(short):
        at = (np.cumsum(per_text) - per_text)[short]
        hashes = np.insert(hashes, at, words.whole(short))
        per_text[short] = 1
    return ordered_sets(hashes, per_text)


def signatures(hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    first = np.cumsum(per_text) - per_text
    some = per_text > 0
    a = np.zeros(len(per_text), dtype=np.uint64)
    b = np.zeros(len(per_text), dtype=np.uint64)
    if some.any():
        a[some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first[some])
        b[some] = np.bitwise_xor.reduceat(mix(hashes + np.uint64(0x14057B7EF767814F)), first[some]) + per_text[some].astype(np.uint64)
    return a, b


def sub_batches(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of some batches in batches of about `size` bytes of text and ROWS rows at most; a longer text stands alone."""
    for batch in lean(batches):
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(column))))
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch  # else it is held when lean() gives back


def _lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)


def deal(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the hashes by part, and the bounds of each part in it. Within a part, hashes keep their order."""
    part = (hashes >> np.uint64(32)) % np.uint64(parts)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))
