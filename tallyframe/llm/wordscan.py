"""Words, word hashes and n-gram hashes of Arrow text columns, computed on whole batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these bytes
inside a character, so the bytes are scanned as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_A
    x ^= x >> np.uint64(29)
    x *= _MIX_B
    x ^= x >> np.uint64(32)
    return x


@dataclass(frozen=True)
class Words:
    """Words of consecutive texts: byte spans in ``data``; text i has words bounds[i]:bounds[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of every word's bytes; ``lower`` folds A-Z first."""
        source = _LOWER[self.data] if lower else self.data
        padded = np.concatenate([source, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(source) + 1,), "<u8", padded.data, strides=(1,))
        lengths = self.ends - self.starts
        h = mix(lengths.astype(np.uint64) + _STEP)
        at, left, row = self.starts, lengths, None
        for _ in range(_LONG_WORD // 8):
            if not len(at):
                return h
            chunk = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
            if row is None:
                h = mix((h ^ chunk) * _STEP)
            else:
                h[row] = mix((h[row] ^ chunk) * _STEP)
            more = np.flatnonzero(left > 8)
            row = more if row is None else row[more]
            at, left = at[more] + 8, left[more] - 8
        for i in row:
            text = source[self.starts[i] : self.ends[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
        return h

    def trimmed(self) -> Words:
        """The words without up to three characters of ASCII punctuation at each end; a word of
        punctuation alone keeps one character."""
        starts, ends = self.starts.copy(), self.ends.copy()
        for _ in range(3):
            starts += _PUNCTUATION[self.data[starts]] & (ends - starts > 1)
            ends -= _PUNCTUATION[self.data[ends - 1]] & (ends - starts > 1)
        return Words(self.data, starts, ends, self.bounds)

    def text_index(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, so that work space stays bounded."""
    lengths = text_bytes(batch.column(column))
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lengths)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 length of each text; a null has none."""
    return np.diff(_buffers(texts)[1])


def scan(texts: pa.Array) -> Words:
    data, offsets = _buffers(texts)
    word = ~_SEPARATOR[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    first[inside] = word[inside]
    last[inside - 1] = word[inside - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total, width = None, 0
    power, span = words, 1
    factor = lambda k: np.uint64(pow(int(_STEP), k, 1 << 64))
    left = n
    while left:
        if left & 1:
            if total is None:
                total, width = power, span
            else:
                keep = len(total) - span
                total = total[:keep] * factor(span) + power[width : width + keep]
                width += span
        left >>= 1
        if left:
            keep = len(power) - span
            power = power[:keep] * factor(span) + power[span : span + keep]
            span *= 2
    return mix(total[: len(words) - n + 1] + np.uint64(n))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
