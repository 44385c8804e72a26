"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)
_VALUE = _VALUE[_FOLD]
_VALUE[SPACE] = 0
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 256), np.uint64(0xD6E8FEB86659FD93))
        p[0] = 1
        _POWERS[0] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, each followed by a line feed
    docs: np.ndarray  # where each text starts, and the end
    starts: np.ndarray  # of each word
    ends: np.ndarray
    per_doc: np.ndarray  # index of each text's first word, and the number of words
    punctuated: bool = False  # bytes between words may be other than white space

    def gaps(self) -> np.ndarray:
        """Bytes outside words."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        return np.cumsum(edge, dtype=np.int8)[:-1] == 0

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z taken as a-z."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        at = np.zeros(len(self.data), np.int32)
        at[self.starts] = self.starts
        at = np.arange(len(self.data), dtype=np.int32) - np.maximum.accumulate(at)
        longest = int((self.ends - self.starts).max())
        np.minimum(at, longest, out=at)
        terms = _VALUE[self.data]
        if self.punctuated:
            terms[self.gaps()] = 0
        terms *= powers(longest + 1)[at]
        return mix(np.add.reduceat(terms, self.starts) + (self.ends - self.starts).astype(np.uint64) * _STEP)


def words_of(texts: pa.Array, breaks: np.ndarray = SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, or runs of bytes outside ``breaks``; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    docs = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(joined), np.int64))])
    if len(docs) == 1:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), docs, none, none, np.zeros(1, np.int64))
    first = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[first : first + docs[-1]]
    space = breaks[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    return Words(data, docs, starts, ends, np.searchsorted(starts, docs), breaks is not SPACE)


def blocks_of(text: bytes, every: int = 1, size: int = 4 << 20, breaks: np.ndarray = SPACE) -> Iterator[bytes]:
    """A long text in blocks of about ``size`` bytes that begin at a word and hold a multiple of ``every`` words; the last one holds the rest."""
    at, step = 0, size
    while len(text) - at > step:
        space = breaks[np.frombuffer(text, np.uint8, step, at)]
        starts = np.flatnonzero(np.concatenate([[True], space[:-1]]) & ~space)
        n = (len(starts) - 1) // every * every
        if n <= 0:  # a word, or a run of white space, longer than the block
            step *= 2
            continue
        yield text[at : at + int(starts[n])]
        at, step = at + int(starts[n]), size
    yield text[at:]
