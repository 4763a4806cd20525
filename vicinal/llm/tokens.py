"""Words and word hashes of whole Arrow batches of texts, by array arithmetic.

Everything here works on the UTF-8 bytes of many texts at once and takes a few
nanoseconds a byte.  It runs inside tasks, on batches that Spark hands over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to about this many bytes; a longer text stands alone.
CHUNK_BYTES = 1_000_000

_U = np.uint64
#: Base of the polynomial over the bytes of a word, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the public SplitMix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_series(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that follow from a seed."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


_BYTE_VALUES = hash_series(17, 256)
_GRAM_FACTORS = hash_series(29, 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def byte_class(chars: bytes) -> np.ndarray:
    """A table by byte: whether it is one of ``chars``."""
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


#: Bytes of words between white space; and of words of ASCII letters, digits and all other scripts.
NOT_SPACE = ~byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = byte_class(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


@dataclass
class Words:
    """The words of some texts: where each begins and ends in ``data`` and whose it is."""

    data: np.ndarray
    #: First byte of every text, and the end of the last.
    text_at: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    #: First word of every text, and the end of the last.
    word_at: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.word_at) - 1), np.diff(self.word_at))

    @property
    def left(self) -> np.ndarray:
        """How many words its text has from each word on."""
        return np.repeat(self.word_at[1:], np.diff(self.word_at)) - np.arange(len(self.begin))

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (of ``data`` in place of the own bytes)."""
        data = self.data if data is None else data
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=sums[1:])
        found = (sums[self.end] - sums[self.begin]) * inverse[self.begin]
        return mix(found + (self.end - self.begin).astype(_U))


def grams(hashes: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether its text has so many."""
    n = len(hashes)
    total = np.zeros(n, _U)
    for j in range(min(k, n)):
        total[: n - j] += hashes[j:] * _GRAM_FACTORS[j]
    return mix(total), left >= k


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, bytes, offsets)`` of runs of texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def split_words(data: np.ndarray, text_at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes that ``inside`` holds, none of them across two texts."""
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(data, text_at, none, none, np.zeros(len(text_at), np.int64))
    member = inside[data]
    edge = np.zeros(size + 1, bool)
    edge[text_at] = True
    before = np.zeros(size, bool)
    before[1:] = member[:-1]
    begin = np.flatnonzero(member & (~before | edge[:-1]))
    after = np.zeros(size, bool)
    after[:-1] = member[1:]
    end = np.flatnonzero(member & (~after | edge[1:])) + 1
    return Words(data, text_at, begin, end, np.searchsorted(begin, text_at))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 (two bytes in UTF-8) in lower case."""
    found = data.copy()
    found[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    found[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return found


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on (fewer at the end), by doubling."""
    found, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        if step < len(found):
            found[:-step] = np.minimum(found[:-step], found[step:])
        reach += step
    return found
