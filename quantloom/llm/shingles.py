"""Word shingles of whole texts as sets of 64-bit hashes, made for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quantloom.llm.wordpiece import words

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and the offsets; null counts as empty."""
    text = text.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, from prefix sums over all bytes (modulo 2**64)."""
    power = np.full(len(data), _BASE, np.uint64)
    if len(power):
        power[0] = 1
    power = np.cumprod(power)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)))
    # dividing by the power at the word's start: the inverse power is that of the inverse base
    back = np.full(len(data) + 1, _BACK, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    return mixed((sums[start + size] - sums[start]) * back[start] + size.astype(np.uint64))


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than `width`
    words has its whole sequence as one shingle; without words (or null) the set is empty.
    """
    data, offsets = text_bytes(text)
    if not len(data):
        return [np.empty(0, np.uint64)] * len(text)
    start, size, doc = words(data, offsets)
    h = word_hashes(data, start, size)
    if len(h) >= width:
        s = h[: len(h) - width + 1] * _PLACE[0]
        for k in range(1, width):
            s = s + h[k : len(h) - width + 1 + k] * _PLACE[k]
        s = mixed(s)
    else:
        s = np.empty(0, np.uint64)
    ends = np.searchsorted(doc, np.arange(len(text) + 1))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(s[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(mixed(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _U(b - a)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out
