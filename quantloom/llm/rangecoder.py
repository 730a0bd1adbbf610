"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

The probability of the next id mixes three predictions: what last followed the last two ids (order 2), what
last followed the last one (order 1), and the ids' frequencies (order 0), which a segment's header gives and
every block starts from. How much of the probability each prediction gets is learned: in every state of the
first two's confidence, adaptive weights move towards the prediction that was right. One step of the range
coder codes an id: an interval each for the two predicted ids, the rest dealt out by frequency. Everything is
integer arithmetic, so any machine decodes alike. The blocks of a segment are coded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

BLOCK = 1024
#: Blocks that are coded side by side.
LANES = 3072
MAGIC = b"CMR2"
#: A step deals out 2**TOTAL parts; frequencies add up to 2**FREQ. Weights move 1 / 2**RATE of the way.
TOTAL, FREQ, RATE = 24, 16, 5
#: Ids with a frequency of their own; the others share one symbol and follow as 32 plain bits.
SYMBOLS = (1 << 15) - 1
_U = np.uint64
#: Places of a block's table of predictions.
_SLOTS = 1 << 8
_ONE, _BOTTOM, _TOP, _LOWER = _U(1 << TOTAL), _U(1 << 32), _U(1 << 48), _U((1 << 32) - 1)
#: The two weights stand in the halves of one number; those that a prediction which is always right tends to.
_GAIN = (1 << TOTAL) * 9 // 10 >> RATE
_GAINS = np.array([0, _GAIN << 32, _GAIN, 0], np.uint64)
_HALVES = _U(((1 << 32 - RATE) - 1) << 32 | (1 << 32 - RATE) - 1)
#: First weights by what is known of the two predictions: whether the last one of their place was right.
_START = [(0.04, 0.04), (0.04, 0.15), (0.4, 0.03), (0.4, 0.1)]


class _Model:
    """State of all lanes as at the start of a block: predictions, whether they were right, the weights."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.home, self.states = lane * _SLOTS, lane * 4
        # a cell is a symbol and, in the lowest bit, whether the one before it was right
        self.two, self.one = np.zeros(lanes * _SLOTS, np.uint32), np.zeros(lanes * _SLOTS, np.uint32)
        self.last, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.weights = np.tile(np.array([int(a * (1 << TOTAL)) << 32 | int(b * (1 << TOTAL)) for a, b in _START], np.uint64), lanes)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The two symbols and the weights of lanes 0..m-1."""
        one = self.last[:m] * 0x9E5F
        two = one + self.last2[:m] * 0x3C6F
        one >>= 4
        one &= _SLOTS - 1
        one += self.home[:m]
        two >>= 4
        two &= _SLOTS - 1
        two += self.home[:m]
        c2, c1 = self.two.take(two), self.one.take(one)
        state = (c2 & 1).astype(np.int64)
        state *= 2
        state += c1 & 1
        state += self.states[:m]
        self.at2, self.at1, self.state, self.own = two, one, state, self.weights.take(state)
        return c2 >> 1, c1 >> 1, self.own >> _U(32), self.own & _LOWER

    def learn(self, m: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, also1: np.ndarray) -> None:
        """x: the symbols; hit2, hit1: where a prediction's interval was taken; also1: where order 1 was right."""
        own = self.own
        own -= own >> _U(RATE) & _HALVES
        own += _GAINS.take(hit2 + 2 * hit1.view(np.uint8))
        self.weights[self.state] = own
        cell = x.astype(np.uint32)
        cell <<= 1
        self.two[self.at2] = cell | hit2
        self.one[self.at1] = cell | also1
        self.last2[:m] = self.last[:m]
        self.last[:m] = x


class _Encoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
        self.out, self.at = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
        self.home = self.at.copy()

    def put(self, a: np.ndarray | slice, start: np.ndarray, width: np.ndarray, bits: int = TOTAL) -> None:
        """Codes an interval for the lanes a. A lane's settled digit goes out; what has grown too narrow is cut to a digit."""
        r = self.range[a] >> _U(bits)
        low, rng, at = self.low[a], width * r, self.at[a]
        low += start * r
        go = np.flatnonzero((low ^ low + rng) < _TOP)
        while True:
            lo, where = low[go], at[go]
            self.out[where] = lo >> _U(48)
            at[go] = where + 1
            low[go] = lo << _U(16)
            rng[go] <<= _U(16)
            if rng.min() >= _BOTTOM:
                break
            go = _narrow(low, rng)
        self.low[a], self.range[a], self.at[a] = low, rng, at

    def finish(self) -> list[bytes]:
        for k in (48, 32, 16, 0):
            self.out[self.at] = self.low >> _U(k) & _U(0xFFFF)
            self.at += 1
        return [self.out[a:b].astype("<u2").tobytes() for a, b in zip(self.home.tolist(), self.at.tolist(), strict=True)]


def _narrow(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes whose range is too small for another step; where their digit isn't settled, the range ends at the digit."""
    go = np.flatnonzero(rng < _BOTTOM)
    lo, ra = low[go], rng[go]
    rng[go] = np.where((lo ^ lo + ra) < _TOP, ra, _U(0) - lo & _LOWER)
    return go


class _Decoder:
    def __init__(self, blocks: Sequence[bytes]):
        room = max(map(len, blocks)) // 2 + 8
        data = np.zeros((len(blocks), room), np.uint16)
        for k, b in enumerate(blocks):
            data[k, : len(b) // 2] = np.frombuffer(b, "<u2", len(b) // 2)
        self.low, self.range = np.zeros(len(blocks), np.uint64), np.full(len(blocks), np.iinfo(np.uint64).max, np.uint64)
        self.code = (data[:, :4].astype(np.uint64) << np.array([48, 32, 16, 0], np.uint64)).sum(axis=1, dtype=np.uint64)
        self.data, self.at, self.end = data.ravel(), np.arange(len(blocks)) * room + 4, np.arange(1, len(blocks) + 1) * room - 1

    def get(self, a: np.ndarray | slice, bits: int = TOTAL) -> np.ndarray:
        self.part = self.range[a] >> _U(bits)
        return np.minimum((self.code[a] - self.low[a]) // self.part, _U((1 << bits) - 1))

    def take(self, a: np.ndarray | slice, start: np.ndarray, width: np.ndarray) -> None:
        """The interval that get() was in."""
        low, rng, at, code = self.low[a], width * self.part, self.at[a], self.code[a]
        low += start * self.part
        go = np.flatnonzero((low ^ low + rng) < _TOP)
        while True:
            # damaged blocks may run past their end; their checksum tells
            where = np.minimum(at[go], self.end[a][go])
            code[go] = code[go] << _U(16) | self.data[where]
            at[go] = where + 1
            low[go] <<= _U(16)
            rng[go] <<= _U(16)
            if rng.min() >= _BOTTOM:
                break
            go = _narrow(low, rng)
        self.low[a], self.range[a], self.at[a], self.code[a] = low, rng, at, code


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids with a symbol of their own (ascending), frequencies of all symbols, and every id's symbol; the last symbol stands for other ids."""
    if ids.max() < 1 << 22:
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        counts = counts[known]
    else:
        known, counts = np.unique(ids, return_counts=True)
    rest = 0
    if len(known) > SYMBOLS:
        kept = np.sort(np.argsort(-counts, kind="stable")[:SYMBOLS])
        rest = int(counts.sum() - counts[kept].sum())
        known, counts = known[kept], counts[kept]
    counts = np.append(counts, rest)
    freq = 1 + counts * ((1 << FREQ) - len(counts)) // counts.sum()
    freq[counts.argmax()] += (1 << FREQ) - freq.sum()
    if ids.max() < 1 << 22:
        symbol = np.full(int(ids.max()) + 1, len(known), np.int64)
        symbol[known] = np.arange(len(known))
        return known, freq, symbol[ids]
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return known, freq, np.where(known[at] == ids, at, len(known))


def _encoded(ids: np.ndarray, symbols: np.ndarray, cum: np.ndarray, freq: np.ndarray, block: int) -> list[bytes]:
    lanes = -(-len(ids) // block)
    other = len(cum) - 2
    grid = np.zeros(lanes * block, np.int64)
    grid[: len(ids)] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    escaped = np.flatnonzero(symbols == other)
    raw = dict(zip(escaped.tolist(), ids[escaped].tolist(), strict=True))
    last = len(ids) - (lanes - 1) * block
    model, coder = _Model(lanes), _Encoder(lanes, (2 * block if not len(escaped) else 4 * block) + 16)
    for t in range(block if lanes > 1 else last):
        m = lanes if t < last else lanes - 1
        x = grid[t, :m]
        p2, p1, w2, w1 = model.predict(m)
        both = w2 + w1
        left = _ONE - both
        hit2, also1 = p2 == x, p1 == x
        hit1 = also1 & ~hit2
        start = (cum.take(x) * left >> _U(FREQ)) + both
        width = freq.take(x) * left >> _U(FREQ)
        one, two = np.flatnonzero(hit1), np.flatnonzero(hit2)
        start[one], width[one] = w2[one], w1[one]
        start[two], width[two] = 0, w2[two]
        coder.put(slice(0, m), start, width)
        if raw and (x == other).any():
            b = np.flatnonzero(x == other)
            value = np.array([raw[k] for k in (b * block + t).tolist()], np.uint64)
            for part in (value >> _U(16), value & _U(0xFFFF)):
                coder.put(b, part, np.ones(len(b), np.uint64), 16)
        model.learn(m, x, hit2, hit1, also1)
    return coder.finish()


def _decoded(blocks: Sequence[bytes], sizes: list[int], known: np.ndarray, cum: np.ndarray, freq: np.ndarray, lookup: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks of the sizes given (descending)."""
    lanes, other = len(blocks), len(known)
    grid = np.zeros((max(sizes), lanes), np.int64)
    raw: dict[tuple[int, int], int] = {}
    model, coder = _Model(lanes), _Decoder(blocks)
    ends = np.array(sizes)
    for t in range(max(sizes)):
        m = lanes if t < sizes[-1] else int(np.searchsorted(-ends, -t, "left"))
        a = slice(0, m)
        p2, p1, w2, w1 = model.predict(m)
        both = w2 + w1
        left = _ONE - both
        v = coder.get(a)
        hit2 = v < w2
        hit1 = (v < both) & ~hit2
        one, two = np.flatnonzero(hit1), np.flatnonzero(hit2)
        v -= both
        v[one] = v[two] = 0
        # the last frequency step whose scaled start is not beyond v
        v += _U(1)
        v <<= _U(FREQ)
        v -= _U(1)
        x = lookup.take(np.minimum(v // left, _U((1 << FREQ) - 1)).astype(np.int64))
        start = (cum.take(x) * left >> _U(FREQ)) + both
        width = freq.take(x) * left >> _U(FREQ)
        start[one], width[one], x[one] = w2[one], w1[one], p1[one]
        start[two], width[two], x[two] = 0, w2[two], p2[two]
        coder.take(a, start, width)
        if (x == other).any():
            b = np.flatnonzero(x == other)
            value = np.zeros(len(b), np.uint64)
            for _ in range(2):
                part = coder.get(b, 16)
                coder.take(b, part, np.ones(len(b), np.uint64))
                value = value << _U(16) | part
            raw |= {(k, t): i for k, i in zip(b.tolist(), value.tolist(), strict=True)}
        model.learn(m, x, hit2, hit1, p1 == x)
        grid[t, :m] = x
    ids = np.append(known, 0)[np.minimum(grid, other)]
    for (k, t), i in raw.items():
        ids[t, k] = i
    return [np.ascontiguousarray(ids[:n, k]) for k, n in enumerate(sizes)]


def _side(blocks: int) -> int:
    """Blocks that go side by side, in equal shares."""
    return -(-blocks // -(-blocks // LANES)) if blocks else 1


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids (0..2**32-1) as a segment: magic, block length, number of ids and of blocks, the frequencies; each block's size and checksum; the blocks."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids must be in 0..2**32-1")
    if not len(ids):
        return MAGIC + struct.pack("<IQII", block, 0, 0, 0)
    known, freq, symbols = _alphabet(ids)
    cum = np.concatenate(([0], np.cumsum(freq))).astype(np.uint64)
    blocks: list[bytes] = []
    side = _side(-(-len(ids) // block)) * block
    for k in range(0, len(ids), side):
        part = slice(k, k + side)
        blocks += _encoded(ids[part], symbols[part], cum, freq.astype(np.uint64), block)
    sums = [zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) for k in range(len(blocks))]
    header = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    table = b"".join(struct.pack("<II", len(b), s) for b, s in zip(blocks, sums, strict=True))
    return MAGIC + struct.pack("<IQII", block, len(ids), len(blocks), len(header)) + header + table + b"".join(blocks)


def unpack(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """The ids of a segment, or of `count` of its blocks from `first` on, of which only these are read.

    ValueError if it is no segment or a block's checksum is wrong.
    """
    if data[:4] != MAGIC or len(data) < 24:
        raise ValueError("not a segment")
    block, n, total, wide = struct.unpack_from("<IQII", data, 4)
    if not total:
        return np.empty(0, np.int64)
    head = np.frombuffer(zlib.decompress(data[24 : 24 + wide]), "<u4").astype(np.int64)
    known, freq = np.cumsum(head[: len(head) // 2]), head[len(head) // 2 :]
    cum = np.concatenate(([0], np.cumsum(freq))).astype(np.uint64)
    lookup = np.repeat(np.arange(len(freq)), freq)
    table = np.frombuffer(data, "<u4", 2 * total, 24 + wide).reshape(total, 2).astype(np.int64)
    ends = 24 + wide + 8 * total + np.cumsum(table[:, 0])
    wanted = range(first, total if count is None else min(total, first + count))
    out = []
    side = _side(len(wanted))
    for k in range(wanted.start, wanted.stop, side):
        some = range(k, min(k + side, wanted.stop))
        got = _decoded([data[ends[b] - table[b, 0] : ends[b]] for b in some], [min(block, n - b * block) for b in some], known, cum, freq.astype(np.uint64), lookup)
        for b, ids in zip(some, got, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != table[b, 1]:
                raise ValueError(f"block {b} is damaged")
        out += got
    return np.concatenate(out) if out else np.empty(0, np.int64)
