"""An adaptive context-mixing range coder over token ids, in independently reset blocks.

The next id is predicted from two contexts and no context: the id that last
followed the two previous ids (order 2), the one that last followed the
previous id (order 1), each with a confidence whose success rate is learned,
and frequencies of its bytes, each given the byte above it (order 0).  The
mixture gives one interval for each of the three; a range coder with 32-bit
ranges does the arithmetic.  All state is integer, so files decode alike on any
machine.

Orders 1 and 2 and the rates that mix the orders adapt from nothing in each
block.  The frequencies of order 0 are those of the segment, whose head holds
them: a block is too short to learn some ten thousand ids.

Blocks share nothing else, so one numpy call advances all blocks of a segment
by one id: speed comes from many blocks, not from long ones.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TSRC"
VERSION = 3
#: Ids in a block.
BLOCK = 1024
_SLOT_BITS = 8
_TOTAL_BITS = 12
_TOTAL = 1 << _TOTAL_BITS
_WHOLE = np.uint32(_TOTAL)
#: Confidences: 0 to 7; up by one on a hit, halved on a miss; an id of confidence 0 or 1 gives way to the one that came.
_SURE = 7
_START_RATES = np.array([64, 800, 1600, 2400, 2800, 3200, 3500, 3700], np.uint32)
#: What a rate gains, after a sixteenth of it is taken away, and what it gains beside on a hit.
_MISS, _HIT = np.uint32(2), np.uint32(250)


class CorruptBlock(ValueError):
    """A segment or block fails its checksum."""


class _Model:
    """Prediction state of many blocks side by side; row 0 is order 2, row 1 order 1."""

    def __init__(self, lanes: int, wide: bool):
        self.kind, self.bits = (np.uint64, 32) if wide else (np.uint32, 16)
        slots = 1 << _SLOT_BITS
        self.table, self.mask = np.zeros(2 * lanes * slots, self.kind), self.kind((1 << self.bits) - 1)
        self.rates = np.tile(_START_RATES, 2 * lanes)
        rows = np.arange(2 * lanes).reshape(2, lanes)
        self.slots, self.rate_rows = rows * slots, rows * 8
        self.key, self.at, self.q = np.empty((2, lanes), np.uint32), np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int64)
        self.prev1, self.prev2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def predict(self) -> None:
        """ids: predicted by each order; f2, top: where the interval of order 2 ends, and that of order 1."""
        np.multiply(self.prev1, 0x9E3779B1, out=self.key[1])
        np.multiply(self.prev2, 0x85EBCA6B, out=self.key[0])
        self.key[0] += self.key[1]
        self.at[:] = self.key >> (32 - _SLOT_BITS)
        self.at += self.slots
        entry = self.table.take(self.at)
        self.conf, self.ids = entry >> self.bits, (entry & self.mask).astype(np.uint32, copy=False)
        self.q[:] = self.conf
        self.q += self.rate_rows
        self.p = self.rates.take(self.q)
        self.f2 = self.p[0]
        f1 = np.maximum((_TOTAL - self.f2) * self.p[1] >> _TOTAL_BITS, 1)
        np.putmask(f1, self.ids[0] == self.ids[1], 1)  # order 1 has nothing to add
        self.top = self.f2 + f1

    def update(self, x: np.ndarray, hit: np.ndarray) -> None:
        conf = np.where(hit, np.minimum(self.conf + 1, _SURE), np.maximum(self.conf >> 1, 1))
        self.table[self.at] = (conf << self.bits) | np.where(self.conf > 1, self.ids, x)  # on a hit both are the id that came
        # moves toward 4032 on a hit and 32 on a miss, so all outcomes keep room
        self.rates[self.q] = self.p - (self.p >> 4) + (hit * _HIT + _MISS)
        self.prev2, self.prev1 = self.prev1, x


class _Encoder:
    """Range coders side by side.  Words of 16 bits go out as soon as they are settled but for a carry, which is a 17th bit until the end."""

    def __init__(self, lanes: int):
        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFF, np.uint32)
        self.cap = 256
        self.out, self.every = np.zeros(lanes * self.cap, np.int32), np.arange(lanes)
        self.at = self.every * self.cap  # where the next word of a lane goes
        self.room = self.cap  # words that every lane can still take

    def grow(self, words: int) -> None:
        """Make room for so many words in each lane."""
        self.room -= words
        if self.room < 8:
            used = self.at - self.every * self.cap
            self.room = self.cap - int(used.max())
            if self.room < self.cap // 4:
                self.out = np.pad(self.out.reshape(-1, self.cap), ((0, 0), (0, self.cap))).reshape(-1)
                self.cap *= 2
                self.at = self.every * self.cap + used
                self.room = self.cap - int(used.max())

    def code(self, lanes: np.ndarray | None, low: np.ndarray, rng: np.ndarray, start: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Narrow the intervals (low, rng) of some lanes, or of all; gives the new ones."""
        r = rng >> _TOTAL_BITS
        low = low + (r * start).astype(np.uint64)
        rng = r * freq
        short = np.flatnonzero(rng < 65536)
        if len(short):
            k, part = short if lanes is None else lanes.take(short), low.take(short)
            at = self.at.take(k)
            self.out[at] = part >> 16
            self.at[k] = at + 1
            low[short] = (part & 0xFFFF) << 16
            rng[short] = rng.take(short) << 16
        return low, rng

    def finish(self) -> list[bytes]:
        self.room = 0
        self.grow(0)
        for shift in (16, 0):
            self.out[self.at] = self.low >> 16 if shift else self.low & 0xFFFF
            self.at += 1
        over = np.flatnonzero(self.out > 0xFFFF)
        while len(over):  # carries run back; none leaves its lane, as a code is below 1
            self.out[over] &= 0xFFFF
            self.out[over - 1] += 1
            over = over[self.out[over - 1] > 0xFFFF] - 1
        flat = self.out.astype("<u2")
        return [flat[k * self.cap : end].tobytes() for k, end in enumerate(self.at.tolist())]


def frequencies(ids: np.ndarray) -> list[np.ndarray]:
    """For each byte of an id from the top, out of _TOTAL: frequencies of its values, by the byte above it."""
    counts = []
    for k in (2, 1, 0) if len(ids) and int(ids.max()) > 0xFFFF else (0,):
        counts.append(np.bincount((ids >> 8 * k & 0xFFFF).astype(np.int64), minlength=65536).reshape(256, 256))
    top = np.zeros((256, 256), np.int64)
    top[0] = counts[0].sum(axis=1)
    out = []
    for n in (top, *counts):
        total = n.sum(axis=1, keepdims=True)
        f = np.where(n > 0, np.maximum(n * (_TOTAL - 256) // np.maximum(total, 1), 1), 0)
        most = n.argmax(axis=1)
        f[np.arange(256), most] += _TOTAL - f.sum(axis=1)
        out.append(f.reshape(-1))
    return out


def _intervals(f: np.ndarray) -> np.ndarray:
    """Start and length of each interval, as the upper and lower half of a number."""
    f = f.reshape(256, 256)
    return ((np.cumsum(f, axis=1) - f) << 16 | f).astype(np.uint32).reshape(-1)


def encode_blocks(ids: np.ndarray, freqs: list[np.ndarray], block: int = BLOCK) -> list[bytes]:
    """The code of each block of the ids.  The last block is filled up with its last id."""
    if not len(ids):
        return []
    lanes = -(-len(ids) // block)
    grid = np.full(lanes * block, ids[-1], np.uint32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    shifts = range(8 * len(freqs) - 8, -1, -8)
    digits = [_intervals(f).take(grid >> k & 0xFFFF) for f, k in zip(freqs, shifts)]
    m, e = _Model(lanes, len(freqs) > 2), _Encoder(lanes)
    low, rng = e.low, e.rng
    for t, x in enumerate(grid):
        m.predict()
        hit = m.ids == x
        hit2 = hit[0]
        hit1 = hit[1] > hit2
        start = np.where(hit1, m.f2, m.top)
        end = np.where(hit1, m.top, _WHOLE)
        np.putmask(start, hit2, 0)
        np.copyto(end, m.f2, where=hit2)
        e.grow(len(freqs) + 1)
        low, rng = e.code(None, low, rng, start, end - start)
        lit = np.flatnonzero(~(hit2 | hit1))
        if len(lit):
            part, size = low.take(lit), rng.take(lit)
            for d in digits:
                both = d[t].take(lit)
                part, size = e.code(lit, part, size, both >> 16, both & 0xFFFF)
            low[lit], rng[lit] = part, size
        m.update(x, hit)
    e.low = low
    return e.finish()


@np.errstate(all="ignore")
def decode_blocks(codes: list[bytes], freqs: list[np.ndarray], block: int) -> np.ndarray:
    """The ids of blocks of one size."""
    lanes = len(codes)
    if not lanes:
        return np.empty(0, np.int64)
    offset = np.cumsum([0, *(len(c) // 2 for c in codes)])
    words = np.append(np.frombuffer(b"".join(codes), "<u2"), np.zeros(2, "<u2")).astype(np.uint32)
    pos = offset[:-1].copy()
    code = words.take(pos, mode="clip") << 16 | words.take(pos + 1, mode="clip")
    pos += 2
    rng, m, grid = np.full(lanes, 0xFFFFFFFF, np.uint32), _Model(lanes, len(freqs) > 2), np.empty((block, lanes), np.uint32)
    tables = []
    for f in freqs:
        held = f.copy()
        held[::256][held.reshape(256, 256).sum(axis=1) == 0] = _TOTAL  # bytes that never come
        tables.append((_intervals(held), np.repeat(np.tile(np.arange(256, dtype=np.uint8), 256), held)))

    def take(at: np.ndarray | None, c: np.ndarray, r: np.ndarray, start: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The new (code, range) of some lanes or all, with the words that they read."""
        c, size = c - r * start, r * freq
        short = np.flatnonzero(size < 65536)
        if len(short):
            k = short if at is None else at.take(short)
            p = pos.take(k)
            c[short] = c.take(short) << 16 | words.take(p, mode="clip")
            size[short] = size.take(short) << 16
            pos[k] = p + 1
        return c, size

    for t in range(block):
        m.predict()
        r = rng >> _TOTAL_BITS
        hit2 = code < r * m.f2
        hit1 = (code < r * m.top) > hit2
        start = np.where(hit1, m.f2, m.top)
        end = np.where(hit1, m.top, _WHOLE)
        np.putmask(start, hit2, 0)
        np.copyto(end, m.f2, where=hit2)
        code, rng = take(None, code, r, start, end - start)
        x = np.where(hit2, m.ids[0], m.ids[1])
        lit = np.flatnonzero(~(hit2 | hit1))
        if len(lit):
            c, size, above, y = code.take(lit), rng.take(lit), 0, 0
            for intervals, symbol in tables:
                r = size >> _TOTAL_BITS
                # the quotient of numbers below 2^32 is never rounded up to the next integer; damaged codes give any digit
                digit = symbol.take((above << 4) + np.minimum((c / r).astype(np.int64), _TOTAL - 1), mode="clip").astype(np.int64)
                both = intervals.take(above + digit)
                c, size = take(lit, c, r, both >> 16, both & 0xFFFF)
                above, y = digit << 8, (y << 8) + digit
            code[lit], rng[lit], x[lit] = c, size, y
        grid[t] = x
        m.update(x, m.ids == x)
    return grid.T.reshape(-1)


_HEAD = struct.Struct("<4sBBIQQI")


def pack_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: head, document table, frequencies and block table with their checksum, codes; each block has a checksum of its ids."""
    ids = ids.astype(np.uint32)
    block = max(1, min(block, len(ids)))
    freqs = frequencies(ids)
    codes = encode_blocks(ids, freqs, block)
    packed = zlib.compress(np.concatenate(freqs).astype("<u2").tobytes(), 6)
    flat = memoryview(ids.astype("<u4")).cast("B")
    table = np.array([[len(c), zlib.crc32(flat[4 * k * block : 4 * (k + 1) * block])] for k, c in enumerate(codes)], "<u4").reshape(-1)
    head = _HEAD.pack(MAGIC, VERSION, len(freqs), block, len(doc_ids), len(ids), len(packed)) + doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + packed + table.tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(codes)


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a segment, each block held against its checksum."""
    try:
        magic, version, digits, block, docs, n, packed = _HEAD.unpack_from(data)
    except struct.error as e:
        raise CorruptBlock("damaged segment head") from e
    if magic != MAGIC or version != VERSION:
        raise CorruptBlock("not a segment of this format")
    blocks = -(-n // block)
    at = _HEAD.size + 16 * docs
    end = at + packed + 8 * blocks
    if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
        raise CorruptBlock("damaged segment head")
    doc_ids = np.frombuffer(data, "<i8", docs, _HEAD.size)
    counts = np.frombuffer(data, "<i8", docs, _HEAD.size + 8 * docs)
    freqs = list(np.frombuffer(zlib.decompress(data[at : at + packed]), "<u2").astype(np.int64).reshape(digits, -1))
    table = np.frombuffer(data, "<u4", 2 * blocks, at + packed).reshape(-1, 2)
    cuts = end + 4 + np.cumsum([0, *table[:, 0].tolist()])
    ids = decode_blocks([data[a:b] for a, b in zip(cuts[:-1], cuts[1:])], freqs, block)[:n]
    flat = memoryview(ids.astype("<u4")).cast("B")
    for k in range(blocks):
        if zlib.crc32(flat[4 * k * block : 4 * min(n, (k + 1) * block)]) != table[k, 1]:
            raise CorruptBlock(f"block {k} fails its checksum")
    return doc_ids, counts, ids
