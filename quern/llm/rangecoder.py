"""Adaptive context-mixing range coder for token ids.

A block is coded by itself: its model starts anew and its header holds checksums. Its ids are dealt
into lanes, runs of equal length that are coded side by side with one shared model, which learns from
all lanes after each step; so every step is a handful of array operations.

The model mixes three predictions of the next id. Order 0 gives each id a share by its count so far.
Order 1 and order 2 look up the id that followed the last one or two ids, with a confidence; each adds a
share to that id, as large as its record at that confidence has earned. The mixture's cumulative shares
drive a 64-bit range coder that emits 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1 << 20  # ids in a block
LANES = 4096
STEPS_LEAST = 64  # a short block has fewer lanes rather than fewer steps
ORDER_1, ORDER_2 = 1 << 16, 1 << 18  # contexts, by hash
TOP = 16  # levels of confidence, in four bits
GAIN = 32  # what one occurrence adds to an id's share
MOST_ODDS = 63  # of a hit
MAGIC = b"QRC1"
HEAD = struct.Struct("<4sIIIII")  # magic, ids, lanes, alphabet, crc32 of the ids, crc32 of the payload

_U32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_LEAST = np.uint64(1 << 32)
# of the confidence, after a miss (halved) and after a hit (one more) at each level; a miss at 0 puts another id there
_CHANGE = np.array([d for c in range(TOP) for d in ((c >> 1) - c, int(c < TOP - 1))], np.int32)


class Model:
    """Shares of the next ids in all lanes."""

    def __init__(self, lanes: int, alphabet: int):
        # all shares together, of order 0 and of two guesses, must leave a range of 32 bits at least a unit
        if (1 + 2 * MOST_ODDS) * (alphabet + GAIN * BLOCK) >= 1 << 32:
            raise ValueError("too large an alphabet")
        self.alphabet = alphabet
        self.counts = np.zeros(alphabet, np.int64)
        self.recent: list[np.ndarray] = []
        self.step = 0
        self.prev = np.zeros(lanes, np.int64)
        self.prev2 = np.zeros(lanes, np.int64)
        # guessed id * TOP + confidence, for each context
        self.table = [np.zeros(ORDER_1, np.int32), np.zeros(ORDER_2, np.int32)]
        self.record = [np.tile(np.array([8, 1], np.int64), TOP) for _ in range(2)]  # misses and hits by level
        self._share()

    def _share(self) -> None:
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.alphabet)
            self.recent = []
        self.freq = 1 + GAIN * self.counts
        self.cum = np.concatenate([[0], np.cumsum(self.freq)])
        self.cum32 = self.cum.astype(np.int32)
        self.total = int(self.cum[-1])
        # odds of a hit, as shares beside the total of order 0
        self.add = [np.minimum(self.total * r[1::2] // np.maximum(r[0::2], 1), MOST_ODDS * self.total) for r in self.record]

    def predict(self) -> None:
        at1 = self.prev & (ORDER_1 - 1)
        at2 = ((self.prev * 0x9E3779B1 + self.prev2 * 0x85EBCA77) >> 7) & (ORDER_2 - 1)
        self.at = (at1, at2)
        self.entry = [t[a] for t, a in zip(self.table, self.at, strict=True)]
        self.p = [e >> 4 for e in self.entry]
        self.c = [e & (TOP - 1) for e in self.entry]
        self.m = [t[c] for t, c in zip(self.add, self.c, strict=True)]
        self.all = self.total + self.m[0] + self.m[1]

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ids' shares."""
        begin, size = self.cum[ids], self.freq[ids]
        for p, m in zip(self.p, self.m, strict=True):
            begin = begin + m * (p < ids)
            size = size + m * (p == ids)
        return begin, size

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose shares hold the places ``v``."""
        (p1, p2), (m1, m2), cum = self.p, self.m, self.cum
        a, b = np.minimum(p1, p2), np.maximum(p1, p2)
        ma, both = np.where(p2 < p1, m2, m1), m1 + m2
        # the lower guess, with a share added, then the higher one; a place beyond a share is as far beyond in the shares of order 0
        past_a, past_b = v >= cum[a + 1] + ma, v >= cum[b + 1] + both
        other = np.flatnonzero(np.where(past_a, (v < cum[b] + ma) | past_b, v < cum[a]))
        ids = np.where(past_a, b, a)
        # these are not guessed; sums of order 0 stay below 2**31, and places about in order are found faster
        x = v[other] - np.where(past_b[other], both[other], ma[other] * past_a[other])
        order = np.argsort((x >> max(0, self.total.bit_length() - 16)).astype(np.uint16), kind="stable")
        ids[other[order]] = np.searchsorted(self.cum32, x[order].astype(np.int32), "right") - 1
        return ids.astype(np.int64)

    def learn(self, ids: np.ndarray) -> None:
        small = ids.astype(np.int32)
        for k in range(2):
            level = 2 * self.c[k] + (self.p[k] == small)
            self.record[k] += np.bincount(level, minlength=2 * TOP)
            self.table[k][self.at[k]] = np.where(level == 0, small << 4, self.entry[k] + _CHANGE[level])
        self.prev2, self.prev = self.prev, ids
        self.recent.append(ids)
        self.step += 1
        if self.step < 8 or self.step % 8 == 0:
            self._share()


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // STEPS_LEAST))


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """A block of at most BLOCK ids below ``alphabet``."""
    n = len(ids)
    lanes = _lanes(n)
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    out = np.zeros((lanes, steps + 4), np.uint32)
    at = np.zeros(lanes, np.int64)
    low = np.zeros(lanes, np.uint64)
    size = np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    model = Model(lanes, alphabet)
    for row in grid:
        model.predict()
        begin, own = model.span(row)
        unit = size // model.all.view(np.uint64)
        new = low + unit * begin.view(np.uint64)
        over = np.flatnonzero(new < low)
        back = at[over] - 1
        while len(over):  # the carry goes into the words that are out already
            out[over, back] += np.uint32(1)
            more = out[over, back] == 0
            over, back = over[more], back[more] - 1
        low, size = new, unit * own.view(np.uint64)
        small = np.flatnonzero(size < _LEAST)
        if len(small):
            out[small, at[small]] = (low[small] >> _U32).astype(np.uint32)
            at[small] += 1
            low[small] <<= _U32
            size[small] <<= _U32
        model.learn(row)
    every = np.arange(lanes)
    for word in (low >> _U32, low & _LOW):
        out[every, at] = word.astype(np.uint32)
        at += 1
    words = out[np.arange(steps + 4)[None, :] < at[:, None]]
    payload = at.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    raw = np.ascontiguousarray(ids, "<u4").tobytes()
    return HEAD.pack(MAGIC, n, lanes, alphabet, zlib.crc32(raw), zlib.crc32(payload)) + payload


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block, as unsigned 32-bit integers; ValueError if a checksum is wrong."""
    magic, n, lanes, alphabet, crc, crc_payload = HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(memoryview(data)[HEAD.size :]) != crc_payload:
        raise ValueError("damaged block")
    lengths = np.frombuffer(data, "<u4", lanes, HEAD.size).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u4", offset=HEAD.size + 4 * lanes).astype(np.uint64), np.zeros(2, np.uint64)])
    at = np.cumsum(lengths) - lengths
    code = (words[at] << _U32) | words[at + 1]
    at += 2
    steps = -(-n // lanes)
    grid = np.empty((steps, lanes), np.int64)
    size = np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    model = Model(lanes, alphabet)
    for t in range(steps):
        model.predict()
        unit = size // model.all.view(np.uint64)
        ids = model.find(np.minimum((code // unit).view(np.int64), model.all - 1))
        begin, own = model.span(ids)
        code = code - unit * begin.view(np.uint64)
        size = unit * own.view(np.uint64)
        small = np.flatnonzero(size < _LEAST)
        if len(small):
            code[small] = (code[small] << _U32) | words[at[small]]
            at[small] += 1
            size[small] <<= _U32
        grid[t] = ids
        model.learn(ids)
    out = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(out.tobytes()) != crc:
        raise ValueError("damaged block")
    return out


def encode(ids: np.ndarray, alphabet: int) -> list[bytes]:
    return [encode_block(ids[k : k + BLOCK], alphabet) for k in range(0, len(ids), BLOCK)]


def decode(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, "<u4"), *map(decode_block, blocks)])
