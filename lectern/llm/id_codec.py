"""Adaptive context-mixing range coding of token ids, many blocks side by side.

A file begins with its order-0 table: how often each id stands in it, scaled to 2**20.  A block
is coded from that table and nothing else: every model starts afresh in it, and it carries its
own checksum, so any block can be read alone with the header.  In a block two tables remember the
id last seen after the one and the two ids before, and how sure they are.  The order-2 candidate,
or else the order-1 one, is first asked for: the chance that it is right is mixed in the logistic
domain from the track records of order 2 and order 1 and from order 0's own chance for it, with
weights that learn after every id.  If it is wrong and the order-1 candidate is another one, that
is asked for next, in the same way.  Any other id is coded under the order-0 table.  All
arithmetic is in integers, so that a reader on another machine gets the same numbers.

Blocks are lanes of the arrays: one step codes one id of each.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"LCMX"
VERSION = 2
HEAD = "<4sHIQIII"  # magic, version, ids in a block, ids, blocks, bytes of table and index, their checksum
BLOCK = 1024
SLOTS = 1024
#: Registers have 48 bits and move 16 at a time; a step narrows by at most 2**20.
WORD, TOP, BOTTOM, SHARE = (1 << 48) - 1, 1 << 32, 1 << 24, 20
#: log odds in 1/256 by probability in 1/4096, and back.
STRETCH = np.array([round(256 * math.log(max(p, 1) / (4096 - max(p, 1)))) for p in range(4096)], np.int64)
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int64)
HALVING = 177  # 256 ln 2
#: Ids have at most as many bits as shares, so every id of a file can have a share.
MOST_BITS = SHARE
RATE = 5


class Table:
    """Order 0: the shares of the ids of a file."""

    def __init__(self, names: np.ndarray, shares: np.ndarray):
        self.names, self.shares = names, shares
        self.bits = max(1, int(names[-1]).bit_length())
        self.size = np.zeros(1 << self.bits, np.int64)
        self.size[names] = shares
        starts = np.cumsum(shares) - shares
        self.start = np.zeros(1 << self.bits, np.int64)
        self.start[names] = starts
        # how far below even odds the share is, by its bit length; ids that never stand are far off
        lengths = np.frexp(self.size.astype(np.float64))[1].astype(np.int64)
        self.odds = HALVING * (lengths - SHARE - 1)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        counts = counts[names].astype(np.int64)
        shares = 1 + counts * ((1 << SHARE) - len(names)) // len(ids)
        shares[np.argmax(counts)] += (1 << SHARE) - shares.sum()
        return cls(names, shares)

    def by_place(self) -> np.ndarray:
        return np.repeat(self.names.astype(np.int32), self.shares)

    def pack(self) -> bytes:
        return zlib.compress(np.diff(self.names, prepend=0).astype("<u4").tobytes() + self.shares.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        half = len(both) // 2
        return cls(np.cumsum(both[:half]), both[half:])


class Mixer:
    """The chance that a candidate is right, in each lane: track records by cell, mixed with the
    order-0 odds."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.track = [np.full(n * cells, 1 << 14, np.int64), np.full(n * cells, 1 << 14, np.int64)]
        self.weights = [np.full(n, 30000, np.int64), np.full(n, 26000, np.int64), np.zeros(n, np.int64)]

    def chance(self, lane: np.ndarray, cells: tuple[np.ndarray, np.ndarray], odds: np.ndarray) -> np.ndarray:
        self.lane = lane
        self.at = [lane * self.cells + c for c in cells]
        self.seen = [t[i] for t, i in zip(self.track, self.at)]
        self.odds = [*(STRETCH[p >> 4] for p in self.seen), odds]
        self.held = [w[lane] for w in self.weights]
        dot = (self.held[0] * self.odds[0] + self.held[1] * self.odds[1] + self.held[2] * self.odds[2]) >> 16
        self.p = SQUASH[np.minimum(np.maximum(dot, -2047), 2047) + 2047]
        return self.p

    def learn(self, hit: np.ndarray) -> None:
        error, aim = (hit << 12) - self.p, hit * 65535
        for w, held, odds in zip(self.weights, self.held, self.odds):
            w[self.lane] = held + (odds * error >> 10)
        for track, at, seen in zip(self.track, self.at, self.seen):
            track[at] = seen + ((aim - seen) >> RATE)


class Lanes:
    """The models of n blocks.  A table entry holds an id and, above it, how sure it is (0-3).

    A step takes the first k lanes, those whose block goes on."""

    def __init__(self, n: int, table: Table):
        self.table, self.bits, self.lane, self.base = table, table.bits, np.arange(n), np.arange(n) * SLOTS
        self.entries = [np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32)]
        self.first, self.second = Mixer(n, 16), Mixer(n, 4)
        self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates, and the chances out of 4096 that they are right."""
        one, two, base = self.one[:k], self.two[:k], self.base[:k]
        self.at = base + ((one * 2654435761 >> 9) & (SLOTS - 1)), base + ((one * 40503 + two * 2654435761 >> 9) & (SLOTS - 1))
        self.held = tuple(e[i].astype(np.int64) for e, i in zip(self.entries, self.at))
        self.sure = tuple(h >> self.bits for h in self.held)
        self.names = tuple(h & ((1 << self.bits) - 1) for h in self.held)
        (s1, s2), (n1, n2) = self.sure, self.names
        known = s2 > 0
        candidate = np.where(known, n2, n1)
        same = known & (n1 == n2) & (s1 > 0)
        cell = s2 * 4 + s1
        self.other = known & (s1 > 0) & ~same
        chance = self.first.chance(self.lane[:k], (cell, s1 * 2 + same), self.table.odds[candidate])
        return candidate, chance

    def predict_other(self, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lanes whose candidate was wrong: those with another, these, their chances."""
        m = wrong[self.other[wrong]]
        named = self.names[0][m]
        return m, named, self.second.chance(m, (self.sure[0][m], self.sure[1][m]), self.table.odds[named])

    def update(self, k: int, ids: np.ndarray) -> None:
        for entries, at, held, sure, name in zip(self.entries, self.at, self.held, self.sure, self.names):
            same = (name == ids) & (sure > 0)
            # right: surer, up to 3; wrong: half as sure, and replaced when no longer so
            kept = np.where(sure > 1, name | (sure >> 1 << self.bits), ids | (1 << self.bits))
            entries[at] = np.where(same, held + np.where(sure < 3, 1 << self.bits, 0), kept)
        self.two[:k] = self.one[:k]
        self.one[:k] = ids


class Coder:
    """Interval arithmetic of all lanes; a subclass moves the words."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, WORD, np.int64)

    def narrow(self, w, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Lanes w (a slice or indexes) go on with [start, start + size) times unit."""
        low = self.low[w] = (self.low[w] + unit * start) & WORD
        span = self.range[w] = unit * size
        same = (low ^ (low + span)) < TOP  # a sum past 48 bits differs in a higher bit
        some = np.flatnonzero(same | (span < BOTTOM))
        w = some if isinstance(w, slice) else w[some]
        low, span, same = low[some], span[some], same[some]
        while len(w):
            span = np.where(same, span, -low & (BOTTOM - 1))
            self.shift(w, low)
            self.low[w], self.range[w] = low, span = (low << 16) & WORD, (span << 16) & WORD
            same = (low ^ (low + span)) < TOP
            go = np.flatnonzero(same | (span < BOTTOM))
            w, low, span, same = w[go], low[go], span[go], same[go]

    def binary(self, w, chance: np.ndarray, right: np.ndarray) -> None:
        unit = self.range[w] >> 12
        self.narrow(w, unit, np.where(right, 0, chance), np.where(right, chance, 4096 - chance))


class Encoder(Coder):
    def __init__(self, n: int, longest: int):
        super().__init__(n)
        self.width = longest * 4 + 8
        self.out = np.zeros(n * self.width, np.uint16)
        self.used = np.arange(n) * self.width

    def shift(self, w: np.ndarray, low: np.ndarray) -> None:
        at = self.used[w]
        self.out[at] = low >> 32
        self.used[w] = at + 1

    def finish(self) -> list[bytes]:
        w = np.arange(len(self.low))
        for _ in range(3):
            self.shift(w, self.low)
            self.low = (self.low << 16) & WORD
        return [self.out[i * self.width : self.used[i]].astype("<u2").tobytes() for i in range(len(w))]


class Decoder(Coder):
    def __init__(self, coded: list[bytes]):
        super().__init__(len(coded))
        width = max(map(len, coded)) // 2 + 16
        self.data = np.zeros(len(coded) * width, np.int64)
        for i, c in enumerate(coded):
            self.data[i * width : i * width + len(c) // 2] = np.frombuffer(c, "<u2")
        self.used = np.arange(len(coded)) * width
        self.code = np.zeros(len(coded), np.int64)
        for _ in range(3):
            self.code = (self.code << 16) | self.data[self.used]
            self.used += 1

    def shift(self, w: np.ndarray, low: np.ndarray) -> None:
        at = self.used[w]
        self.code[w] = ((self.code[w] << 16) | self.data[at]) & WORD
        self.used[w] = at + 1

    def aim(self, w, unit: np.ndarray, most) -> np.ndarray:
        return np.minimum(((self.code[w] - self.low[w]) & WORD) // unit, most)

    def asked(self, w, chance: np.ndarray) -> np.ndarray:
        right = ((self.code[w] - self.low[w]) & WORD) < (self.range[w] >> 12) * chance
        self.binary(w, chance, right)
        return right


def lanes_of(n: int, block: int) -> np.ndarray:
    """Sizes of the blocks of n ids."""
    full, rest = divmod(n, block)
    return np.array([block] * full + ([rest] if rest else []), np.int64)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file of an array of ids below 2**20: header, order-0 table, index of blocks, blocks."""
    sizes = lanes_of(len(ids), block)
    n = len(sizes)
    if not n:
        return struct.pack(HEAD, MAGIC, VERSION, block, 0, 0, 0, 0)
    if int(ids.max()) >> MOST_BITS or int(ids.min()) < 0:
        raise ValueError(f"ids must be below {1 << MOST_BITS}")
    grid = np.zeros((n, block), np.int64)
    grid.ravel()[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    table = Table.of(ids)
    lanes, coder = Lanes(n, table), Encoder(n, int(sizes.max()))
    for i in range(int(sizes.max())):
        k = n if i < sizes[-1] else n - 1
        now = grid[i, :k]
        candidate, chance = lanes.predict(k)
        right = now == candidate
        coder.binary(slice(0, k), chance, right)
        lanes.first.learn(right.astype(np.int64))
        m = np.flatnonzero(~right)
        if len(m):
            other, named, chance = lanes.predict_other(m)
            if len(other):
                hit = now[other] == named
                coder.binary(other, chance, hit)
                lanes.second.learn(hit.astype(np.int64))
                right[other[hit]] = True
                m = np.flatnonzero(~right)
            coder.narrow(m, coder.range[m] >> SHARE, table.start[now[m]], table.size[now[m]])
        lanes.update(k, now)
    parts = coder.finish()
    raw = ids.astype("<u4")
    ends = np.cumsum(sizes)
    index = np.array([[size, zlib.crc32(raw[end - size : end].tobytes()), len(p)] for size, end, p in zip(sizes.tolist(), ends.tolist(), parts)], "<u4").tobytes()
    packed = table.pack()
    front = struct.pack("<I", len(packed)) + packed + index
    return struct.pack(HEAD, MAGIC, VERSION, block, len(ids), n, len(front), zlib.crc32(front)) + front + b"".join(parts)


def decode(file: bytes) -> np.ndarray:
    """The ids of a file; raises ValueError where a header or a checksum is wrong."""
    magic, version, _, total, n, size, crc = struct.unpack_from(HEAD, file)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block file of this version")
    at = struct.calcsize(HEAD)
    front = file[at : at + size]
    if zlib.crc32(front) != crc:
        raise ValueError("the header does not match its checksum")
    if not n:
        return np.zeros(0, np.uint32)
    at += size
    (packed,) = struct.unpack_from("<I", front)
    table = Table.unpack(front[4 : 4 + packed])
    index = np.frombuffer(front[4 + packed :], "<u4").reshape(n, 3)
    coded = []
    for length in index[:, 2].tolist():
        coded.append(file[at : at + length])
        at += length
    sizes = index[:, 0].astype(np.int64)
    grid = np.zeros((int(sizes.max()), n), np.int64)
    lanes, coder, by_place = Lanes(n, table), Decoder(coded), table.by_place()
    for i in range(int(sizes.max())):
        k = n if i < sizes[-1] else n - 1
        now, chance = lanes.predict(k)
        right = coder.asked(slice(0, k), chance)
        lanes.first.learn(right.astype(np.int64))
        m = np.flatnonzero(~right)
        if len(m):
            other, named, chance = lanes.predict_other(m)
            if len(other):
                hit = coder.asked(other, chance)
                lanes.second.learn(hit.astype(np.int64))
                now[other[hit]] = named[hit]
                right[other[hit]] = True
                m = np.flatnonzero(~right)
            unit = coder.range[m] >> SHARE
            now[m] = by_place[coder.aim(m, unit, (1 << SHARE) - 1)]
            coder.narrow(m, unit, table.start[now[m]], table.size[now[m]])
        lanes.update(k, now)
        grid[i, :k] = now
    ids = np.concatenate([grid[: sizes[i], i] for i in range(n)] if sizes[-1] != sizes[0] else [grid.T.ravel()]).astype(np.uint32)
    at = 0
    for size, crc, _ in index.tolist():
        if zlib.crc32(ids[at : at + size].astype("<u4").tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
        at += size
    if at != total:
        raise ValueError("blocks are missing")
    return ids
