"""Adaptive context-mixing range coder for sequences of ids.

A sequence is cut into blocks that are coded side by side: a numpy vector holds one value for
each block, a step codes one id of every block. The blocks of a group start from the same
state, share what they learn, are decoded together, and carry a checksum each.

Order 2 predicts the id last seen after the two ids before, order 1 the one after the id
before. Each has an adaptive probability of being right for its confidence. Their mixture,
whose weight adapts too, is refined by what came of the same two confidences and gives the
intervals of right predictions. All other ids fall to order 0: adaptive frequencies of the ids, and of
their magnitudes for ids that are rare so far. Intervals drive a range coder with 32-bit words and carries.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, and blocks coded side by side.
BLOCK = 2048
LANES = 4096

_U = np.uint64
_IDS = 1 << 16
#: Order 1 has a slot for each id, order 2 slots by a hash.
_TWO_BITS = 18
_HASH = _U(0x9E3779B97F4A7C15)
#: Scales of the predictions' and of order 0's intervals.
_PART_BITS, _FREQ_BITS = 16, 20
#: Ids after which intervals and frequencies are renewed at the latest; before, when there are a quarter more.
_RENEW = 1 << 18
#: Least interval of a prediction, and upper end of both: what is left has room for a second interval.
_LEAST, _MOST = 64, 15 << 12
#: Ids of a magnitude: those whose successors have as many bits.
_MAGNITUDES = np.array([*(1 << m for m in range(16)), 1])
# by confidence after a miss and, from 8 on, after a hit
_CONFIDENCE = np.array([0, *[-1] * 7, *[1] * 7, 0], np.int32)
_CHANCES = np.array([600, 2000, 6000, 12000, 20000, 28000, 36000, 44000]) / 65536
#: Ids that the predictions, and that the frequencies by magnitude, count for.
_TRUST, _RARE = 32, 4096
#: Which prediction is right: order 2, order 1 alone, none.
_TWO, _ONE, _NONE = range(3)


class Model:
    """Predictions, their intervals and order 0's frequencies, shared by ``n`` blocks at the same step."""

    def __init__(self, n: int):
        # both orders, 1 before 2: an id and, in the low three bits, the confidence in it
        self.table = np.zeros(_IDS + (1 << _TWO_BITS), np.int32)
        self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # by what is right, whether both orders predict the same, and the confidences of 1 and 2
        self.came = np.zeros((3, 2, 8, 8), np.int64)
        self.count = np.zeros(_IDS, np.int64)
        self.outcomes: list[np.ndarray] = []
        self.coded: list[np.ndarray] = []
        self.seen = self.new = 0
        self._intervals()
        self._frequencies()

    def keep(self, n: int) -> None:
        """Goes on with the first ``n`` blocks; the others have ended."""
        self.one, self.two = self.one[:n], self.two[:n]

    def _intervals(self) -> None:
        """Begin and size of each outcome's interval, of 2**_PART_BITS, from the outcomes so far."""
        came = self.came
        seen, right1, right2 = came.sum(axis=(0, 1)), came[_ONE].sum(axis=0) + came[_TWO, 1], came[_TWO].sum(axis=0)
        one = (right1.sum(axis=1) + _TRUST * _CHANCES) / (seen.sum(axis=1) + _TRUST)
        two = (right2.sum(axis=0) + _TRUST * _CHANCES) / (seen.sum(axis=0) + _TRUST)
        apart1, apart2 = int(came[_ONE, 0].sum()), int(came[_TWO, 0].sum())
        weight = (apart2 + 5) / (apart1 + apart2 + 8)
        mixed1, mixed2 = (1 - weight) * one[:, None], weight * two[None, :]
        share = (1 << _PART_BITS) / (came.sum(axis=0) + _TRUST)
        size1 = (came[_ONE, 0] + _TRUST * mixed1) * share[0]
        size2 = (came[_TWO] + _TRUST * np.stack((np.broadcast_to(mixed2, (8, 8)), mixed1 + mixed2))) * share
        end2 = np.clip(size2.astype(np.int64), _LEAST, _MOST - _LEAST)
        end1 = end2.copy()
        end1[0] = np.clip(end2[0] + np.maximum(size1.astype(np.int64), _LEAST), None, _MOST)
        end1[0] = np.maximum(end1[0], end2[0] + _LEAST)
        edges = np.stack((np.zeros_like(end2), end2, end1, np.full_like(end2, 1 << _PART_BITS))).reshape(4, -1).astype(_U)
        self.end2, self.end1 = edges[1], edges[2]
        self.begin, self.size = edges[:3].reshape(-1), (edges[1:] - edges[:3]).reshape(-1)

    def _frequencies(self) -> None:
        """Begin and size of each id's interval, of 2**_FREQ_BITS; a last one is the whole."""
        total = int(self.count.sum())
        by = np.add.reduceat(self.count, np.cumsum(_MAGNITUDES) - _MAGNITUDES)
        rare = _RARE * ((by + 1) / (total + len(by)) / _MAGNITUDES)
        share = np.repeat(rare, _MAGNITUDES)
        share += self.count
        share *= ((1 << _FREQ_BITS) - _IDS) / (total + _RARE)
        size = share.astype(np.int64)
        size += 1
        size[np.argmax(size)] += (1 << _FREQ_BITS) - int(size.sum())
        self.id_size = size
        # begin and size in one number
        self.spans = np.append((np.cumsum(size) - size) << 32 | size, 1 << _FREQ_BITS).view(_U)

    def predict(self) -> np.ndarray:
        """Finds the ids of orders 1 and 2; whether they are the same, and both confidences."""
        n = len(self.one)
        self.slot = np.empty(2 * n, np.int64)
        self.slot[:n] = self.one
        code = ((self.two << 16) | self.one).view(_U)
        code *= _HASH
        code >>= _U(64 - _TWO_BITS)
        np.add(code.view(np.int64), _IDS, out=self.slot[n:])
        self.held = self.table.take(self.slot).reshape(2, n)
        self.sure, self.guess = self.held & 7, self.held >> 3
        place = (self.guess[0] == self.guess[1]).astype(np.int64) << 6
        place |= self.sure[0] << 3
        place |= self.sure[1]
        return place

    def update(self, ids: np.ndarray, outcome: np.ndarray, coded: np.ndarray) -> None:
        """Learns the ids that came, and those coded by order 0. Of blocks in the same slot the last one stays."""
        state = self.sure | ((self.guess == ids).astype(np.int32) << 3)
        # where the confidence is gone the id gives way
        fresh = (ids << 3 | 1) - self.held
        fresh *= state == 0
        fresh += _CONFIDENCE.take(state)
        fresh += self.held
        self.table[self.slot] = fresh.reshape(-1)
        self.two, self.one = self.one, ids.astype(np.int64)
        self.outcomes.append(outcome)
        self.coded.append(coded)
        self.new += len(ids)
        if self.new >= min(_RENEW, self.seen // 4):
            self.seen, self.new = self.seen + self.new, 0
            self.came += np.bincount(np.concatenate(self.outcomes), minlength=self.came.size).reshape(self.came.shape)
            self.count += np.bincount(np.concatenate(self.coded), minlength=_IDS + 1)[:_IDS]
            self.outcomes, self.coded = [], []
            self._intervals()
            self._frequencies()


_LOW32 = _U(0xFFFFFFFF)
_WORD, _PART, _FREQ = _U(32), _U(_PART_BITS), _U(_FREQ_BITS)


class Writer:
    """Range encoders of ``n`` blocks."""

    def __init__(self, n: int, words: int):
        self.low, self.range = np.zeros(n, _U), np.full(n, 0xFFFFFFFFFFFFFFFF, _U)
        self.whole = self.low
        self.out, self.used = np.zeros(n * words, np.uint32), np.arange(n) * words
        self.begin = self.used.tolist()

    def put(self, model: Model, outcome: np.ndarray, ids: np.ndarray) -> None:
        """Narrows all blocks to their outcome and then to their id, which may be the whole."""
        step = self.range >> _PART
        add = model.begin.take(outcome) * step
        step *= model.size.take(outcome)
        step >>= _FREQ
        span = model.spans.take(ids)
        add += (span >> _WORD) * step
        span &= _LOW32
        np.multiply(span, step, out=self.range)
        self.low += add
        carry = np.flatnonzero(self.low < add)
        at = self.used.take(carry)
        while len(at):
            at -= 1
            self.out[at] += np.uint32(1)
            at = at[self.out.take(at) == 0]
        full = np.flatnonzero(self.range <= _LOW32)
        low, at = self.low.take(full), self.used.take(full)
        self.out[at] = low >> _WORD
        self.low[full] = low << _WORD
        self.range[full] = self.range.take(full) << _WORD
        self.used[full] = at + 1

    def keep(self, n: int) -> None:
        self.low, self.range = self.low[:n], self.range[:n]

    def finish(self, row: int) -> bytes:
        low = int(self.whole[row])
        tail = np.array([low >> 32, low & 0xFFFFFFFF], np.uint32)
        return np.concatenate((self.out[self.begin[row] : self.used[row]], tail)).astype("<u4").tobytes()


class Reader:
    """Range decoders of several blocks."""

    def __init__(self, blocks: list[bytes]):
        words = [np.frombuffer(b, "<u4") for b in blocks]
        data = np.zeros((len(words), max(map(len, words)) + 2), np.uint32)
        for i, w in enumerate(words):
            data[i, : len(w)] = w
        self.range = np.full(len(words), 0xFFFFFFFFFFFFFFFF, _U)
        # how far the code is above the lower end
        self.above = (data[:, 0].astype(_U) << _WORD) | data[:, 1]
        self.data, begin = data.reshape(-1), np.arange(len(words)) * data.shape[1]
        self.used, self.last = begin + 2, begin + data.shape[1] - 1

    def outcome(self, model: Model, place: np.ndarray) -> np.ndarray:
        step = self.range >> _PART
        missed2 = self.above >= model.end2.take(place) * step
        missed1 = self.above >= model.end1.take(place) * step
        outcome = place + ((missed2.view(np.int8) + missed1.view(np.int8)).astype(np.int64) << 7)
        self.above -= model.begin.take(outcome) * step
        step *= model.size.take(outcome)
        self.range = step >> _FREQ
        return outcome

    def share(self) -> np.ndarray:
        """Where the code lies, of 2**_FREQ_BITS; that of damaged blocks may lie outside."""
        return (self.above // self.range).view(np.int64)

    def take(self, model: Model, ids: np.ndarray) -> None:
        span = model.spans.take(ids)
        self.above -= (span >> _WORD) * self.range
        span &= _LOW32
        self.range *= span
        full = np.flatnonzero(self.range <= _LOW32)
        at = self.used.take(full)
        word = self.data.take(np.minimum(at, self.last.take(full)))
        self.above[full] = (self.above.take(full) << _WORD) | word
        self.range[full] = self.range.take(full) << _WORD
        self.used[full] = at + 1

    def keep(self, n: int) -> None:
        self.above, self.range = self.above[:n], self.range[:n]


def encode(ids: np.ndarray, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """Number of ids, CRC-32 of the ids (little-endian, 32 bits) and code of each block."""
    if len(ids) and ids.max() >= _IDS:
        raise ValueError("ids must fit in 16 bits")
    sizes = [min(block, len(ids) - b) for b in range(0, len(ids), block)]
    out = []
    for b in range(0, len(sizes), LANES):
        group = sizes[b : b + LANES]
        part = ids[b * block : b * block + sum(group)]
        out += zip(group, checksums(part, group), _encode(part, group, block), strict=True)
    return out


def checksums(ids: np.ndarray, sizes: list[int]) -> list[int]:
    raw = memoryview(ids.astype("<u4").tobytes())
    ends = np.cumsum(sizes).tolist()
    return [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, sizes, strict=True)]


def _encode(ids: np.ndarray, sizes: list[int], block: int) -> list[bytes]:
    n = len(sizes)
    grid = turned(np.append(ids, np.zeros(n * max(sizes) - len(ids), ids.dtype)).reshape(n, -1).astype(np.int32))
    model, writer = Model(n), Writer(n, max(sizes) + 4)
    for t, x in enumerate(grid):
        now = n if t < sizes[-1] else n - 1  # only the last block is shorter
        if now != len(model.one):
            if not now:
                break
            model.keep(now)
            writer.keep(now)
        x = x[:now]
        place = model.predict()
        missed = model.guess != x
        none = missed[0] & missed[1]
        outcome = place + ((missed[1].view(np.int8) + none.view(np.int8)).astype(np.int64) << 7)
        coded = np.where(none, x, np.int32(_IDS))
        writer.put(model, outcome, coded)
        model.update(x, outcome, coded)
    return [writer.finish(i) for i in range(n)]


def turned(grid: np.ndarray) -> np.ndarray:
    """Columns as rows, a few at a time: strides as long as a block's would miss the cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for a in range(0, len(grid), 64):
        for b in range(0, len(out), 64):
            out[b : b + 64, a : a + 64] = grid[a : a + 64, b : b + 64].T
    return out


class BadBlock(ValueError):
    """A block whose ids do not have its checksum."""


def decode(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of the blocks, one after another: all that ``encode`` returned."""
    out = []
    for b in range(0, len(blocks), LANES):
        group = blocks[b : b + LANES]
        sizes = [g[0] for g in group]
        ids = _decode(sizes, [g[2] for g in group])
        if checksums(ids, sizes) != [g[1] for g in group]:
            raise BadBlock("a block fails its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _decode(sizes: list[int], codes: list[bytes]) -> np.ndarray:
    n = len(sizes)
    grid, lanes = np.zeros((max(sizes), n), np.int32), np.arange(n)
    model, reader = Model(n), Reader(codes)
    for t in range(max(sizes)):
        now = n if t < sizes[-1] else n - 1
        if now != len(model.one):
            model.keep(now)
            reader.keep(now)
        if not model.outcomes:  # the frequencies are new
            by_share = np.repeat(np.arange(_IDS, dtype=np.uint16), model.id_size)
        place = model.predict()
        outcome = reader.outcome(model, place)
        ids = by_share.take(reader.share(), mode="clip").astype(np.int32)
        right = outcome >> 7
        coded = np.where(right == _NONE, ids, np.int32(_IDS))
        reader.take(model, coded)
        right *= now
        right += lanes[:now]
        x = np.concatenate((model.guess[1], model.guess[0], ids)).take(right)
        model.update(x, outcome, coded)
        grid[t, :now] = x
    return turned(grid).reshape(-1)[: sum(sizes)].astype(np.uint32)
