"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

Ids are coded by three orders of prediction. Order 0 is a distribution over all ids: the ids of a file are ranked by how
often they occur in it, an adaptive distribution over the magnitudes of ranks (their bit lengths) follows each block, and
ranks of one magnitude, which are about as frequent, share its part evenly. Orders 1 and 2 hold the id that they
expect after the last id and after the last two, with a confidence that grows with each hit and halves with each
miss. The expected ids get shares of the range that follow their confidences, and add up where both orders expect the same id;
what is left goes to order 0.

Every block starts from the same state, that of its file's ranks, so blocks are decoded each by itself, and are coded side by
side: each step takes one id of each block, as one element of arrays. All arithmetic is on integers, so any machine decodes the
same ids. The range has 48 bits and is written in 16-bit words; a carry runs back through the words written.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Slots of the tables of orders 1 and 2 in each block; bits of the order-0 distribution, the least part of a magnitude, and how fast it adapts.
SLOTS_1, SLOTS_2 = 1 << 9, 1 << 10
SCALE, FLOOR, RATE = 14, 8, 5
#: Steps whose ids are prepared at once.
CHUNK = 32
_LOW32, _LOW48 = (1 << 32) - 1, (1 << 48) - 1
#: Confidences are 0 to 7. Part of 65,536 that an expected id gets by its confidence, with order 1's after order 2 has taken its own.
_SHARE_1 = np.array([16, 2000, 6000, 12000, 18000, 25000, 32000, 42000])
_SHARE_2 = np.array([16, 5000, 14000, 23000, 31000, 39000, 46000, 55000])
_OF_2 = np.repeat(_SHARE_2, 8)
_OF_1 = ((65536 - _OF_2) * np.tile(_SHARE_1, 8)) >> 16
_REST = 65536 - _OF_1 - _OF_2
_LESS = np.array([k - k // 2 for k in range(8)], "i4")
_MORE = np.array([1] * 7 + [0], "i4")


@dataclass
class Ranks:
    """The ids of a file from the most frequent on, and the bounds of the magnitudes of ranks in the order-0 distribution."""

    ids: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Ranks:
        counts = np.bincount(ids, minlength=1)
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        n = int(len(order)).bit_length()
        edges = np.minimum((1 << np.arange(n + 1)) - 1, len(order))
        sums = np.concatenate([[0], np.cumsum(counts[order])])[edges]
        room = (1 << SCALE) - n * FLOOR
        return cls(order.astype("u2"), np.arange(n + 1) * FLOOR + sums * room // max(1, int(sums[-1]) if n else 1))

    def rank(self) -> np.ndarray:
        out = np.zeros(1 << 16, "u2")
        out[self.ids] = np.arange(len(self.ids))
        return out


class _Model:
    """The state of all blocks' models. Entries of tables are 8 * rank + confidence."""

    def __init__(self, lanes: int, ranks: Ranks):
        self.magnitudes = len(ranks.bounds) - 1
        self.lanes = np.arange(lanes)
        self.table_1, self.table_2 = np.full(lanes * SLOTS_1, 0xFFFF << 3, "i4"), np.full(lanes * SLOTS_2, 0xFFFF << 3, "i4")
        self.from_1, self.from_2 = self.lanes * SLOTS_1, self.lanes * SLOTS_2
        self.cumulative = np.repeat(ranks.bounds.astype("i2"), lanes).reshape(-1, lanes)
        self.flat = self.cumulative.reshape(-1)
        self.numbers = np.arange(1, self.magnitudes, dtype="i2")[:, None]
        self.least = self.numbers * np.int16(FLOOR)
        self.room = np.int16((1 << SCALE) - self.magnitudes * FLOOR)
        self.last, self.before = np.zeros(lanes, "i8"), np.zeros(lanes, "i8")

    def expect(self, n: int) -> None:
        last = self.last[:n]
        self.at_1 = (last & (SLOTS_1 - 1)) + self.from_1[:n]
        self.at_2 = ((last * 37 + self.before[:n]) & (SLOTS_2 - 1)) + self.from_2[:n]
        self.entry_1, self.entry_2 = self.table_1.take(self.at_1), self.table_2.take(self.at_2)
        self.level_1, self.level_2 = self.entry_1 & 7, self.entry_2 & 7
        self.levels = ((self.level_2 << 3) + self.level_1).astype("i8")
        self.rest = _REST.take(self.levels)

    def learn(self, wide: np.ndarray, magnitude: np.ndarray, hits_1: np.ndarray, hits_2: np.ndarray, n: int) -> None:
        """wide: 8 * rank; magnitude: that of the rank; hits: the blocks whose expected ids came."""
        fresh = wide | 1
        for table, at, entry, level, hits in (
            (self.table_1, self.at_1, self.entry_1, self.level_1, hits_1),
            (self.table_2, self.at_2, self.entry_2, self.level_2, hits_2),
        ):
            new = np.where(level > 1, entry - _LESS.take(level), fresh)
            new[hits] = entry[hits] + _MORE[level[hits]]
            table[at] = new
        inner = self.cumulative[1 : self.magnitudes, :n]
        inner += (self.least + (self.numbers > magnitude.astype("i2")) * self.room - inner) >> RATE
        self.before[:n] = self.last[:n] * 1021
        self.last[:n] = wide >> 3


def encode(ids: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> list[bytes]:
    """The code of each column of ids (steps x blocks), of which the first lengths are used; lengths don't grow."""
    lanes = len(lengths)
    if not lanes:
        return []
    model = _Model(lanes, ranks)
    low, width = np.zeros(lanes, "i8"), np.full(lanes, _LOW48)
    out = np.zeros((lanes, 2 * len(ids) + 8), "u2")
    flat, size = out.reshape(-1), out.shape[1]
    filled = model.lanes * size
    rank = ranks.rank()
    magnitude_of = (np.frexp(np.arange(1, (1 << 16) + 1))[1] - 1).astype("i8")
    counts = np.searchsorted(-lengths, -np.arange(len(ids)), "left").tolist()

    def carry(which: np.ndarray) -> None:
        at = filled[which] - 1
        while len(at):
            flat[at] += np.uint16(1)
            at = at[flat[at] == 0] - 1

    for step in range(int(lengths.max())):
        if step % CHUNK == 0:
            ranked = rank[ids[step : step + CHUNK]]
            magnitudes = magnitude_of[ranked]
            ranked = ranked.astype("i4")
            offsets = (ranked + 1) - (1 << magnitudes)
            wides, places = ranked << 3, magnitudes * lanes + model.lanes
        n, row = counts[step], step % CHUNK
        wide, magnitude, place, bits, offset = wides[row, :n], magnitudes[row, :n], places[row, :n], magnitudes[row, :n].copy(), offsets[row, :n]
        model.expect(n)
        # Most ids are no expected ones: code all by order 0, then put the hits right.
        below = (model.flat.take(place) * model.rest) >> SCALE
        share = ((model.flat.take(place + lanes) * model.rest) >> SCALE) - below
        start = below + (65536 - model.rest)
        hit_1, hit_2 = (model.entry_1 ^ wide) < 8, (model.entry_2 ^ wide) < 8
        hits_1, hits_2 = np.flatnonzero(hit_1), np.flatnonzero(hit_2)
        levels_1, levels_2 = model.levels[hits_1], model.levels[hits_2]
        share[hits_1], start[hits_1] = _OF_1[levels_1], _OF_2[levels_1]
        share[hits_2], start[hits_2] = _OF_2[levels_2] + _OF_1[levels_2] * hit_1[hits_2], 0
        for hits in (hits_1, hits_2):
            offset[hits], bits[hits] = 0, 0
        unit = width[:n] >> 16
        part = (share * unit) >> bits
        now = low[:n] + start * unit + offset * part
        over = np.flatnonzero(now > _LOW48)
        if len(over):
            carry(over)
            now &= _LOW48
        low[:n], width[:n] = now, part
        small = np.flatnonzero(part <= _LOW32)
        while len(small):
            own = low[small]
            to = filled[small]
            flat[to] = own >> 32
            filled[small] = to + 1
            low[small] = (own & _LOW32) << 16
            wider = width[small] << 16
            width[small] = wider
            small = small[wider <= _LOW32]
        model.learn(wide, magnitude, hits_1, hits_2, n)
    for shift in (32, 16, 0):
        flat[filled] = (low >> shift) & 0xFFFF
        filled += 1
    used = filled - model.lanes * size
    return [out[k, : used[k]].astype("<u2").tobytes() for k in range(lanes)]


def decode(codes: list[bytes], lengths: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The ids (steps x blocks) behind the codes of encode."""
    lanes = len(lengths)
    if not lanes:
        return np.zeros((0, 0), "u2")
    model = _Model(lanes, ranks)
    size = max(map(len, codes)) // 2 + 4
    words = np.zeros((lanes, size), "u2")
    for k, code in enumerate(codes):
        words[k, : len(code) // 2] = np.frombuffer(code, "<u2")
    flat, at = words.reshape(-1), model.lanes * size
    first = words[:, :3].astype("i8")
    code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
    at += 3
    end = (model.lanes + 1) * size - 1
    width = np.full(lanes, _LOW48)
    found = np.zeros((int(lengths.max()), lanes), "u2")
    counts = np.searchsorted(-lengths, -np.arange(len(found)), "left").tolist()
    for step, n in enumerate(counts):
        model.expect(n)
        base = 65536 - model.rest
        unit = width[:n] >> 16
        # Exact: the quotients are far from the next integer by more than a double's precision.
        place = np.minimum(code[:n] / unit, 65535).astype("i8")
        target = ((((place - base + 1) << SCALE) - 1) / model.rest).astype("i2")
        magnitude = np.add.reduce(model.cumulative[1 : model.magnitudes, :n] <= target, axis=0, dtype="i8")
        lane = magnitude * lanes + model.lanes[:n]
        below = (model.flat.take(lane) * model.rest) >> SCALE
        share = ((model.flat.take(lane + lanes) * model.rest) >> SCALE) - below
        start = below + base
        hits = np.flatnonzero(place < base)
        both = (model.entry_1[hits] ^ model.entry_2[hits]) < 8
        of_1, of_2 = _OF_1[model.levels[hits]], _OF_2[model.levels[hits]]
        from_2 = both | (place[hits] < of_2)
        share[hits] = np.where(both, of_1 + of_2, np.where(from_2, of_2, of_1))
        start[hits] = np.where(from_2, 0, of_2)
        magnitude[hits] = 0
        left = code[:n] - start * unit
        part = (share * unit) >> magnitude
        offset = np.minimum((left / part).astype("i8"), (1 << magnitude) - 1)
        offset[hits] = 0
        left -= offset * part
        wide = (((1 << magnitude) + offset - 1) << 3).astype("i4")
        wide[hits] = np.where(from_2, model.entry_2[hits], model.entry_1[hits]) & -8
        code[:n], width[:n] = left, part
        small = np.flatnonzero(part <= _LOW32)
        while len(small):
            from_ = at[small]
            code[small] = (code[small] << 16) | flat[np.minimum(from_, end[small])]
            at[small] = from_ + 1
            wider = width[small] << 16
            width[small] = wider
            small = small[wider <= _LOW32]
        rank = wide >> 3
        found[step, :n] = rank
        # The magnitude of expected ids isn't known from the code.
        magnitude[hits] = np.frexp(rank[hits] + 1.0)[1] - 1
        model.learn(wide, magnitude, np.flatnonzero((model.entry_1 ^ wide) < 8), np.flatnonzero((model.entry_2 ^ wide) < 8), n)
    return np.append(ranks.ids, np.zeros(1, "u2"))[np.minimum(found, len(ranks.ids))].astype("u2")
