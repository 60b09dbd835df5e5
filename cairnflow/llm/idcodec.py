"""Token-id files: an adaptive, context-mixing range coder over independently reset, checksummed blocks.

Documents are range-partitioned and sorted by id; a task encodes its documents with the tokenizers library, appends the
end id to each, and writes one file. The id stream is cut into blocks of BLOCK ids, and up to LANES blocks are a chunk.
Each block starts from fresh models and carries the CRC-32 of its ids, so it decodes alone and damage is found. The blocks
of a chunk are coded in lockstep: numpy does one step for all of them at a time.

Symbols. A pre-token's ids are a run. Runs that are frequent in a chunk, and frequent pairs of neighbouring ids outside of
these, are symbols of that chunk, stored with it, and take one step; all else is coded id by id. None lies in two blocks.

Models. Order-2 and order-1 contexts (hashed) each predict the next symbol and hold a confidence. Whether the order-2
prediction, else the order-1 prediction holds is told with probabilities that adapt: each is the mean of one kept by
confidences and one kept by recent outcomes. A symbol that neither predicts takes its order-0 share of what is left: counts
of the chunk's symbols, stored with it. The range coder has 64-bit low and range and 32-bit output words; carries go back
into the words. Blocks that have ended leave the lockstep, the longest come first; one that doesn't end with its words is
damaged. Ids may be any 32-bit numbers: those too rare for a chunk's table follow an escape as they are.

File: magic; chunks (order-0 table and runs, deflated, then the blocks' words); index, deflated (documents' ids and lengths, blocks'
places, steps and checksums, chunks' tables); its offset and length; magic. Readers split a file by chunks; a document belongs to
the chunk in which it begins.

Defined cases: a null or empty text is the end id only; a very long text runs through as many blocks as it needs; null ids
come first; rows of equal id follow each other by the text's hash; no rows give no files; other columns, of any name, are
ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, remove, shared_dir
from .warc import open_fs

MAGIC, BLOCK, LANES, SLOTS = b"CFIDS3\r\n", 4096, 2048, 256
END_ID = 0
#: Bits of the order-0 counts' total and of the mix; how fast probabilities adapt.
COUNT_BITS, MIX_BITS, RATE = 16, 12, 4
#: A run is a symbol if it is at least one of 2**LEAST_BITS of a chunk's items.
LEAST_BITS = 18
#: Pairs of ids that become symbols are chosen by one of so many neighbouring places of a chunk.
SAMPLE = 6


def _inflated(data: bytes) -> bytes:
    from zlib import decompress, error

    try:
        return decompress(data)
    except error as e:
        raise ValueError(f"damaged: {e}") from None


class Order0:
    """Symbols of a chunk as places in a table, with counts that sum to 2**COUNT_BITS. Place 0 is the escape, then come ids, then runs of ids."""

    MOST = 60_000

    def __init__(self, ids, counts, sizes=(), flat=()):
        import numpy as np

        self.ids, self.counts = ids, counts  # of places from 1 on; counts of all places
        self.sizes, self.flat = np.asarray(sizes, np.uint32), np.asarray(flat, np.uint32)  # of the runs
        self.sums = np.r_[0, np.cumsum(counts)].astype(np.uint32)
        self.place_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    @classmethod
    def of(cls, ids, runs=(), sizes=(), flat=()) -> Order0:
        """The table of a chunk's ids (uint32) outside of runs; how often each run comes, how long runs are, and all their ids."""
        import numpy as np

        own, n = np.unique(ids, return_counts=True)
        room = cls.MOST - len(runs)
        if len(own) > room:
            kept = np.sort(np.argpartition(-n, room)[:room])
            own, n = own[kept], n[kept]
        n = np.r_[n, np.asarray(runs, n.dtype)]
        free = (1 << COUNT_BITS) - len(n) - 1
        counts = np.r_[1, 1 + n * free // max(len(ids) + int(np.sum(runs)), 1)]
        counts[np.argmax(counts)] += (1 << COUNT_BITS) - counts.sum()
        return cls(own, counts.astype(np.int64), sizes, flat)

    def spans(self):
        """Sum before each place in the upper, count in the lower 32 bits."""
        import numpy as np

        return self.sums[:-1].astype(np.uint64) << np.uint64(32) | self.counts.astype(np.uint64)

    def places(self, ids):
        import numpy as np

        if not len(self.ids):
            return np.zeros(ids.shape, np.int32)
        if int(self.ids[-1]) < 1 << 22:
            table = np.zeros(1 << 22, np.int32)
            table[self.ids] = np.arange(1, len(self.ids) + 1)
            return table[np.minimum(ids, (1 << 22) - 1)]
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at + 1, 0).astype(np.int32)

    def lengths(self, places):
        """How many ids each of places stands for."""
        import numpy as np

        return np.r_[np.ones(len(self.ids) + 1, np.int64), self.sizes][places]

    def spelled(self, places, raw):
        """Ids that places stand for; raw: the ids of the escapes among them, in their order."""
        import numpy as np

        singles, size = len(self.ids) + 1, self.lengths(places)
        first = np.r_[np.arange(singles), singles + np.cumsum(self.sizes, dtype=np.int64) - self.sizes]
        ids = _taken(np.r_[np.uint32(0), self.ids.astype(np.uint32), self.flat], first[places], size)
        if len(raw):
            ids[np.cumsum(size)[places == 0] - 1] = raw
        return ids

    def pack(self) -> bytes:
        from zlib import compress

        parts = [x.astype("<u4").tobytes() for x in (self.ids, self.counts, self.sizes, self.flat)]
        return compress(struct.pack("<III", len(self.ids), len(self.sizes), len(self.flat)) + b"".join(parts), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Order0:
        import numpy as np

        data = _inflated(data)
        n, runs, long = struct.unpack_from("<III", data)
        ids, counts, sizes, flat = np.split(np.frombuffer(data, "<u4", 2 * n + 1 + 2 * runs + long, 12), np.cumsum([n, n + 1 + runs, runs]))
        return cls(ids, counts.astype(np.int64), sizes, flat)


def _taken(flat, first, size):
    """flat[first:first + size] of all given, one after the other."""
    import numpy as np

    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for lo in range(0, len(size), 1 << 16):  # in parts that stay in a cache
        part = slice(lo, lo + (1 << 16))
        upto, own = ends[part], size[part]
        begin = upto - own
        out[begin[0] : upto[-1]] = flat[np.repeat(first[part] - begin, own) + np.arange(begin[0], upto[-1])]
    return out


class _Model:
    """Prediction state of all lanes; encoder and decoder drive it alike. Entries hold a place and, in two bits, its confidence."""

    def __init__(self, lanes: int):
        import numpy as np

        self.np = np
        lane = np.arange(lanes, dtype=np.int64)
        # a context's entries of order 1 and 2 lie in one group of 16: 8 of order 1, then 8 of order 2
        self.slots = np.stack([2 * lane * SLOTS, 2 * lane * SLOTS + 8])
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)
        # two probabilities of 15 bits: that order 2 is right, that order 1 is if it isn't; kept by confidences and by recent outcomes
        self.kept = np.stack([lane * 48, lane * 48 + 32])
        self.odds = np.full(lanes * 48, 3000 | 3000 << 16, np.uint32)
        self.hash1, self.hash2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.past = np.zeros(lanes, np.int64)
        self.at, self.by = np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int64)

    def shrink(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        self.slots, self.kept, self.at, self.by = (x[:, :lanes] for x in (self.slots, self.kept, self.at, self.by))
        self.hash1, self.hash2, self.past = self.hash1[:lanes], self.hash2[:lanes], self.past[:lanes]

    def predict(self):
        """Places that order 1 and 2 predict, and the ends of the shares of order 2 and order 1 in 2**MIX_BITS."""
        np, at, by = self.np, self.at, self.by
        group = self.hash1 >> _GROUP_SHIFT << 4
        at[0] = group | self.hash1 >> 8 & 7
        at[1] = group | self.hash1 + self.hash2 * np.uint32(0x85EBCA6B) >> 29
        at += self.slots
        self.entries = self.table.take(at)
        self.guess = self.entries >> 2
        self.trust = self.entries & 3
        q1, q2 = self.guess
        by[0] = (self.trust[1] << 3) + (self.trust[0] << 1) + (q1 == q2)
        by[1] = self.past
        by += self.kept
        self.now = self.odds.take(by)
        both = self.now[0] + self.now[1]
        end2 = (both & 0xFFFF) >> 4
        end1 = (((_TOP - end2) * (both >> 16)) >> 16) + end2 + 1
        return q1, q2, end2, end1

    def update(self, now, right2, right) -> None:
        """now: the place that came; whether order 2 had it, whether any had."""
        np, odds = self.np, self.now
        # of order 1's the chance stays where order 2 was right
        two = right2.astype(np.uint32)
        odds -= (odds >> RATE) & (np.uint32(0x0FFF0FFF) - two * np.uint32(0x0FFF0000))
        odds += (right.astype(np.uint32) - two) * np.uint32(_GAIN << 16) + two * np.uint32(_GAIN)
        self.odds[self.by] = odds
        entries, trust = self.entries, self.trust
        self.table[self.at] = np.where(self.guess == now, entries + (trust < 3), np.where(trust > 1, entries - 1, now << 2))
        self.past = (self.past << 1 | right) & 15
        self.hash1, self.hash2 = now.astype(np.uint32) * np.uint32(0x9E3779B1), self.hash1


#: Shares of order 2 and 1 leave at least 2 / 2**MIX_BITS; a probability rises by so much, and at most to 16 times that; a context's group.
_TOP, _GAIN, _GROUP_SHIFT = (1 << MIX_BITS) - 2, 2045, 32 - (SLOTS // 8 - 1).bit_length()
_LEAST = 1 << 32
#: Lanes that have ended leave after each so many steps.
_STRIDE = 16


class _Coder:
    """Range coder of all lanes, whose carries go back into the words. data: what a decoder reads, 32-bit words, and where lanes begin in it."""

    def __init__(self, lanes: int, data=None, at=None):
        import numpy as np

        self.np, self.data = np, data
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        if data is None:
            self.low, self.at = np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
            self.words = np.zeros((lanes, BLOCK // 4 + 8), "<u4")
        else:
            self.code = data[at].astype(np.uint64) << np.uint64(32) | data[at + 1]
            self.at = at + 2

    def shrink(self, lanes: int) -> None:
        """Go on with the first lanes only. What the others' words hold is used up, or they are damaged."""
        self.range = self.range[:lanes]
        if self.data is not None:
            if self.code[lanes:].any():
                raise ValueError("damaged: a block goes on behind its end")
            self.code, self.at = self.code[:lanes], self.at[:lanes]

    def put(self, lanes, start, width) -> None:
        """Narrow the range of lanes (numbers, or None for the first ones) to width, from start on."""
        np = self.np
        own = slice(len(start)) if lanes is None else lanes
        old = self.low[own]
        low = old + start
        over = (low < old).nonzero()[0]
        if len(over):
            rows = over if lanes is None else lanes[over]
            at = self.at[rows] - 1
            while len(rows):
                value = self.words[rows, at] + np.uint32(1)
                self.words[rows, at] = value
                more = value == 0
                rows, at = rows[more], at[more] - 1
        go = (width < _LEAST).nonzero()[0]
        if len(go):
            rows = go if lanes is None else lanes[go]
            at, out = self.at[rows], low[go]
            if int(at.max()) >= self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.words[rows, at] = out >> np.uint64(32)
            self.at[rows] = at + 1
            low[go] = out << np.uint64(32)
            width[go] <<= np.uint64(32)
        self.low[own] = low
        if lanes is None:
            self.range = width
        else:
            self.range[lanes] = width

    def got(self, lanes, code, width) -> None:
        """Go on, in lanes (numbers, or None for all), with a code in a range of width."""
        np = self.np
        go = (width < _LEAST).nonzero()[0]
        if len(go):
            rows = go if lanes is None else lanes[go]
            at = self.at[rows]
            code[go] = code[go] << np.uint64(32) | self.data.take(at, mode="clip")
            width[go] <<= np.uint64(32)
            self.at[rows] = at + 1
        if lanes is None:
            self.code, self.range = code, width
        else:
            self.code[lanes], self.range[lanes] = code, width

    def finish(self) -> list[bytes]:
        np = self.np
        if self.at.max(initial=0) + 2 > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros((len(self.at), 8), self.words.dtype)], axis=1)
        lanes = np.arange(len(self.at))
        self.words[lanes, self.at] = (self.low >> np.uint64(32)).astype(np.uint32)
        self.words[lanes, self.at + 1] = (self.low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return [self.words[i, : n + 2].tobytes() for i, n in enumerate(self.at.tolist())]


def _strides(sizes) -> Iterator[tuple[int, int, int]]:
    """Steps from, to, and how many lanes take part, for lanes of falling sizes."""
    import numpy as np

    falling = -np.asarray(sizes, np.int64)
    for t in range(0, int(-falling[0]), _STRIDE):
        yield t, t + _STRIDE, int(np.searchsorted(falling, -t))


def encode_blocks(blocks: list, order0: Order0) -> list[bytes]:
    """Payloads of blocks (arrays of ids, coded one by one)."""
    ids = [b.astype("u4") for b in blocks]
    return _encode([order0.places(b) for b in ids], ids, order0)


def _encode(blocks: list, ids: list, order0: Order0) -> list[bytes]:
    """Payloads of blocks of places; ids: what an escape among them stands for."""
    import numpy as np

    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = [len(blocks[i]) for i in order]
    steps = -(-sizes[0] // _STRIDE) * _STRIDE
    places = np.full((steps, len(blocks)), min(1, len(order0.counts) - 1), np.int32)  # blocks go on to a stride's end
    for lane, i in enumerate(order):
        places[: sizes[lane], lane] = blocks[i]
    model, coder = _Model(len(blocks)), _Coder(len(blocks))
    spans, zero, low = order0.spans(), np.uint64(0), np.uint64(0xFFFFFFFF)
    for begin, end, lanes in _strides(sizes):
        if lanes < len(coder.range):
            model.shrink(lanes)
            coder.shrink(lanes)
        for t in range(begin, end):
            now = places[t, :lanes]
            q1, q2, end2, end1 = model.predict()
            right2 = now == q2
            right = (now == q1) | right2
            share = coder.range >> np.uint64(MIX_BITS)
            upto2, upto1 = share * end2, share * end1
            start = np.where(right, np.where(right2, zero, upto2), upto1)
            width = np.where(right, np.where(right2, upto2, upto1 - upto2), coder.range - upto1)
            miss = (~right).nonzero()[0]
            if len(miss):
                unit, span = width[miss] >> np.uint64(COUNT_BITS), spans.take(now[miss])
                start[miss] += unit * (span >> np.uint64(32))
                width[miss] = unit * (span & low)
            coder.put(None, start, width)
            if not now.all():  # escapes: the id as two halves
                escaped = (now == 0).nonzero()[0]
                value = np.array([ids[order[i]][t] if t < sizes[i] else 0 for i in escaped.tolist()], np.uint64)
                for shift in (16, 0):
                    unit = coder.range[escaped] >> np.uint64(16)
                    coder.put(escaped, unit * (value >> np.uint64(shift) & np.uint64(0xFFFF)), unit)
            model.update(now, right2, right)
    payloads: list[bytes] = [b""] * len(blocks)
    for i, payload in zip(order, coder.finish(), strict=True):
        payloads[i] = payload
    return payloads


def decode_blocks(payloads: list[bytes], sizes: list[int], order0: Order0) -> list:
    """Arrays of ids (uint32) of blocks, whose sizes count places."""
    import numpy as np

    if not payloads:
        return []
    order = sorted(range(len(payloads)), key=lambda i: -sizes[i])
    falling = [sizes[i] for i in order]
    data = np.frombuffer(b"".join(payloads[i] for i in order) + bytes(8), "<u4")
    length = np.array([len(payloads[i]) // 4 for i in order], np.int64)
    found, raw = np.zeros((-(-falling[0] // _STRIDE) * _STRIDE, len(payloads)), np.int32), []
    model, coder = _Model(len(payloads)), _Coder(len(payloads), data, np.cumsum(length) - length)
    spans, zero, bits, low = order0.spans(), np.uint64(0), np.uint64(COUNT_BITS), np.uint64(0xFFFFFFFF)
    for begin, end, lanes in _strides(falling):
        if lanes < len(coder.range):
            model.shrink(lanes)
            coder.shrink(lanes)
        for t in range(begin, end):
            q1, q2, end2, end1 = model.predict()
            code, share = coder.code, coder.range >> np.uint64(MIX_BITS)
            upto2, upto1 = share * end2, share * end1
            right2, right = code < upto2, code < upto1
            now = np.where(right2, q2, q1)
            code = code - np.where(right, np.where(right2, zero, upto2), upto1)
            width = np.where(right, np.where(right2, upto2, upto1 - upto2), coder.range - upto1)
            miss = (~right).nonzero()[0]
            if len(miss):
                unit, own = width[miss] >> bits, code[miss]
                # the quotient of floats is off by one at most; where that is another place's, divide exactly
                place = order0.place_of.take((own.astype(np.float64) / unit.astype(np.float64)).astype(np.int64), mode="clip")
                span = spans.take(place)
                rest, span = own - unit * (span >> np.uint64(32)), unit * (span & low)
                wrong = (rest >= span).nonzero()[0]
                if len(wrong):
                    place[wrong] = order0.place_of.take((own[wrong] // unit[wrong]).astype(np.int64), mode="clip")
                    span = spans.take(place)
                    rest, span = own - unit * (span >> np.uint64(32)), unit * (span & low)
                now[miss], code[miss], width[miss] = place, rest, span
            coder.got(None, code, width)
            found[t, :lanes] = now
            if not now.all():
                escaped = (now == 0).nonzero()[0]
                value = np.zeros(len(escaped), np.uint64)
                for _ in range(2):
                    unit, own = coder.range[escaped] >> np.uint64(16), coder.code[escaped]
                    half = np.minimum(own // unit, np.uint64(0xFFFF))
                    coder.got(escaped, own - half * unit, unit)
                    value = value << np.uint64(16) | half
                raw.append((np.full(len(escaped), t), escaped, value))
            model.update(now, right2, right)
    coder.shrink(0)
    # one lane after the other; an escape's id lies by its lane and step
    places = np.concatenate([found[:n, k] for k, n in enumerate(falling)])
    step, lane, value = (np.concatenate(x) for x in zip(*raw, strict=True)) if raw else (np.zeros(0, np.int64),) * 3
    by_lane = np.lexsort((step, lane))
    by_lane = by_lane[step[by_lane] < np.array(falling)[lane[by_lane]]]
    ids = order0.spelled(places, value[by_lane].astype(np.uint32))
    upto = np.r_[0, np.cumsum(order0.lengths(places))][np.r_[0, np.cumsum(falling)]].tolist()
    parts: list = [None] * len(payloads)
    for k, i in enumerate(order):
        parts[i] = ids[upto[k] : upto[k + 1]]
    return parts


class Runs:
    """Ids of different pre-tokens by number. An item is such a number, or -1 - id for a single id."""

    def __init__(self):
        import numpy as np

        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, ids, sizes):
        """Items of runs of ids (uint32, one run after the other) of these sizes."""
        import numpy as np

        single = sizes == 1
        items = np.cumsum(~single) - 1 + len(self.sizes)
        items[single] = -1 - ids[(np.cumsum(sizes) - sizes)[single]].astype(np.int64)
        self.flat = np.r_[self.flat, ids[np.repeat(~single, sizes)]]
        self.sizes = np.r_[self.sizes, sizes[~single]]
        return items

    def tables(self):
        """Where each run begins, how long it is, and all ids."""
        import numpy as np

        return np.cumsum(self.sizes) - self.sizes, self.sizes, self.flat

    def lengths(self, items):
        import numpy as np

        return np.r_[self.sizes, 1][np.maximum(items, -1)]  # the last for single ids

    def spelled(self, items, which):
        """items, with single ids for those of which."""
        import numpy as np

        which = which & (items >= 0)
        if not which.any():
            return items
        first, sizes, flat = self.tables()
        size = np.ones(len(items), np.int64)
        size[which] = sizes[items[which]]
        out = np.repeat(items, size)
        own = items[which]
        out[np.repeat(which, size)] = -1 - _taken(flat, first[own], sizes[own]).astype(np.int64)
        return out


def _paired(items, ends, free: int, least: int, most: int):
    """items, with frequent pairs of neighbouring single ids as runs numbered from free on; the runs' ids, and how often each comes.

    ends: ids up to and with each item; no pair lies in two blocks.
    """
    import numpy as np

    single = items < 0
    at = np.flatnonzero(single[:-1] & single[1:] & (ends[:-1] % BLOCK != 0))
    key = (-1 - items[at]).astype(np.uint64) << np.uint64(32) | (-1 - items[at + 1]).astype(np.uint64)
    # chosen by a sample of neighbouring places; of pairs that share a bin one is
    known, count = np.unique(key[: -(-len(key) // SAMPLE)], return_counts=True)
    often = np.argsort(-count, kind="stable")[:most]
    one = known[often[count[often] * SAMPLE >= least]]
    bins_of = lambda k: ((k ^ k >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int64)
    number = np.full(1 << 17, -1, np.int32)
    number[bins_of(one)] = np.arange(len(one))
    bins = number.take(bins_of(key))
    own = np.flatnonzero(bins >= 0)
    own = own[one[bins[own]] == key[own]]
    at, bins = at[own], bins[own]
    # of those that overlap, every other
    place = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
    chosen = (place - begin) % 2 == 0
    at, bins = at[chosen], bins[chosen]
    out, kept = items.copy(), np.ones(len(items), bool)
    out[at] = free + bins
    kept[at + 1] = False
    flat = np.stack([one >> np.uint64(32), one & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32).ravel()
    return out[kept], flat, np.bincount(bins, minlength=len(one))


class _Writer:
    """One file; blocks are coded LANES at a time. Runs that often come in a chunk are symbols of their own in it, others are spelled by id."""

    def __init__(self, handle, runs: Runs | None = None):
        self.handle, self.offset, self.docs, self.lengths, self.rest, self.held = handle, 0, [], [], [], 0
        self.blocks, self.chunks = [], []  # (offset, bytes, ids, CRC-32, places); (offset of the table, bytes)
        self.runs = runs or Runs()
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.handle.write(data)
        self.offset += len(data)

    def add(self, doc_id, ids) -> None:
        import numpy as np

        self.extend([doc_id], -1 - np.array(ids, dtype=np.int64), [len(ids)])

    def extend(self, docs: list, items, lengths: list[int]) -> None:
        """Documents, their items (one array for all), and how many ids each has."""
        self.docs += docs
        self.lengths += lengths
        self.rest.append(items)
        self.held += sum(lengths)
        if self.held >= LANES * BLOCK:
            self._flush(False)

    def restart(self, runs: Runs) -> None:
        """Go on with other runs; what is held is spelled by id."""
        import numpy as np

        self.rest = [self.runs.spelled(x, np.ones(len(x), bool)) for x in self.rest]
        self.runs = runs

    def _flush(self, last: bool) -> None:
        import numpy as np

        items = np.concatenate(self.rest) if self.rest else np.zeros(0, np.int64)
        size = self.runs.lengths(items)
        ends = np.cumsum(size)
        items = self.runs.spelled(items, (ends - size) // BLOCK != (ends - 1) // BLOCK)  # none lies in two blocks
        ends = np.cumsum(self.runs.lengths(items))
        chunk, total = LANES * BLOCK, int(ends[-1]) if len(ends) else 0
        end = total if last else total // chunk * chunk
        upto = np.searchsorted(ends, [*range(0, end, chunk), end], "right").tolist()
        for lo, hi in zip(upto, upto[1:], strict=False):
            self._code(items[lo:hi])
        self.rest, self.held = [items[upto[-1] :]], total - end

    def _code(self, items) -> None:
        from zlib import crc32

        import numpy as np

        first, sizes, flat = self.runs.tables()
        count = np.bincount(items[items >= 0], minlength=len(sizes))
        often = np.flatnonzero(count >= max(2, len(items) >> LEAST_BITS))
        often = often[np.argsort(-count[often], kind="stable")[: Order0.MOST // 2]]
        rank = np.full(len(sizes) + 1, -1, np.int64)
        rank[often] = np.arange(len(often))
        items, size = self.runs.spelled(items, rank[np.maximum(items, -1)] < 0), len(sizes)
        items, pairs, times = _paired(items, np.cumsum(self.runs.lengths(items)), size, max(2, len(items) >> LEAST_BITS), Order0.MOST // 4)
        single = items < 0
        own = (-1 - items[single]).astype(np.uint32)
        rank = np.r_[rank[:-1], len(often) + np.arange(len(times)), -1]
        order0 = Order0.of(own, np.r_[count[often], times], np.r_[sizes[often], np.full(len(times), 2)], np.r_[_taken(flat, first[often], sizes[often]), pairs])
        table = order0.pack()
        self.chunks.append((self.offset, len(table)))
        self._put(table)
        places, raw = np.empty(len(items), np.int32), np.zeros(len(items), np.uint32)
        places[single], raw[single] = order0.places(own), own
        places[~single] = len(order0.ids) + 1 + rank[items[~single]]
        ids = order0.spelled(places, raw[places == 0])
        ends = np.cumsum(order0.lengths(places))
        cuts = np.searchsorted(ends, np.arange(BLOCK, len(ids), BLOCK)) + 1
        blocks = np.split(places, cuts)
        for at, (b, payload) in enumerate(zip(blocks, _encode(blocks, np.split(raw, cuts), order0), strict=True)):
            mine = ids[at * BLOCK : (at + 1) * BLOCK]
            self.blocks.append((self.offset, len(payload), len(mine), crc32(mine.astype("<u4").tobytes()), len(b)))
            self._put(payload)

    def close(self) -> tuple[int, int, int]:
        """Ids, bytes, chunks."""
        from zlib import compress

        import numpy as np

        self._flush(True)
        at, known = self.offset, [d is not None for d in self.docs]
        parts = [struct.pack("<QQQ", len(self.docs), len(self.blocks), len(self.chunks))]
        parts += [np.array([d or 0 for d in self.docs], "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes()]
        parts += [np.array(self.blocks, "<i8").reshape(-1, 5).tobytes(), np.array(self.chunks, "<i8").reshape(-1, 2).tobytes(), np.array(known, "u1").tobytes()]
        packed = compress(b"".join(parts), 6)
        self._put(packed + struct.pack("<QQ", at, len(packed)) + MAGIC)
        return sum(self.lengths), self.offset, len(self.chunks)


class Index:
    """What a file's end says of its documents, blocks and chunks."""

    def __init__(self, handle):
        import numpy as np

        size = handle.size()
        handle.seek(max(size - 24, 0))
        end = handle.read(24)
        handle.seek(0)
        if len(end) != 24 or end[16:] != MAGIC or handle.read(8) != MAGIC:
            raise ValueError("no token-id file")
        at, length = struct.unpack("<QQ", end[:16])
        if at + length + 24 != size:
            raise ValueError("no token-id file")
        handle.seek(at)
        data = _inflated(handle.read(length))
        docs, blocks, chunks = struct.unpack_from("<QQQ", data)
        take = lambda kind, n, at: (np.frombuffer(data, kind, n, at), at + np.dtype(kind).itemsize * n)
        self.docs, at = take("<i8", docs, 24)
        self.lengths, at = take("<i8", docs, at)
        found, at = take("<i8", 5 * blocks, at)
        self.blocks = found.reshape(-1, 5)
        found, at = take("<i8", 2 * chunks, at)
        self.chunks = found.reshape(-1, 2)
        self.known, _ = take("u1", docs, at)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        if int(self.starts[-1]) != int(self.blocks[:, 2].sum()):
            raise ValueError("the document table doesn't fit the blocks")

    def decode(self, handle, first: int, last: int):
        """Ids of blocks first to last (exclusive) of one chunk; raises ValueError where a checksum doesn't hold."""
        from zlib import crc32

        import numpy as np

        offset, length = self.chunks[first // LANES].tolist()
        handle.seek(offset)
        order0, payloads = Order0.unpack(handle.read(length)), []
        rows = self.blocks[first:last]
        handle.seek(int(rows[0, 0]))
        data = handle.read(int(rows[-1, 0] + rows[-1, 1] - rows[0, 0]))
        for at, size, *_ in rows.tolist():
            at -= int(rows[0, 0])
            payloads.append(data[at : at + size])
        parts = decode_blocks(payloads, rows[:, 4].tolist(), order0)
        for b, size, check in zip(parts, rows[:, 2].tolist(), rows[:, 3].tolist(), strict=True):
            if len(b) != size or crc32(b.astype("<u4").tobytes()) != check:
                raise ValueError("a block's checksum doesn't hold")
        return np.concatenate(parts)


def read_file(handle, chunk: int | None = None) -> Iterator[tuple]:
    """(doc_id, start in the file, ids as uint32 array) of the documents that begin in a chunk (or in any), in their order."""
    import numpy as np

    index = Index(handle)
    for c in range(len(index.chunks)) if chunk is None else (chunk,):
        first, last = c * LANES, min((c + 1) * LANES, len(index.blocks))
        ids, base = index.decode(handle, first, last), first * BLOCK
        lo, hi = np.searchsorted(index.starts[:-1], [base, base + len(ids)]).tolist()
        for d in range(lo, hi):
            start, end = index.starts[d : d + 2].tolist()
            own = ids[start - base : end - base]
            at = last
            while start + len(own) < end:  # goes on in the next chunks
                stop = min(-(-end // BLOCK), (at // LANES + 1) * LANES)
                own = np.concatenate([own, index.decode(handle, at, stop)[: end - start - len(own)]])
                at = stop
            yield (int(index.docs[d]) if index.known[d] else None), start, own


# How byte-level vocabularies split a text, written for the JVM; white space as Unicode has it.
_BLANK = r"\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The rule as a pattern; _Splitter does the same to bytes.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{_BLANK}\p{{L}}\p{{N}}]++|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]++"
#: Texts with other characters are split by the library: the JVM's tables of letters and digits may be older than its own.
_STABLE = r"[^\x00-\u052f\u2000-\u206f]"


def _split_by_jvm(description: str):
    """Condition of texts whose pre-tokens SPLIT and _Splitter give, if the tokenizer splits as byte-level vocabularies do; else None."""
    import json

    parts = json.loads(description)
    split = parts.get("pre_tokenizer") or {}
    plain = not parts.get("truncation") and not parts.get("padding") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not parts.get("normalizer")
    if not plain or not (parts.get("model") or {}).get("type") == "BPE" or parts["model"].get("dropout"):
        return None
    fast = F.col("text").isNotNull() & ~F.col("text").rlike(_STABLE)
    for token in parts.get("added_tokens") or ():
        fast &= ~F.contains("text", F.lit(token["content"]))
    return fast


class _Splitter:
    """What SPLIT does, by numpy, to the bytes of texts that have no character of _STABLE."""

    LETTER, DIGIT, SIGN, BLANK, SPACE = range(1, 6)

    def __init__(self):
        import re
        import unicodedata

        import numpy as np

        def kind(c: str) -> int:
            if re.fullmatch(f"[{_BLANK}]", c):
                return self.SPACE if c == " " else self.BLANK
            return {"L": self.LETTER, "N": self.DIGIT}.get(unicodedata.category(c)[0], self.SIGN)

        self.kinds = np.array([kind(chr(c)) for c in range(0x2080)], np.uint8)
        self.plain = self.kinds[:128].tobytes() + bytes(128)

    def __call__(self, raw: bytes, offsets):
        """Where pre-tokens begin in raw, which ends with three bytes that are no text's; texts lie at offsets."""
        import numpy as np

        n = len(raw) - 3
        data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw.translate(self.plain)), np.uint8)
        lead = np.flatnonzero(data[:n] >= 0xC0)
        wide = np.zeros(0, bool)
        if len(lead):  # two bytes up to U+07FF, three for U+2000 to U+207F; all get the character's kind
            long, low = data[lead] >= 0xE0, data[lead + 1] & 63
            code = np.where(long, 0x2000 | (low.astype(np.int64) & 1) << 6 | data[lead + 2] & 63, (data[lead].astype(np.int64) & 31) << 6 | low)
            of = self.kinds[code]
            kind[lead], kind[lead + 1], kind[lead[long] + 2] = of, of, of[long]
            wide = of == self.BLANK
        blank = kind >= self.BLANK
        edge = np.zeros(n + 3, bool)
        edge[offsets], edge[n:] = True, True
        begins = np.empty(n + 3, bool)
        begins[0] = True
        # a run of one kind begins, and no space is its own; of blanks, the run and, if something follows, the last
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != self.SPACE) & ~blank[1:]
        begins[1:-1] |= blank[1:-1] & ~(blank[:-2] & blank[2:])
        ends = np.flatnonzero(edge[1 : n + 1])
        ends = ends[blank[ends]]
        begins[ends] = ~blank[ends - 1]
        if wide.any():
            at, size = lead[wide], 2 + long[wide]
            after = at + size
            begins[at] = ~blank[at - 1] | ~(blank[after] | edge[after])
            begins[at + 1] = False
            begins[at[size > 2] + 2] = False
        begins[:n] |= edge[:n]
        signs = np.flatnonzero(data[:n] == ord("'"))
        signs = signs[begins[signs] & ~edge[signs + 1]]
        one, two = data[signs + 1], data[signs + 2]
        short = signs[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
        pair = signs[~edge[signs + 2] & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))]
        for found, size in ((short, 2), (pair, 3)):
            begins[found + 1] = False
            begins[found + size] = True
        return np.flatnonzero(begins[:n])


def _alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def _bare(description: str) -> tuple[str, list[int]]:
    """The description of the model alone, for pre-tokens in its alphabet, and by id how many bytes a token has (none: not known to be whole)."""
    import json

    parts = json.loads(description)
    model = parts.get("model") or {}
    vocab, alphabet = model.get("vocab"), _alphabet().values()
    bare = json.dumps({**parts, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None})
    if not isinstance(vocab, dict) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not all(c in vocab for c in alphabet):
        return bare, []
    sizes = [0] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        sizes[i] = len(token)
    return bare, sizes


class _Encoder:
    """Ids of texts (by the library), and items of texts of settled characters (each different pre-token by the library's model, once)."""

    #: Pre-tokens that are known, at most, when a task begins and when a group of texts does; pre-tokens given to the model at once.
    MEMO, MEMO_MORE, AT_ONCE = 300_000, 600_000, 100

    def __init__(self, description: str, bare: str, sizes: list[int]):
        import numpy as np

        self.description, self.bare, self.library, self.model = description, bare, None, None
        self.split, self.alphabet, self.sizes = _Splitter(), _alphabet(), np.array(sizes, np.int64)
        self.forget()

    @classmethod
    def kept(cls, description: str, bare: str, sizes: list[int]) -> _Encoder:
        """The one of this process: a worker's next task finds the model loaded and pre-tokens known. Code travels by value, so the library's module holds it."""
        import tokenizers

        held = vars(tokenizers).get("_cairnflow_encoder")
        if held is None or held.description != description:
            held = tokenizers._cairnflow_encoder = cls(description, bare, sizes)
        if len(held.memo) > cls.MEMO:
            held.forget()
        return held

    def forget(self) -> None:
        self.memo, self.runs = {}, Runs()

    def texts(self, texts: list[str]) -> list[list[int]]:
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_str(self.description)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]):
        """Ids of pre-tokens, one after the other, and how many each has."""
        import numpy as np
        from itertools import chain
        from tokenizers import Tokenizer

        self.model = self.model or Tokenizer.from_str(self.bare)
        spelled = [w.decode("latin-1").translate(self.alphabet) for w in words]
        if len(self.sizes):  # many as one text; tokens' bytes tell where a word ends
            parts = []
            for lo in range(0, len(words), self.AT_ONCE):
                found = self.model.encode_batch_fast([spelled[lo : lo + self.AT_ONCE]], is_pretokenized=True, add_special_tokens=False)
                parts.append(np.array(found[0].ids, np.uint32))
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            ends, upto = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            at = np.searchsorted(ends, upto)
            if len(ends) == 0 or at[-1] == len(ends) - 1 and (ends[at] == upto).all():
                return ids, np.diff(np.r_[-1, at])
        lists = [e.ids for e in self.model.encode_batch_fast(spelled, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def items(self, texts, end_id: int):
        """From a string array without nulls: items of all rows, the end id after each, and where rows end in them."""
        import numpy as np
        import pyarrow as pa

        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        raw = (memoryview(texts.buffers()[2])[low:high].tobytes() if high > low else b"") + bytes(3)
        offsets -= low
        begins = self.split(raw, offsets)
        places = pa.py_buffer(np.r_[begins, high - low].astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(begins), [None, places, pa.py_buffer(raw)]).dictionary_encode()
        known = coded.dictionary
        cuts, held = np.frombuffer(known.buffers()[1], np.int32, len(known) + 1).tolist(), known.buffers()[2].to_pybytes() if len(known) else b""
        words = [held[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        new = [w for w in words if w not in self.memo]
        self.memo.update(zip(new, self.runs.add(*self.words(new)).tolist(), strict=True))
        of = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        upto = np.searchsorted(begins, offsets[1:])
        ends = upto + np.arange(1, len(upto) + 1)
        items = np.full(len(begins) + len(upto), -1 - end_id, np.int64)
        inner = np.ones(len(items), bool)
        inner[ends - 1] = False
        items[inner] = of[np.frombuffer(coded.indices.buffers()[1], np.int32, len(coded))] if len(coded) else of
        return items, ends


#: Texts are split in groups of batches of about so many bytes.
GROUP_BYTES = 12 << 20


def _grouped(batches: Iterator, size: int) -> Iterator:
    """Batches put together to at least size bytes, the last may have less."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs into files in folder. Returns a cut table, a row per file: path, part, ids, bytes, chunks.

    Texts of characters whose kinds are long settled are split into pre-tokens by numpy, and tasks have the library's model
    encode each different pre-token once; other texts go to the library whole.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    description, fast = docs.sparkSession.sparkContext.broadcast((content, *_bare(content))), _split_by_jvm(content)

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, out, own = _Encoder.kept(*description.value), None, None
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name = f"part-{task.partitionId():06d}.ids"
        for batch in _grouped(batches, GROUP_BYTES):
            if out is None:
                own = f"{top}/{name}.{task.taskAttemptId()}.{os.getpid()}"
                out = _Writer(fs.open_output_stream(own, compression=None), encoder.runs)
            if len(encoder.memo) > encoder.MEMO_MORE:
                encoder.forget()
                out.restart(encoder.runs)
            known, texts, fast = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            by_split = fast.to_numpy(zero_copy_only=False).astype(bool)
            slow = np.flatnonzero(~by_split).tolist()
            items, ends = encoder.items(texts.filter(fast) if slow else texts, end_id)
            places = np.r_[0, ends]
            upto = np.r_[0, np.cumsum(out.runs.lengths(items))][places]
            lengths, rows, at = np.diff(upto).tolist(), 0, 0  # rows so far, and how many of the split ones
            for lo in range(0, len(slow), 64):
                part = slow[lo : lo + 64]
                found = encoder.texts([t or "" for t in texts.take(pa.array(part)).to_pylist()])
                for k, x in zip(part, found, strict=True):
                    if k > rows:
                        out.extend(known[rows:k], items[places[at] : places[at + k - rows]], lengths[at : at + k - rows])
                        at += k - rows
                    out.add(known[k], [*x, end_id])
                    rows = k + 1
            if rows < batch.num_rows:
                out.extend(known[rows:], items[places[at] :], lengths[at:])
        if out is not None:
            ids, size, chunks = out.close()
            out.handle.close()
            fs.move(own, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([task.partitionId()], pa.int64()), *(pa.array([x], pa.int64()) for x in (ids, size, chunks))], ["path", "part", "ids", "bytes", "chunks"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    settled = F.lit(False) if fast is None else F.coalesce(fast, F.lit(False))
    return cut(dealt.select("doc_id", "text", settled.alias("settled")).mapInArrow(run, "path string, part long, ids long, bytes long, chunks long"))


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of all files (path, part, ids, chunks). Offsets of files are a running sum, one row per file; a task takes some chunks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")))
    placed = placed.repartition(max(1, min(placed.count(), 65536)))  # dealt in turn: a chunk a task

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
        for batch in batches:
            for path, base, chunk in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, at = open_fs(path)
                rows: list[tuple] = []
                with fs.open_input_file(at) as handle:
                    for doc_id, start, ids in read_file(handle, chunk):
                        rows.append((doc_id, base + start, len(ids), crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                        if len(rows) >= 1024:
                            yield _batch(pa, rows, names)
                            rows = []
                if rows:
                    yield _batch(pa, rows, names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _batch(pa, rows: list[tuple], names: list[str]):
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(columns[4], pa.list_(pa.int64()))] * (len(names) > 4), names)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs as token-id files into the shared folder and read them back: doc_id, start, n_tokens, ids_crc32. The files go."""
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    found = cut(read(write(docs, folder, tokenizer_path), with_ids=False))
    remove(spark, folder)
    return found
