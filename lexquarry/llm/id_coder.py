"""A context-mixing range coder for blocks of token ids.

A block is coded on its own: every model starts anew, so blocks are written, checked and read apart. Many blocks go through
the coder side by side, one id of each at a time, as lanes of numpy arrays; a lane's bytes do not depend on the others.

A block begins with its different ids and how often each occurs, deflated; ids are then known by their place among them.
Each id is held against one expected id: the one that followed its two predecessors before (order 2), or its predecessor
(order 1), whichever is surer. The chance that it comes is mixed from what the order-2, order-1 and order-0 models say of
it, with weights that each lane learns from its errors. Any other id is coded by order 0, its frequency in the block. One
narrowing of the range codes both: the expected id has a part of its own beside those of all ids. Ranges are whole numbers
under 2 ** 48, held as floats, which are exact for them, so any machine reads what another wrote.
"""

from __future__ import annotations

import struct
import zlib
from math import exp, log

import numpy as np

#: Head of a block: what it is, how many ids it holds, their CRC-32, the bytes of its deflated table and the words that follow.
HEAD = struct.Struct("<4sIIII")
MAGIC = b"IDX2"

PROB_BITS, PLACE_BITS = 12, 12
TOTAL, ONE = 1 << PLACE_BITS, 1 << PROB_BITS
CONTEXTS = 10  # bits of the table of order 2
SURE = 15  # the most that a context's id can be confirmed

#: Logistic domain, in steps of 1/256: a chance of 12 bits to its log odds and back.
REACH = 2047
STRETCH = np.array([round(256 * log(max(p, 0.5) / max(0.5, ONE - p))) for p in range(ONE + 1)], np.int32)
#: The expected id's part of the range by its log odds, where all ids together have TOTAL; and its chance, which at both ends is such
#: that nothing more is learnt.
PART = np.array([min(31 * TOTAL, max(1, round(TOTAL * exp(x / 256)))) for x in range(-REACH, REACH + 1)], np.float64)
SQUASH = np.array([0] + [round(ONE / (1 + exp(-x / 256))) for x in range(1 - REACH, REACH)] + [ONE], np.int32)
#: Log odds that an id comes that its context confirmed 0 (or never had), 1, 2, ... times; the mixer's weights correct them.
TRUST = STRETCH[[2] + [min(ONE - 200, 1200 + 250 * k) for k in range(1, SURE + 1)]]
#: What a context's entry gains when another id came (0 to 15 by sureness, 0 for one that is replaced) or its own came again (16 to 31).
GAIN = np.array([0, 0] + [-((k + 1) >> 1) & 0xFFFF for k in range(2, SURE + 1)] + [k < SURE for k in range(SURE + 1)], np.uint16)

#: Ranges are from LEAST to LEAST * WORD; the code comes in words of 24 bits.
LEAST = WORD = float(1 << 24)


class Writer:
    """A range in each lane that every id narrows: [low, low + range). Words may be one too large for 24 bits until they are carried."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, LEAST * WORD)
        self.words, self.used, self.most = np.zeros((lanes, most), np.uint32), np.zeros(lanes, np.int64), 0

    def put(self, lanes, words) -> None:
        if self.most == self.words.shape[1]:  # so many times at most a lane has put a word
            self.most = int(self.used.max(initial=0))
            if self.most == self.words.shape[1]:
                self.words = np.pad(self.words, ((0, 0), (0, self.most)))
        used = self.used.take(lanes)
        self.words[lanes, used] = words
        self.used[lanes] = used + 1
        self.most += 1

    def step(self, n: int, model: Model, first, part, ids):
        """Codes an id of each of the first n lanes, of which `first` is expected with its part of the range."""
        missed = first != ids
        narrow = np.floor(self.range[:n] / (part + TOTAL))
        begin, size = model.share(n, ids, missed, part)
        begin *= narrow
        self.low[:n] += begin
        narrow *= size
        full = np.flatnonzero(narrow < LEAST)
        if len(full):
            low = self.low.take(full)
            word = np.floor(low / WORD)
            self.put(full, word)
            self.low[full] = (low - word * WORD) * WORD
            narrow[full] *= WORD
        self.range[:n] = narrow
        return missed, ids

    def done(self) -> np.ndarray:
        """The words of all lanes, after two more that hold what is left of low."""
        every, word = np.arange(len(self.low)), np.floor(self.low / WORD)
        self.put(every, word)
        self.put(every, self.low - word * WORD)
        words = self.words[:, : self.used.max(initial=0)]
        while (over := words > 0xFFFFFF).any():
            lane, at = np.nonzero(over)
            words[lane, at] &= 0xFFFFFF
            words[lane, at - 1] += 1
        return words


class Reader:
    """The reading side keeps the code's distance from the low end of each range."""

    def __init__(self, words: list[np.ndarray]):
        lanes = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([*words, np.zeros(1, np.uint32)])
        self.at = np.cumsum(sizes) - sizes
        self.code = self.words.take(self.at, mode="clip") * WORD + self.words.take(self.at + 1, mode="clip")
        self.at += 2
        self.range = np.full(lanes, LEAST * WORD)

    def step(self, n: int, model: Model, first, part, _):
        narrow = np.floor(self.range[:n] / (part + TOTAL))
        code = self.code[:n]
        missed = code >= part * narrow
        value = (code / narrow - part).astype(np.int64)
        value += model.values_at[:n]
        found = model.values.take(value, mode="clip")
        found ^= (found ^ first) * ~missed
        begin, size = model.share(n, found, missed, part)
        begin *= narrow
        code -= begin
        narrow *= size
        full = np.flatnonzero(narrow < LEAST)
        if len(full):
            at = self.at.take(full)
            code[full] = code.take(full) * WORD + self.words.take(at, mode="clip")
            self.at[full] = at + 1
            narrow[full] *= WORD
        self.range[:n] = narrow
        return missed, found


class Model:
    """What the lanes know: the id that followed each context with how surely, and each id's part of the range by its frequency.

    `own` has an id's start << 16 | size, `values` the id at each of the TOTAL values of a lane (for reading only).
    """

    def __init__(self, frequencies: list[np.ndarray], reading: bool):
        lanes = len(frequencies)
        each, most = np.arange(lanes, dtype=np.int64), max(map(len, frequencies), default=0) | 1
        self.own = np.zeros((lanes, most), np.int32)
        for lane, size in enumerate(frequencies):
            self.own[lane, : len(size)] = (np.cumsum(size) - size) << 16 | size
        self.own = self.own.ravel()
        self.ids_at = each * most
        if reading:
            place = np.arange(most, dtype=np.uint16)
            self.values = np.concatenate([np.repeat(place[: len(size)], size) for size in frequencies] or [place])
            self.values_at = each << PLACE_BITS
        #: An entry is an id << 4 | its sureness: those of order 1, then those of order 2.
        self.entries = np.zeros(lanes * most + lanes * ((1 << CONTEXTS) + 8), np.uint16)
        self.two_at = lanes * most + each * ((1 << CONTEXTS) + 8)
        self.weights = np.full((3, lanes), 1 << 13, np.int32)  # of orders 1, 2 and 0, in steps of 1 / 2 ** 14
        self.last, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.at, self.odds = np.zeros((2, lanes), np.int64), np.zeros((3, lanes), np.int32)

    def share(self, n: int, ids, missed, part):
        """Where the ids' parts of the range begin and their sizes: an expected id's comes first, then those of all ids."""
        own = self.own.take(self.ids_at[:n] + ids, mode="clip")
        own *= missed
        before = part * missed
        return (own >> 16) + before, (own & 0xFFFF) + (part - before)

    def step(self, io, ids, n: int):
        """Codes one id of each of the first n lanes: takes ids (None when reading) and returns them."""
        last, at, odds, weights = self.last[:n], self.at[:, :n], self.odds[:, :n], self.weights[:, :n]
        np.add(self.ids_at[:n], last, out=at[0])
        np.add(self.two_at[:n], (last + self.mixed[:n]) & ((1 << CONTEXTS) - 1), out=at[1])
        entries = self.entries.take(at, mode="clip")
        sure, known = entries & 15, entries >> 4
        first = known[0] ^ (known[0] ^ known[1]) * (sure[1] * 2 >= sure[0])

        odds[:2] = TRUST.take(sure * (known == first), mode="clip")
        odds[2] = STRETCH.take(self.own.take(self.ids_at[:n] + first, mode="clip") & 0xFFFF, mode="clip")
        mixed = weights * odds
        total = (((mixed[0] + mixed[1] + mixed[2]) >> 14) + REACH).astype(np.int64)
        missed, found = io.step(n, self, first, PART.take(total, mode="clip"), ids)
        odds *= ONE - SQUASH.take(total, mode="clip") - (missed * np.int32(ONE))
        odds >>= 9
        weights += odds

        same = known == found
        gained = entries + GAIN.take(sure + (same * np.uint16(16)), mode="clip")
        gained ^= (gained ^ (found << 4 | 1)) * ((sure <= 1) & ~same)
        self.entries[at] = gained
        np.multiply(last, 1021, out=self.mixed[:n])
        last[:] = found
        return found


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole numbers of at least one that sum to TOTAL, by counts."""
    n, ends = int(counts.sum()), np.cumsum(counts)
    ends = ends * TOTAL // n if n <= TOTAL else ends * (TOTAL - len(counts)) // n + np.arange(1, len(counts) + 1)
    return np.diff(ends, prepend=0)


def order(lengths: list[int]) -> np.ndarray:
    """The lanes by falling length, so that those still at work are always the first."""
    return np.argsort([-n for n in lengths], kind="stable")


def active(lengths: np.ndarray) -> np.ndarray:
    """How many of the lanes (by falling length) have an id at each step."""
    return np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")


def by_steps(ids: np.ndarray, steps: int = 64):
    """The columns of ids (lanes by steps), copied some at a time, as a lane's ids lie beside each other."""
    for t in range(0, ids.shape[1], steps):
        yield from np.ascontiguousarray(ids[:, t : t + steps].T)


def planes(numbers: np.ndarray, width: int) -> bytes:
    """The numbers' first bytes, their second bytes and so on, the lowest first."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def deflated(data: bytes) -> bytes:
    """Only runs of one byte are worth a search."""
    coder = zlib.compressobj(strategy=zlib.Z_RLE)
    return coder.compress(data) + coder.flush()


def wide(n: int) -> int:
    """Bytes of a count of up to n ids, less one."""
    return 2 if n <= 1 << 16 else 4


def from_planes(data: bytes, width: int) -> np.ndarray:
    each = np.frombuffer(data, np.uint8).reshape(width, -1)
    return sum(each[k].astype(np.int64) << 8 * k for k in range(width))


def pack(blocks: list[np.ndarray], bits: int = 16) -> list[bytes]:
    """Blocks of ids (each under 2 ** bits, 11 to 26 bits, at most 4,096 different ones in a block) as bytes; an empty block is
    its head alone."""
    place = order([len(b) for b in blocks])
    lengths = np.array([len(blocks[i]) for i in place], np.int64)
    ids = np.zeros((len(blocks), int(lengths.max(initial=0))), np.uint16)
    tables, sizes, where, width = [], [], np.empty(1 << bits, np.uint16), (bits + 7) // 8
    for lane, i in enumerate(place):
        if not len(blocks[i]):
            tables.append(b"")
            sizes.append(np.zeros(0, np.int64))
            continue
        if int(blocks[i].max()) >> bits:
            raise ValueError(f"ids must have at most {bits} bits")
        ordered = np.sort(blocks[i].astype(np.uint16 if bits <= 16 else np.uint32), kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        known, counts = ordered[begins], np.diff(begins, append=len(ordered))
        if len(known) > TOTAL:
            raise ValueError(f"a block must have at most {TOTAL} different ids")
        where[known] = np.arange(len(known))
        ids[lane, : lengths[lane]] = where.take(blocks[i])
        tables.append(deflated(planes(np.diff(known.astype(np.int64), prepend=-1) - 1, width) + planes(counts - 1, wide(len(blocks[i])))))
        sizes.append(frequencies(counts))
    io, model, counts = Writer(len(blocks), 64 + ids.shape[1] // 2), Model(sizes, False), active(lengths).tolist()
    for n, some in zip(counts, by_steps(ids)):
        model.step(io, some[:n], n)
    words = io.done() if blocks else []
    out = [b""] * len(blocks)
    for lane, i in enumerate(place):
        body = words[lane, : io.used[lane] if lengths[lane] else 0].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        out[i] = HEAD.pack(MAGIC, int(lengths[lane]), zlib.crc32(blocks[i].astype("<u4").tobytes()), len(tables[lane]), len(body) // 3) + tables[lane] + body
    return out


def unpack(packed: list[bytes], bits: int = 16) -> list[np.ndarray]:
    """The blocks that pack() made, as unsigned 32-bit numbers. A block that is cut, foreign or damaged raises ValueError."""
    heads, width = [], (bits + 7) // 8
    for b in packed:
        magic, n, crc, table, words = HEAD.unpack_from(b) if len(b) >= HEAD.size else (b"", 0, 0, 0, 0)
        if magic != MAGIC or len(b) != HEAD.size + table + 3 * words:
            raise ValueError("no whole block of ids")
        heads.append((n, crc, table))
    place = order([n for n, _, _ in heads])
    known, sizes, words = [], [], []
    for i in place:
        n, _, table = heads[i]
        try:
            data = zlib.decompress(packed[i][HEAD.size : HEAD.size + table]) if n else b""
        except zlib.error as damage:
            raise ValueError("a block of ids is damaged") from damage
        many = len(data) // (width + wide(n))
        if len(data) != many * (width + wide(n)) or many > TOTAL:
            raise ValueError("a block of ids is damaged")
        counts = from_planes(data[many * width :], wide(n)) + 1 if n else np.zeros(0, np.int64)
        if counts.sum() != n:
            raise ValueError("a block of ids is damaged")
        known.append(np.cumsum(from_planes(data[: many * width], width) + 1) - 1 if n else counts)
        sizes.append(frequencies(counts) if n else counts)
        body = np.zeros((len(packed[i]) - HEAD.size - table) // 3 * 4, np.uint8).reshape(-1, 4)
        body[:, :3] = np.frombuffer(packed[i], np.uint8, offset=HEAD.size + table).reshape(-1, 3)
        words.append(body.view("<u4").ravel())
    lengths = np.array([heads[i][0] for i in place], np.int64)
    counts = active(lengths).tolist()
    ids = np.zeros((len(counts), len(packed)), np.uint16)
    io, model = Reader(words), Model(sizes, True)
    for n, some in zip(counts, ids):
        some[:n] = model.step(io, None, n)
    ids = np.ascontiguousarray(ids.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(packed)
    for lane, i in enumerate(place):
        out[i] = known[lane].take(ids[lane, : lengths[lane]], mode="clip").astype(np.uint32) if lengths[lane] else out[i]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][1]:
            raise ValueError("a block of ids is damaged")
    return out
