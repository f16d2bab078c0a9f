"""Texts as progressive JPEG images, and their RGB tensors.

The bytes of a payload, less 128, are the quantised coefficients of the image's blocks, so the format holds them
without loss. The image is YCbCr with chroma at half resolution, in nine scans: DC and AC bands (spectral
selection) without their lowest bit, then that bit (successive approximation). Reading back accumulates the scans
into coefficient arrays, transforms them inversely as one matrix product, upsamples chroma and converts to RGB.

Entropy coding works on many images at once. Writing places the codes of all blocks by running sums. Reading
uses the restart intervals (RESTART units): the intervals of all images and components of a scan step through
their codes side by side, one code per step, so each step is a handful of array operations.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache, lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import mapped, sub_batches, table

UNIT, RESTART, BATCH_BYTES = 64, 8, 700_000
#: (components, Ss, Se, Ah, Al) of the scans that are written.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0))
SAMPLING = ((2, 2), (1, 1), (1, 1))


# -- Huffman tables: (values by code length)
def _dc_lengths() -> list[list[int]]:
    return [list(range(12)) if n == 4 else [] for n in range(1, 17)]


def _ac_lengths() -> list[list[int]]:
    short, middle = list(range(1, 8)), [0x00, 0xF0]
    rest = sorted({r << 4 | s for r in range(16) for s in range(11)} - set(short) - set(middle))
    return [{3: short, 6: middle, 12: rest}.get(n, []) for n in range(1, 17)]


class Huffman:
    """Canonical codes: by symbol for writing, by the next 16 bits for reading."""

    def __init__(self, by_length: list[list[int]]):
        self.code, self.length = np.zeros(256, np.uint32), np.zeros(256, np.int32)
        self.next = np.zeros(1 << 16, np.int64)  # length << 8 | symbol
        code = 0
        for n, symbols in enumerate(by_length, 1):
            for s in symbols:
                self.code[s], self.length[s] = code, n
                self.next[code << 16 - n : code + 1 << 16 - n] = n << 8 | s
                code += 1
            code <<= 1
        self.segment = bytes(map(len, by_length)) + bytes(s for x in by_length for s in x)


@cache
def tables() -> tuple[Huffman, Huffman]:
    return Huffman(_dc_lengths()), Huffman(_ac_lengths())


@cache
def zigzag() -> np.ndarray:
    """Natural place (8 * row + column) of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


@cache
def inverse_dct() -> np.ndarray:
    """Pixels of a block are its zigzag coefficients times this."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    return np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[zigzag()]


def spans(starts, counts) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + counts[i] - 1 for every i, one after the other."""
    starts, counts = np.asarray(starts, np.int64), np.asarray(counts, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


# -- geometry
class Frame:
    """Sizes and block places of one image."""

    def __init__(self, height: int, width: int, sampling):
        self.height, self.width, self.sampling = height, width, tuple(sampling)
        hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.across, self.down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.strides = [self.across * h for h, _ in sampling]
        sizes = [self.across * h * self.down * v for h, v in sampling]
        self.first = [sum(sizes[:i]) for i in range(len(sizes))]
        self.blocks = sum(sizes)
        self.hmax, self.vmax = hmax, vmax

    def order(self, components: tuple[int, ...]) -> np.ndarray:
        """Blocks in the order of a scan of these components; one row per unit of the restart interval."""
        if len(components) == 1:
            c = components[0]
            h, v = self.sampling[c]
            rows, cols = -(-self.height * v // (8 * self.vmax)), -(-self.width * h // (8 * self.hmax))
            return (self.first[c] + np.arange(rows)[:, None] * self.strides[c] + np.arange(cols)[None, :]).reshape(-1, 1)
        y, x = np.divmod(np.arange(self.down * self.across), self.across)
        cols = []
        for c in components:
            h, v = self.sampling[c]
            cols += [self.first[c] + (y * v + i) * self.strides[c] + x * h + j for i in range(v) for j in range(h)]
        return np.stack(cols, 1)


@lru_cache(16)
def frame(height: int, width: int, sampling) -> Frame:
    return Frame(height, width, sampling)


@lru_cache(16)
def order(f: Frame, components: tuple[int, ...]) -> np.ndarray:
    return f.order(components)


def frame_for(blocks: int) -> Frame:
    units = -(-blocks // 6)
    down = int(units**0.5)
    return frame(16 * down, 16 * -(-units // down), SAMPLING)


# -- writing
def magnitude_bits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, extra bits) of values."""
    size = BIT_LENGTH[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint32)


BIT_LENGTH = np.array([i.bit_length() for i in range(4096)], np.int32)


def entropy(codes: np.ndarray, lengths: np.ndarray, per_lane: np.ndarray, lanes_per_part: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes as bytes, stuffed, with restart markers between the lanes of a part; and where each part starts."""
    ends = np.cumsum(per_lane)
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    bits = at[ends] - at[ends - per_lane]
    size = bits + 7 >> 3
    base = np.cumsum(size) - size
    bit = at[:-1] + np.repeat(8 * base - at[ends - per_lane], per_lane)
    byte = bit >> 3
    word = codes << (32 - lengths - (bit & 7)).astype(np.uint32)  # no code is longer than 25 bits
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    word, byte = np.add.reduceat(word, first), byte[first]
    out = np.zeros(int(size.sum()) + 8, np.uint8)
    for i in range(4):
        out[byte + i] |= (word >> np.uint32(24 - 8 * i)).astype(np.uint8)
    out[base + size - 1] |= ((1 << 8 * size - bits) - 1).astype(np.uint8)
    out = out[: int(size.sum())]
    # zeros after 255, and room for the markers
    lane_end = np.cumsum(lanes_per_part)
    last = np.zeros(len(size), bool)
    last[lane_end - 1] = True
    extra = np.zeros(len(out), np.int64)
    extra[out == 255] = 1
    extra[base + size - 1] += np.where(last, 0, 2)
    place = np.arange(len(out)) + np.cumsum(extra) - extra
    full = np.zeros(len(out) + int(extra.sum()), np.uint8)
    full[place] = out
    marks = place[base + size - 1] + 1 + (out[base + size - 1] == 255)
    number = np.arange(len(size)) - np.repeat(lane_end - lanes_per_part, lanes_per_part)
    full[marks[~last]], full[marks[~last] + 1] = 255, (0xD0 + number % 8)[~last]
    starts = place[base[lane_end - lanes_per_part]]
    return full.tobytes(), np.append(starts, len(full))


def lanes_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units in each lane, lanes in each part) of parts with so many units."""
    lanes = -(-units // RESTART)
    n = np.full(int(lanes.sum()), RESTART, np.int64)
    n[np.cumsum(lanes) - 1] = units - (lanes - 1) * RESTART
    return n, lanes


def write_dc_first(dc: np.ndarray, groups: list[np.ndarray], units: np.ndarray, al: int) -> tuple[bytes, np.ndarray]:
    """dc: one row per unit; groups: columns of each component."""
    per, lanes = lanes_of(units)
    starts = np.cumsum(per) - per
    v, diff = dc.astype(np.int64) >> al, np.empty(dc.shape, np.int64)
    for cols in groups:
        own = v[:, cols]
        flat = own.ravel()
        d = np.diff(flat, prepend=0)
        d[starts * len(cols)] = flat[starts * len(cols)]
        diff[:, cols] = d.reshape(own.shape)
    size, extra = magnitude_bits(diff.ravel())
    t = tables()[0]
    return entropy(t.code[size] << size.astype(np.uint32) | extra, t.length[size] + size, per * dc.shape[1], lanes)


def write_dc_refine(dc: np.ndarray, units: np.ndarray, al: int) -> tuple[bytes, np.ndarray]:
    per, lanes = lanes_of(units)
    bits = (dc.ravel() >> al & 1).astype(np.uint32)
    return entropy(bits, np.ones(len(bits), np.int32), per * dc.shape[1], lanes)


def write_ac_first(band: np.ndarray, units: np.ndarray, al: int) -> tuple[bytes, np.ndarray]:
    per, lanes = lanes_of(units)
    n, width = band.shape
    v = np.sign(band) * (np.abs(band) >> al)
    row, k = np.nonzero(v)
    value = v[row, k].astype(np.int32)
    row, k = row.astype(np.int32), k.astype(np.int32)
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]]), -1, np.concatenate([[-1], k[:-1]]))
    run = k - before - 1
    size, extra = magnitude_bits(value)
    symbol = (run & 15) << 4 | size
    each = 1 + (run >> 4)
    last = np.full(n, -1)
    last[row] = k  # the last of equal rows stays
    eob = last < width - 1
    so_far = np.cumsum(eob) - eob
    in_row = np.bincount(row, weights=each, minlength=n).astype(np.int64)
    t = tables()[1]
    total = int(each.sum() + eob.sum())
    codes, lengths = np.full(total, t.code[0xF0]), np.full(total, t.length[0xF0])
    main = np.cumsum(each) - 1 + so_far[row]
    codes[main] = t.code[symbol] << size.astype(np.uint32) | extra
    lengths[main] = t.length[symbol] + size
    end = (np.cumsum(in_row) + so_far)[eob]
    codes[end], lengths[end] = t.code[0], t.length[0]
    return entropy(codes, lengths, np.add.reduceat(in_row + eob, np.cumsum(per) - per), lanes)


def write_ac_refine(band: np.ndarray, units: np.ndarray, al: int) -> tuple[bytes, np.ndarray]:
    per, lanes = lanes_of(units)
    n, width = band.shape
    size = np.abs(band) >> al
    old, new, zero = size > 1, size == 1, size == 0
    # zeros since the last new coefficient; every sixteenth ends a run symbol if a new one follows
    ends, held = np.zeros((n, width + 1), bool), np.zeros((n, width + 1), bool)
    symbol, tail = np.zeros((n, width + 1), np.uint8), np.zeros((n, width + 1), np.uint8)
    held[:, :width] = old
    some = new.any(1)  # the other rows are ended at once
    if some.any():
        z, x = zero[some], new[some]
        zeros = np.cumsum(z, 1, dtype=np.int8)
        at_new = np.maximum.accumulate(np.where(x, zeros, 0), 1)
        since = zeros.copy()
        since[:, 1:] -= at_new[:, :-1]
        follows = np.cumsum(x[:, ::-1], 1, dtype=np.int8)[:, ::-1] > 0
        ends[some, :width] = x | z & (since % 16 == 0) & (since > 0) & follows
        symbol[some, :width] = np.where(x, (since % 16) << 4 | 1, 0xF0)
        tail[some, :width] = x
    sign = np.zeros((n, width + 1), np.uint32)
    sign[:, :width] = new & (band > 0)
    last = np.where(some, width - 1 - np.argmax(ends[:, :width][:, ::-1], 1), -1)
    ends[:, width] = last < width - 1
    e, h = ends.ravel(), held.ravel()
    span = np.cumsum(e) - e
    bits_before = np.cumsum(h) - h
    stop = np.flatnonzero(e)
    start = np.concatenate([[0], stop[:-1] + 1])
    t = tables()[1]
    total = len(stop) + int(h.sum())
    codes, lengths = np.zeros(total, np.uint32), np.ones(total, np.int32)
    slot = np.arange(len(stop)) + bits_before[start]
    s, x = symbol.ravel()[stop], tail.ravel()[stop].astype(np.uint32)
    codes[slot] = t.code[s] << x | sign.ravel()[stop]
    lengths[slot] = t.length[s] + x.astype(np.int32)
    bit = np.flatnonzero(h)
    codes[span[bit] + 1 + bits_before[bit]] = (size.ravel() & 1)[(bit // (width + 1)) * width + bit % (width + 1)].astype(np.uint32)
    return entropy(codes, lengths, np.add.reduceat(ends.sum(1) + held.sum(1), np.cumsum(per) - per), lanes)


def segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG for each payload of a positive multiple of 64 bytes."""
    n = np.array([len(p) // UNIT for p in payloads])
    frames = [frame_for(int(x)) for x in n]
    base = np.cumsum([0, *(f.blocks for f in frames)])
    coefficients = np.zeros((base[-1], 64), np.int16)
    coefficients[spans(base[:-1], n)] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) - 128
    dc, ac = tables()
    parts: list[list[bytes]] = []
    for d, f in enumerate(frames):
        sof = b"\x08" + f.height.to_bytes(2, "big") + f.width.to_bytes(2, "big") + b"\x03" + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
        parts.append([b"\xff\xd8", segment(0xFE, b"payload %d" % len(payloads[d])), segment(0xDB, b"\x00" + b"\x01" * 64), segment(0xC2, sof), segment(0xC4, b"\x00" + dc.segment), segment(0xC4, b"\x10" + ac.segment), segment(0xDD, RESTART.to_bytes(2, "big"))])
    for comps, ss, se, ah, al in SCRIPT:
        orders = [order(f, comps) for f in frames]
        units = np.array([len(o) for o in orders])
        at = np.concatenate([o + b for o, b in zip(orders, base, strict=False)])
        if ss == 0:
            rows = coefficients[:, 0][at]
            columns = np.repeat(np.arange(len(comps)), [SAMPLING[c][0] * SAMPLING[c][1] for c in comps])
            data, starts = write_dc_refine(rows, units, al) if ah else write_dc_first(rows, [np.flatnonzero(columns == c) for c in range(len(comps))], units, al)
        else:
            data, starts = (write_ac_refine if ah else write_ac_first)(coefficients[at[:, 0], ss : se + 1], units, al)
        head = segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), ss, se, ah << 4 | al]))
        for d in range(len(frames)):
            parts[d] += [head, data[starts[d] : starts[d + 1]]]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


# -- reading
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(image: bytes) -> dict:
    """Frame, quantisation, and scans (components, Ss, Se, Ah, Al, tables, restart interval, data) of a progressive JPEG."""
    out: dict = {"scans": [], "quant": {}, "comment": b""}
    at, huffman, restart = 2, {}, 0
    while at < len(image):
        marker = image[at + 1]
        if marker == 0xD9:
            break
        body = image[at + 4 : at + 2 + int.from_bytes(image[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                out["quant"][body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(float), body[65:]
        elif marker == 0xC2:
            out["ids"] = list(body[6::3])
            out["frame"] = frame(int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), tuple((x >> 4, x & 15) for x in body[7::3]))
            out["tq"] = list(body[8::3])
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(out["ids"].index(i) for i in body[1 : 2 * n : 2])
            ss, se, a = body[2 * n + 1 :]
            used = tuple(huffman.get((t >> 4) if ss == 0 else 0x10 | t & 15) for t in body[2 : 2 * n + 1 : 2])
            end = MARKER.search(image, at)
            stop = end.start() if end else len(image)
            out["scans"].append((comps, ss, se, a >> 4, a & 15, used, restart, image[at:stop]))
            at = stop
    return out


@lru_cache(256)
def reading_table(spec: bytes) -> Huffman:
    out, at = [], 16
    for n in spec[:16]:
        out.append(list(spec[at : at + n]))
        at += n
    return Huffman(out)


class Bits:
    """The lanes of many scans' data: unstuffed bytes, and where each lane begins (in bits)."""

    def __init__(self, data: list[bytes]):
        raw = np.frombuffer(b"".join(data) + b"\x00", np.uint8)
        sizes = np.array([len(x) for x in data])
        begin = np.zeros(len(raw), bool)
        begin[np.cumsum(sizes) - sizes] = True
        keep = np.ones(len(raw), bool)
        ff = np.flatnonzero(raw[:-1] == 255)
        keep[ff[raw[ff + 1] == 0] + 1] = False
        marks = ff[raw[ff + 1] >> 3 == 0xD0 >> 3]
        keep[marks] = keep[marks + 1] = False
        begin[marks + 2] = True
        self.bytes = np.concatenate([raw[keep], np.full(16, 255, np.uint8)])
        self.starts = 8 * (np.cumsum(keep) - keep)[begin]
        self.words = np.lib.stride_tricks.as_strided(self.bytes, (len(self.bytes) - 8, 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)

    def peek(self, bit: np.ndarray) -> np.ndarray:
        """The next 32 bits."""
        return ((self.words[bit >> 3] << (bit & 7).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)

    def single(self, bit: np.ndarray) -> np.ndarray:
        return (self.bytes[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(np.int64)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def lanes_in(units: np.ndarray, restart: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, units) of each lane."""
    if not restart:
        return np.cumsum(units) - units, units
    lanes = -(-units // restart)
    n = np.full(int(lanes.sum()), restart, np.int64)
    n[np.cumsum(lanes) - 1] = units - (lanes - 1) * restart
    return np.cumsum(n) - n, n


def read_dc_first(bits: Bits, shape: tuple[int, int], columns: np.ndarray, huffman: list[Huffman], first: np.ndarray, count: np.ndarray, al: int) -> np.ndarray:
    diff = np.zeros(shape[0] * shape[1], np.int64)
    pos, n = bits.starts.copy(), count * shape[1]
    for step in range(int(n.max())):
        live = np.flatnonzero(step < n)
        w = bits.peek(pos[live])
        got = huffman[columns[step % shape[1]]].next[w >> 16]
        length, size = got >> 8, got & 255
        diff[first[live] * shape[1] + step] = extended((w << length & 0xFFFFFFFF) >> 32 - size, size)
        pos[live] += length + size
    diff = diff.reshape(shape)
    out = np.empty_like(diff)
    for c in set(columns.tolist()):
        cols = np.flatnonzero(columns == c)
        flat = np.concatenate([[0], np.cumsum(diff[:, cols].ravel())])
        out[:, cols] = (flat[1:] - np.repeat(flat[first * len(cols)], count * len(cols))).reshape(-1, len(cols))
    return out << al


def read_ac_first(bits: Bits, n: int, width: int, huffman: Huffman, first: np.ndarray, count: np.ndarray, al: int) -> np.ndarray:
    out = np.zeros(n * width + 1, np.int64)
    pos, block, stop = bits.starts.copy(), first.copy(), first + count
    k = np.zeros(len(pos), np.int64)
    while len(pos):
        w = bits.peek(pos)
        got = huffman.next[w >> 16]
        length, r, s = got >> 8, got >> 4 & 15, got & 15
        eob = (s == 0) & (r < 15)
        size = np.where(eob, r, s)
        extra = (w << length & 0xFFFFFFFF) >> 32 - size
        k += r
        # a value, or sixteen zeros; what isn't one is written to a spare place
        out[np.where((s > 0) & (k < width), block * width + k, n * width)] = extended(extra, s) << al
        k += 1
        pos += length + size
        over = eob | (k >= width)
        block += np.where(eob, (1 << r) + extra, over)
        k[over] = 0
        if over.any() and (gone := block >= stop).any():
            left = ~gone
            pos, block, stop, k = pos[left], block[left], stop[left], k[left]
    return out[:-1].reshape(n, width)


def read_ac_refine(band: np.ndarray, bits: Bits, huffman: Huffman, first: np.ndarray, count: np.ndarray, al: int) -> np.ndarray:
    n, width = band.shape
    old = band != 0
    zeros = np.zeros((n, width + 1), np.int64)  # zeros before each place
    zeros[:, 1:] = np.cumsum(~old, 1)
    zero_at, old_at = np.flatnonzero(~old.ravel()), np.flatnonzero(old.ravel())
    zero_first = np.concatenate([[0], np.cumsum(zeros[:, width])])
    out = band.copy()
    flat, counts = out.ravel(), zeros.ravel()
    pos, block, stop = bits.starts.copy(), first.copy(), first + count
    k, rest = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    spanned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first old coefficient, how many, at which bit
    while len(pos):
        w = bits.peek(pos)
        got = huffman.next[w >> 16]
        length, r, s = got >> 8, got >> 4 & 15, got & 15
        going = rest > 0  # in a run of blocks without new coefficients
        eob = ~going & (s == 0) & (r < 15)
        size = np.where(eob, r, s)
        extra = (w << length & 0xFFFFFFFF) >> 32 - size
        pos = pos + np.where(going, 0, length + size)
        rest = np.where(going, rest - 1, np.where(eob, (1 << r) + extra - 1, 0))
        whole = going | eob
        here = counts[block * (width + 1) + k]
        wanted = here + r
        there = ~whole & (wanted < counts[block * (width + 1) + width])
        target = np.where(there, zero_at[np.minimum(zero_first[block] + np.where(there, wanted, 0), len(zero_at) - 1)] - block * width if len(zero_at) else 0, width)
        fresh = there & (s > 0)
        flat[block[fresh] * width + target[fresh]] = np.where(extra[fresh] > 0, 1, -1) << al
        upto = np.where(there, target, width)
        m = (upto - counts[block * (width + 1) + upto]) - (k - here)
        some = m > 0
        spanned.append(((block * width - zero_first[block] + k - here)[some], m[some], pos[some]))
        pos = pos + m
        k = np.where(there, target + 1, width)
        over = k >= width
        block = block + over
        k[over] = 0
        if over.any() and (gone := block >= stop).any():
            left = ~gone
            pos, block, stop, k, rest = pos[left], block[left], stop[left], k[left], rest[left]
    if spanned:
        start, m, bit = (np.concatenate(x) for x in zip(*spanned, strict=True))
        which = old_at[spans(start, m)]
        value = bits.single(spans(bit, m)) << al
        flat[which] += np.where(flat[which] < 0, -value, value)
    return out


def decode(images: list[bytes]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Parsed images of one scan script, their coefficients (zigzag rows) and the first row of each image."""
    parsed = [parse(x) for x in images]
    base = np.cumsum([0, *(p["frame"].blocks for p in parsed)])
    coefficients = np.zeros((base[-1], 64), np.int64)
    # scans that follow each other with the same band, bits and tables go side by side
    groups: list[tuple] = []
    script = [(s[:5], s[5], s[6]) for s in parsed[0]["scans"]]
    for i, ((comps, *band), used, restart) in enumerate(script):
        alike = (tuple(band), used if band[0] else i, restart, band[0] > 0)
        if groups and groups[-1][0] == alike:
            groups[-1][1].append(i)
        else:
            groups.append((alike, [i]))
    for ((ss, se, ah, al), *_), scans in groups:
        parts = [(p, int(b), p["scans"][i]) for i in scans for p, b in zip(parsed, base, strict=False)]
        orders = [order(p["frame"], s[0]) for p, _, s in parts]
        at = np.concatenate([o + b for o, (_, b, _) in zip(orders, parts, strict=True)])
        first, count = lanes_in(np.array([len(o) for o in orders]), parts[0][2][6])
        bits = Bits([s[7] for *_, s in parts])
        comps, used = parts[0][2][0], [reading_table(t) if t else None for t in parts[0][2][5]]
        if ss == 0:
            sampling = parsed[0]["frame"].sampling
            columns = np.repeat(np.arange(len(comps)), [sampling[c][0] * sampling[c][1] for c in comps]) if len(comps) > 1 else np.zeros(1, np.int64)
            if ah:
                where = spans(bits.starts, count * at.shape[1])
                coefficients[at.ravel(), 0] |= bits.single(where) << al
            else:
                coefficients[at, 0] = read_dc_first(bits, at.shape, columns, used, first, count, al)
        elif ah:
            coefficients[at, ss : se + 1] = read_ac_refine(coefficients[at[:, 0], ss : se + 1], bits, used[0], first, count, al)[:, None]
        else:
            coefficients[at, ss : se + 1] = read_ac_first(bits, len(at), se - ss + 1, used[0], first, count, al)[:, None]
    return parsed, coefficients, base


def tensors(parsed: list[dict], coefficients: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """RGB tensors (height, width, 3) of 8 bits."""
    flat = all((p["quant"][t] == 1).all() for p in parsed for t in p["tq"])
    out = []
    for lo, hi in sub_batches([p["frame"].blocks for p in parsed], 8192):
        pixels = None
        if flat:
            pixels = coefficients[base[lo] : base[hi]].astype(float) @ inverse_dct()
        for d in range(lo, hi):
            f, planes = parsed[d]["frame"], []
            for c, (h, v) in enumerate(f.sampling):
                rows, cols = f.down * v, f.across * h
                a = base[d] + f.first[c]
                own = pixels[a - base[lo] : a - base[lo] + rows * cols] if flat else coefficients[a : a + rows * cols] * parsed[d]["quant"][parsed[d]["tq"][c]] @ inverse_dct()
                plane = own.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
                # the hair more breaks ties alike, however the products were summed
                plane = np.clip(np.floor(plane + 128.500001), 0, 255)
                planes.append(np.repeat(np.repeat(plane, f.vmax // v, 0), f.hmax // h, 1)[: f.height, : f.width])
            if len(planes) == 1:
                planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
            out.append(np.clip(np.floor(rgb + 0.500001), 0, 255).astype(np.uint8))
    return out


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def payload_of(parsed: dict, rows: np.ndarray) -> bytes:
    n = int(parsed["comment"].split()[1])
    return (rows[: n // UNIT] + 128).astype(np.uint8).tobytes()


def described(rgb: np.ndarray) -> str:
    """Size, mean and deviation of each channel, and a checksum of the tensor."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    sums, squares = flat.sum(0, dtype=np.int64), (flat.astype(np.uint32) ** 2).sum(0, dtype=np.int64)
    mean, dev = sums / n, np.sqrt(np.maximum(0, squares / n - (sums / n) ** 2))
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{a:.4f}/{b:.4f}" for a, b in zip(mean, dev, strict=True)) + f";{zlib.crc32(rgb.tobytes()):08x}"


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
COLUMNS = "media binary, height int, width int, rgb binary"


def media_columns(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, with_media: bool = True) -> DataFrame:
    """The carried columns (all by default), the stored form's figures, and (with_media) the image and its tensor.

    A null text counts as empty; an empty one is stored as 64 zero bytes. Every text is stored whole and by
    itself, so equal texts give equal values, and nulls or repeats in other columns don't matter; an empty table gives
    an empty result. Carried columns may have any names; those that bear the name of a result give way to it.
    """

    def make(texts: list) -> list[list]:
        part = [(t or "").encode() for t in texts]
        images = encode([padded(t) for t in part])
        parsed, coefficients, base = decode(images)
        rows = []
        for d, rgb in enumerate(tensors(parsed, coefficients, base)):
            payload = payload_of(parsed[d], coefficients[base[d] : base[d + 1]])
            row = [len(part[d]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(images[d]), hashlib.sha256(images[d]).hexdigest(), described(rgb)]
            rows.append(row + ([images[d], rgb.shape[0], rgb.shape[1], rgb.tobytes()] if with_media else []))
        return [list(c) for c in zip(*rows, strict=True)]

    return mapped(df, carry or df.columns, text_col, FIELDS + (", " + COLUMNS) * with_media, make, BATCH_BYTES)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every document's image and tensor (see media_columns for odd rows)."""
    digest = [f.split()[0] for f in FIELDS.split(", ")]
    return media_columns(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", *digest)
