"""Progressive JPEG media columns: a decoder by scans, and a lossless store of bytes as DCT coefficients.

Decoding works on many images at once.  Every scan (spectral selection, successive approximation) adds to the images'
coefficient arrays; its entropy-coded segments, which restart markers make independent, are decoded side by side, one
symbol or one coefficient of each per numpy step.  Then coefficients are dequantised, transformed back (in exact integer
arithmetic, so that results do not depend on what else is in the batch), chroma is upsampled and RGB tensors of full
resolution come out.

``encode_payloads`` stores bytes losslessly: 64 of them are the 64 quantised coefficients of a block (less 96, so that
frequent letters are small), quantisation is 1, and blocks are dealt to luma and quarter-size chroma.  Each component
comes in five scans: DC and the first AC band without the lowest bit, the second AC band, then the refinements of DC and
the first band.

Defined results: null text is the empty payload, one block of zeros; equal payloads give equal media, whatever their
neighbours; null media give null tensors and features; a file that is no progressive Huffman JPEG with 8-bit samples
raises an error; tables without rows give none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

BIAS, UNIT, RESTART = 96, 64, 4
#: Bytes of payload or media that are worked on together.
BATCH = 1 << 19


def _zigzag() -> np.ndarray:
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()

# ---------------------------------------------------------------- Huffman tables


def huffman_lengths(weights: dict[int, float]) -> list[tuple[int, int]]:
    """(symbol, length) in canonical order; lengths up to 16 and no code of ones only."""
    heap = [(w, -s, (s,)) for s, w in weights.items()]
    heap.append((min(weights.values()) / 2, 1, (None,)))  # takes the code of ones
    heapify(heap)
    depth = dict.fromkeys([*weights, None], 0)
    while len(heap) > 1:
        (a, i, left), (b, j, right) = heappop(heap), heappop(heap)
        for s in left + right:
            depth[s] += 1
        heappush(heap, (a + b, min(i, j), left + right))
    spare = depth.pop(None)
    if max(spare, *depth.values()) > 16:
        raise ValueError("a code is too long")
    return sorted(depth.items(), key=lambda x: (x[1], x[0]))


def _dht(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = [sum(n == k for _, n in lengths) for k in range(1, 17)]
    return bytes([kind, *counts, *(s for s, _ in lengths)])


def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol, from a table as it stands in a file."""
    code, at = 0, 17
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n in range(1, 17):
        for _ in range(table[n]):
            codes[table[at]], lengths[table[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


@lru_cache(maxsize=256)
def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length | number of extra bits << 5 | run << 10 | size << 14; for DC tables size is the
    symbol.  Unused codes have length 0."""
    codes, lengths = _codes(table)
    out = np.zeros(1 << 16, np.int32)
    dc = table[0] < 16
    for s in np.flatnonzero(lengths):
        run, size = (0, int(s)) if dc else (int(s) >> 4, int(s) & 15)
        extra = size if size or dc else (run if run < 15 else 0)
        first = int(codes[s]) << (16 - int(lengths[s]))
        out[first : first + (1 << (16 - int(lengths[s])))] = int(lengths[s]) | extra << 5 | run << 10 | size << 14
    return out


def _own_tables() -> tuple[bytes, bytes, bytes]:
    """DC, AC first and AC refinement tables, from expected frequencies."""
    by_size = (0.06, 0.09, 0.2, 0.3, 0.2, 0.03, 0.2, 0.02)
    least = 2.0**-13
    first = {run << 4 | size: max(0.9 * 0.08**run * by_size[size - 1], least) for run in range(16) for size in range(1, 9)}
    refine = {run << 4 | 1: max(0.5 * 0.7**run, least) for run in range(16)}
    return (
        _dht(0x00, huffman_lengths({s: (0.02, 0.1, 0.15, 0.2, 0.2, 0.15, 0.15, 0.1, 0.01, 0.005, 0.002, 0.001)[s] for s in range(12)})),
        _dht(0x10, huffman_lengths(first | {0x00: 0.02, 0xF0: 0.01})),
        _dht(0x11, huffman_lengths(refine | {0x00: 0.5, 0xF0: 0.01})),
    )


_DC, _AC, _AC_REFINE = _own_tables()
#: Scans of each component: first and last coefficient, bits known before and after, table selectors.
SCANS = ((0, 0, 0, 1, 0x00), (1, 5, 0, 1, 0x00), (6, 63, 0, 0, 0x00), (0, 0, 1, 0, 0x00), (1, 5, 1, 0, 0x01))

# ---------------------------------------------------------------- encoding


@dataclass
class _Lanes:
    """Restart intervals of a batch: blocks in order, dealt to lanes, lanes to regions (component of an image)."""

    region_blocks: np.ndarray
    of_block: np.ndarray = field(init=False)
    first_block: np.ndarray = field(init=False)
    in_region: np.ndarray = field(init=False)
    first_lane: np.ndarray = field(init=False)

    def __post_init__(self):
        lanes = -(-self.region_blocks // RESTART)
        self.first_lane = np.cumsum(lanes) - lanes
        start = np.cumsum(self.region_blocks) - self.region_blocks
        region = np.repeat(np.arange(len(lanes)), lanes)
        self.in_region = np.arange(len(region)) - self.first_lane[region]
        self.first_block = start[region] + self.in_region * RESTART
        self.of_block = np.repeat(np.arange(len(region)), np.diff(np.append(self.first_block, self.region_blocks.sum())))


def _pack(values: np.ndarray, lengths: np.ndarray, lanes: _Lanes) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of all regions, end to end, with stuffed zeros and restart markers; where each starts.

    ``values``, ``lengths``: blocks by items, items of length 0 being none."""
    in_block = lengths.cumsum(axis=1)
    of_block = in_block[:, -1]
    before = of_block.cumsum() - of_block
    lane_bits = np.add.reduceat(of_block, lanes.first_block)
    lane_bytes = (lane_bits + 7) // 8
    lane_start = lane_bytes.cumsum() - lane_bytes
    total = int(lane_bytes.sum())
    start = before - before[lanes.first_block][lanes.of_block] + 8 * lane_start[lanes.of_block]
    there = lengths > 0
    n = lengths[there].astype(np.int64)
    at = (start[:, None] + in_block - lengths)[there]
    v = values[there]
    word, end = at >> 6, (at & 63) + n
    over = end > 64
    main = np.where(over, v >> np.where(over, end - 64, 0).astype(np.uint64), v << np.where(over, 0, 64 - end).astype(np.uint64))
    words = np.zeros(total // 8 + 2, np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[heads]] = np.add.reduceat(main, heads)
    words[word[over] + 1] |= v[over] << (128 - end[over]).astype(np.uint64)
    raw = words.byteswap().view(np.uint8)[:total]
    raw[lane_start + lane_bytes - 1] |= ((1 << (lane_bytes * 8 - lane_bits)) - 1).astype(np.uint8)
    full = raw == 255
    later = lanes.in_region > 0
    to = np.arange(total) + full.cumsum() - full + 2 * np.repeat(later.cumsum(), lane_bytes)
    out = np.zeros(total + int(full.sum()) + 2 * int(later.sum()), np.uint8)
    out[to] = raw
    marks = to[lane_start[later]]
    out[marks - 2] = 255
    out[marks - 1] = 0xD0 + (lanes.in_region[later] - 1) % 8
    return out.tobytes(), to[lane_start[lanes.first_lane]]


def _size_of(v: np.ndarray) -> np.ndarray:
    """Number of bits of |v|, for |v| < 2048."""
    return _BITS[np.abs(v)]


_BITS = np.array([int(k).bit_length() for k in range(2048)], np.int64)


def _first_dc(coefs: np.ndarray, al: int, lanes: _Lanes) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = _codes(_DC)
    v = coefs[:, 0].astype(np.int64) >> al
    d = np.diff(v, prepend=0)
    d[lanes.first_block] = v[lanes.first_block]
    s = _size_of(d)
    extra = np.where(d < 0, d + (1 << s) - 1, d).astype(np.uint64)
    return (codes[s] << s.astype(np.uint64) | extra)[:, None], (lengths[s] + s)[:, None]


def _first_ac(coefs: np.ndarray, lo: int, hi: int, al: int) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = _codes(_AC)
    band = coefs[:, lo : hi + 1]
    a = (np.sign(band) * (np.abs(band) >> al)).astype(np.int64)
    width = a.shape[1]
    there = a != 0
    column = np.arange(width)
    last = np.maximum.accumulate(np.where(there, column, -1), axis=1)
    values = np.zeros((len(a), width + 1), np.uint64)
    sizes = np.zeros((len(a), width + 1), np.int64)
    row, col = np.nonzero(there)
    v = a[row, col]
    run = col - 1 - np.where(col > 0, last[row, col - 1], -1)
    s = _size_of(v)
    symbol = (run & 15) << 4 | s
    bits, n = codes[symbol] << s.astype(np.uint64) | np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64), lengths[symbol] + s
    for k in range(1, 4):  # runs of 16 zeros come before
        more = run >= 16 * k
        bits[more] |= codes[0xF0] << n[more].astype(np.uint64)
        n[more] += lengths[0xF0]
    values[row, col], sizes[row, col] = bits, n
    short = last[:, -1] < width - 1
    values[short, width], sizes[short, width] = codes[0], lengths[0]
    return values, sizes


def _refine_ac(coefs: np.ndarray, lo: int, hi: int, ah: int, al: int) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = _codes(_AC_REFINE)
    band = coefs[:, lo : hi + 1]
    size = np.abs(band)
    known = (size >> ah) > 0
    new = ((size >> al) > 0) & ~known
    blank = ~known & ~new
    column = np.arange(band.shape[1], dtype=np.int16)
    zeros = blank.cumsum(axis=1, dtype=np.int16)
    since = zeros - np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    last_new = np.where(new, column, -1).max(axis=1)
    long = blank & (since % 16 == 0) & (column < last_new[:, None])
    ends = new | long
    opens = np.ones_like(ends)
    opens[:, 1:] = ends[:, :-1]
    far = np.int16(band.shape[1])
    following = np.minimum.accumulate(np.where(ends, column, far)[:, ::-1], axis=1)[:, ::-1]
    values = ((size >> al) & 1).astype(np.uint64) * known
    sizes = known.astype(np.int64)
    row, col = np.nonzero(opens)
    end = following[row, col]
    closing = end == far
    at = np.where(closing, 0, end)
    is_new = ~closing & new[row, at]
    run = since[row, np.maximum(at - 1, 0)] % 16 * (at > 0) * is_new
    symbol = np.where(closing, 0x00, np.where(is_new, run << 4 | 1, 0xF0))
    bits, n = codes[symbol], lengths[symbol]
    bits = np.where(is_new, bits << np.uint64(1) | (band[row, at] > 0).astype(np.uint64), bits)
    n = n + is_new
    values[row, col] |= bits << sizes[row, col].astype(np.uint64)
    sizes[row, col] += n
    return values, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


_TABLES = _segment(0xDB, bytes([0, *[1] * 64])) + b"".join(_segment(0xC4, t) for t in (_DC, _AC, _AC_REFINE)) + _segment(0xDD, struct.pack(">H", RESTART))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEG files whose coefficients are the payloads; each a positive multiple of 64 bytes."""
    blocks = np.array([len(p) // UNIT for p in payloads], np.int64)
    wide = np.ceil(np.sqrt(-(-blocks // 6))).astype(np.int64)
    high = -(-(-(-blocks // 6)) // wide)
    units = wide * high
    first = np.cumsum(6 * units) - 6 * units
    coefs = np.zeros((int(6 * units.sum()), UNIT), np.int16)
    rows = np.arange(blocks.sum()) + np.repeat(first - (np.cumsum(blocks) - blocks), blocks)
    coefs[rows] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int16) - BIAS
    lanes = _Lanes(np.stack([4 * units, units, units], axis=1).ravel())
    coded = []
    for lo, hi, ah, al, _ in SCANS:
        if hi == 0 and ah == 0:
            items = _first_dc(coefs, al, lanes)
        elif hi == 0:
            items = ((coefs[:, :1].astype(np.int64) >> al) & 1).astype(np.uint64), np.ones((len(coefs), 1), np.int64)
        elif ah == 0:
            items = _first_ac(coefs, lo, hi, al)
        else:
            items = _refine_ac(coefs, lo, hi, ah, al)
        data, starts = _pack(*items, lanes)
        coded.append((data, [*starts.tolist(), len(data)]))
    heads = [[_segment(0xDA, bytes([1, c + 1, tables, lo, hi, ah << 4 | al])) for c in range(3)] for lo, hi, ah, al, tables in SCANS]
    files = []
    for k, (w, h) in enumerate(zip(wide.tolist(), high.tolist(), strict=True)):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payloads[k]))), _TABLES, _segment(0xC2, frame)]
        for head, (data, starts) in zip(heads, coded, strict=True):
            for c in range(3):
                parts += [head[c], data[starts[3 * k + c] : starts[3 * k + c + 1]]]
        files.append(b"".join([*parts, b"\xff\xd9"]))
    return files

# ---------------------------------------------------------------- decoding


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row, as stored
    high: int = 0
    own_wide: int = 0  # blocks in a row of a scan of this component alone
    own_high: int = 0
    first: int = 0  # block of the batch


@dataclass
class Scan:
    lo: int
    hi: int
    ah: int
    al: int
    parts: list[tuple[int, bytes, bytes]]  # component, DC table, AC table
    restart: int
    start: int  # of the first segment in the file
    marks: tuple[int, int]  # range of the file's restart markers that cut it


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    scans: list[Scan]
    units: tuple[int, int]  # MCUs across and down
    restarts: np.ndarray  # where restart markers stand in the file
    comment: bytes = b""


@lru_cache(maxsize=256)
def _quants(body: bytes) -> dict[int, np.ndarray]:
    out = {}
    while body:
        wide = body[0] >> 4
        out[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float64)
        body = body[1 + 64 * (1 + wide) :]
    return out


@lru_cache(maxsize=256)
def _tables(body: bytes) -> dict[int, bytes]:
    out = {}
    while body:
        n = 17 + sum(body[1:17])
        out[body[0]] = body[:n]
        body = body[n:]
    return out


def parse(data: bytes) -> Image:
    """Markers and segments of one file."""
    raw = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    is_restart = (after & 0xF8) == 0xD0
    restarts, others = full[is_restart], full[(after != 0) & (after != 255) & ~is_restart].tolist()
    marks = restarts.tolist()
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, restart, tables, ids, n_other = 2, 0, {}, [], 0
    image, comment = None, b""
    quants: dict[int, np.ndarray] = {}
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            break
        length = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            quants |= _quants(body)
        elif marker == 0xC4:
            tables |= _tables(body)
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            bits, height, width, count = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height:
                raise ValueError("only 8-bit samples and known heights")
            parts = [Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            ids = [body[6 + 3 * k] for k in range(count)]
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            units = -(-width // (8 * h)), -(-height // (8 * v))
            for c in parts:
                c.wide, c.high = units[0] * c.h, units[1] * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
            image = Image(width, height, parts, quants, [], units, restarts)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"not a progressive Huffman file (frame {marker:#x})")
        elif marker == 0xDA:
            n = body[0]
            lo, hi, bits = body[1 + 2 * n : 4 + 2 * n]
            chosen = [(ids.index(body[1 + 2 * k]), tables.get(body[2 + 2 * k] >> 4, b""), tables.get(0x10 | body[2 + 2 * k] & 15, b"")) for k in range(n)]
            while others[n_other] < at:
                n_other += 1
            stop = others[n_other]
            a = bisect_left(marks, at)
            image.scans.append(Scan(lo, hi, bits >> 4, bits & 15, chosen, restart, at, (a, bisect_left(marks, stop, a))))
            at = stop
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _blocks_of(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Blocks of a scan in order, the place of each one's component in the scan, and blocks of a restart unit; None for
    all blocks of one component as they are stored."""
    if len(scan.parts) == 1:
        c = image.components[scan.parts[0][0]]
        if c.own_wide == c.wide:
            return None
        at = (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).ravel()
        return c.first + at, np.zeros(len(at), np.int64), 1
    across, down = image.units
    x, y = np.tile(np.arange(across), down), np.repeat(np.arange(down), across)
    blocks, places = [], []
    for k, (index, _, _) in enumerate(scan.parts):
        c = image.components[index]
        for j in range(c.v):
            for i in range(c.h):
                blocks.append(c.first + (y * c.v + j) * c.wide + x * c.h + i)
                places.append(np.full(len(x), k))
    return np.stack(blocks, 1).ravel(), np.stack(places, 1).ravel(), len(blocks)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then those of first[1], and so on."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


class _Bits:
    """A bit reader over many positions: 33 bits from any bit on."""

    def __init__(self, raw: np.ndarray):
        padded = np.concatenate([raw, np.zeros(1024, np.uint8)])
        n = len(raw) + 1000
        self.window = padded[:n].astype(np.int64)
        for k in range(1, 5):
            self.window <<= 8
            self.window |= padded[k : n + k]
        self.most = 8 * (n - 1)

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The 40 bits from the byte on, moved so that the bit at ``at`` is bit 39."""
        return (self.window[at >> 3] << (at & 7)) & 0xFFFFFFFFFF

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.window[at >> 3] >> (39 - (at & 7))) & 1


def _extra(x: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (x >> (40 - length - n)) & ((1 << n) - 1)


def _signed(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << n >> 1), bits - (1 << n) + 1, bits)


def _decode_wave(bits: _Bits, coefs: np.ndarray, lo: int, hi: int, ah: int, al: int, at: np.ndarray, count: np.ndarray, unit: np.ndarray, blocks: np.ndarray, places: np.ndarray, tables: np.ndarray, luts: np.ndarray) -> None:
    """Segments of scans of one kind, side by side.  ``at``: first bit of each; ``count``: its blocks; ``unit``: where
    these start in ``blocks`` and ``places``; ``tables``: lookup of each segment by place in the scan."""
    flat = coefs.reshape(-1)
    if hi == 0:
        order = np.argsort(-count, kind="stable")
        at, count, unit, tables = at[order].copy(), count[order], unit[order], tables[order]
        before = np.zeros(tables.shape, np.int64)
        for u in range(int(count[0])):
            n = int(np.searchsorted(-count, -u, side="left"))
            block = blocks[unit[:n] + u] * 64
            if ah:
                flat[block] |= (bits.bit(at[:n]) << al).astype(np.int16)
                at[:n] += 1
                continue
            row, place = np.arange(n), places[unit[:n] + u]
            x = bits.ahead(at[:n])
            e = luts[tables[row, place], x >> 24]
            length, size = e & 31, e >> 14
            before[row, place] += _signed(_extra(x, length, size), size)
            flat[block] = before[row, place] << al
            at[:n] += length + size
        return
    table = tables[:, 0]
    if ah == 0:
        block, k, trash = np.zeros(len(at), np.int64), np.full(len(at), lo), len(coefs) - 1
        step = 0
        while len(at):
            x = bits.ahead(at)
            e = luts[table, x >> 24]
            length, n, run, size = e & 31, (e >> 5) & 31, (e >> 10) & 15, e >> 14
            more = _extra(x, length, n)
            at = np.minimum(at + length + n, bits.most)
            is_value = size > 0
            to = k + run
            row = np.where(block < count, blocks[np.minimum(unit + block, len(blocks) - 1)], trash)
            write = np.flatnonzero(is_value)
            flat[row[write] * 64 + np.minimum(to[write], 63)] = _signed(more[write], size[write]) << al
            ends = ~is_value & (run < 15)
            k = to + 1
            block = block + np.where(ends, (1 << run) + more, k > hi)
            k = np.where(ends | (k > hi), lo, k)
            step += 1
            if step % 8 == 0:
                live = block < count
                if not live.all():
                    at, count, unit, table, block, k = (v[live] for v in (at, count, unit, table, block, k))
        return
    order = np.argsort(-count, kind="stable")
    at, count, unit, table = at[order].copy(), count[order], unit[order], table[order]
    left = np.zeros(len(at), np.int64)  # blocks that an end-of-band run still covers
    for u in range(int(count[0])):
        n = int(np.searchsorted(-count, -u, side="left"))
        pos, eob = at[:n], left[:n]
        base = blocks[unit[:n] + u] * 64
        need = eob == 0
        run, pending = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(lo, hi + 1):
            want = np.flatnonzero(need)
            if len(want):
                x = bits.ahead(pos[want])
                e = luts[table[want], x >> 24]
                length, r, size = e & 31, (e >> 10) & 15, e >> 14
                extra = np.where(size > 0, 1, (e >> 5) & 31)
                more = _extra(x, length, extra)
                pos[want] += length + extra
                run[want] = r
                pending[want] = np.where(size > 0, (2 * more - 1) << al, 0)
                ends = (size == 0) & (r < 15)
                eob[want[ends]] = (1 << r[ends]) + more[ends]
                need[want] = False
            c = flat[base + k].astype(np.int64)
            known = c != 0
            c += np.where(known, bits.bit(pos) * np.sign(c) << al, 0)
            pos += known
            blank = ~known & (eob == 0)
            put = blank & (run == 0)
            c[put] = pending[put]
            flat[base + k] = c
            need |= put
            run -= blank & ~put
        np.maximum(eob - 1, 0, out=eob)


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Coefficients (blocks by 64, in zigzag order) of all images, as the last scan leaves them."""
    images = [parse(f) for f in files]
    total = 0
    for image in images:
        for c in image.components:
            c.first = total
            total += c.wide * c.high
    coefs = np.zeros((total + 1, 64), np.int16)  # the last block takes what belongs nowhere
    raw = np.frombuffer(b"".join(files), np.uint8)
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
    removed = np.concatenate([[0], stuffed.cumsum()])
    bits = _Bits(raw[~stuffed])
    offsets = np.cumsum([0, *map(len, files)])
    marks = [len(i.restarts) for i in images]
    first_mark = np.cumsum([0, *marks]).tolist()
    # one more, so that scans without restart markers have something to look at
    all_marks = np.append(np.concatenate([i.restarts for i in images]) + np.repeat(offsets[:-1], marks), 0)
    names: dict[bytes, int] = {}
    turn = [0] * len(images)
    while True:
        waves: dict[tuple, list] = {}
        for k, image in enumerate(images):
            # scans of one kind that follow each other touch different components
            seen: set[int] = set()
            kind = None
            while turn[k] < len(image.scans):
                s = image.scans[turn[k]]
                used = {p[0] for p in s.parts}
                if kind not in (None, (s.lo, s.hi, s.ah, s.al)) or seen & used:
                    break
                kind = s.lo, s.hi, s.ah, s.al
                seen |= used
                waves.setdefault(kind, []).append((k, s))
                turn[k] += 1
        if not waves:
            break
        for (lo, hi, ah, al), found in waves.items():
            # by scan: first byte, range of restart markers, first block, blocks, blocks of an interval, lookup tables
            rows, rest, unusual = [], [], []
            for n, (k, s) in enumerate(found):
                own = _blocks_of(images[k], s)
                c = images[k].components[s.parts[0][0]]
                size = c.own_high * c.wide if own is None else len(own[0])
                width = 1 if own is None else own[2]
                rows.append((s.start + offsets[k], s.marks[0] + first_mark[k], s.marks[1] - s.marks[0], c.first, size, s.restart * width or max(1, size)))
                row = [names.setdefault(t[1 if hi == 0 else 2], len(names)) if not (hi == 0 and ah) else 0 for t in s.parts]
                rest.append(row + [row[0]] * (4 - len(row)))
                if own is not None:
                    unusual.append((n, own))
            start, mark, marks, first, size, per = np.array(rows, np.int64).T
            lanes = marks + 1
            if (lanes != np.maximum(1, -(-size // per))).any():
                raise ValueError("restart intervals do not match")
            of_scan, in_scan = np.repeat(np.arange(len(lanes)), lanes), _spread(np.zeros_like(lanes), lanes)
            cuts = np.where(in_scan == 0, start[of_scan], all_marks[mark[of_scan] + in_scan - 1] + 2)
            unit = (np.cumsum(size) - size)[of_scan] + in_scan * per[of_scan]
            count = np.minimum(per[of_scan], size[of_scan] - in_scan * per[of_scan])
            blocks, places = _spread(first, size), np.zeros(size.sum(), np.int64)
            for n, own in unusual:
                a = size[:n].sum()
                blocks[a : a + size[n]], places[a : a + size[n]] = own[:2]
            luts = np.stack([_lookup(t) if t else np.zeros(1 << 16, np.int32) for t in names]) if names else np.zeros((1, 1 << 16), np.int32)
            _decode_wave(bits, coefs, lo, hi, ah, al, 8 * (cuts - removed[cuts]), count, unit, blocks, places, np.array(rest)[of_scan], luts)
    return images, coefs[:total]


def _basis() -> np.ndarray:
    """Inverse transform, scaled by 2 ** 11 and rounded: exact in double precision for all coefficients there are."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.round(2**11 * np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16))


_BASIS = _basis()
_NATURAL = np.argsort(ZIGZAG)


def samples(images: list[Image], coefs: np.ndarray) -> np.ndarray:
    """8 by 8 samples (0 to 255) of all blocks."""
    scale = np.empty((len(coefs), 64)) if any((q != 1).any() for i in images for q in i.quants.values()) else None
    if scale is not None:
        for image in images:
            for c in image.components:
                scale[c.first : c.first + c.wide * c.high] = image.quants[c.quant]
    x = coefs.astype(np.float64)
    x = (x if scale is None else x * scale)[:, _NATURAL].reshape(-1, 8)
    x = (x @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
    x = (x @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(np.floor(x * 2.0**-22 + 128.5), 0, 255).astype(np.uint8)


def _plane(c: Component, blocks: np.ndarray) -> np.ndarray:
    return blocks[c.first : c.first + c.wide * c.high].reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.high, 8 * c.wide)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Height by width by 3; chroma is repeated up to full resolution."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        p = _plane(c, blocks)
        if v != c.v:
            p = np.repeat(p, v // c.v, axis=0)
        if h != c.h:
            p = np.repeat(p, h // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    out[..., 0] = np.maximum(np.minimum(y + ((91881 * cr + 32768) >> 16), 255), 0)
    out[..., 1] = np.maximum(np.minimum(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 255), 0)
    out[..., 2] = np.maximum(np.minimum(y + ((116130 * cb + 32768) >> 16), 255), 0)
    return out


def decoded(files: list[bytes]) -> Iterator[tuple[Image, np.ndarray, np.ndarray]]:
    """Each image with its coefficients and its RGB tensor, decoded in batches."""
    start = 0
    while start < len(files):
        stop, held = start, 0
        while stop < len(files) and (stop == start or held + len(files[stop]) <= BATCH):
            held += len(files[stop])
            stop += 1
        images, coefs = coefficients(files[start:stop])
        blocks = samples(images, coefs)
        for image in images:
            a, b = image.components[0].first, image.components[-1].first + image.components[-1].wide * image.components[-1].high
            yield image, coefs[a:b], rgb(image, blocks)
        start = stop


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _stored_texts(texts: pd.Series) -> Iterator[bytes]:
    """Media of texts; only a batch of payloads exists at a time."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        payload = padded(as_bytes(text))
        if held and size + len(payload) > BATCH:
            yield from encode_payloads(held)
            held, size = [], 0
        held.append(payload)
        size += len(payload)
    if held:
        yield from encode_payloads(held)

# ---------------------------------------------------------------- columns


def _encode(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_stored_texts(texts)), dtype=object)


def stored(text: Column) -> Column:
    """Media column that holds a text's UTF-8 bytes, padded, as a progressive JPEG."""
    return F.pandas_udf(_encode, "binary")(text)


def _tensors(media: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None)] * len(media)
    there = [k for k, x in enumerate(media) if x is not None]
    for k, (image, _, tensor) in zip(there, decoded([bytes(media.iloc[k]) for k in there]), strict=True):
        rows[k] = image.width, image.height, tensor.tobytes()
    return pd.DataFrame(rows, columns=["width", "height", "rgb"]).astype({"width": "Int32", "height": "Int32"})


def with_tensors(df: DataFrame, media_col: str = "media", out: str = "image") -> DataFrame:
    """``df`` with a struct of width, height and RGB tensor (row by row, three bytes a pixel)."""
    return df.withColumn(out, F.pandas_udf(_tensors, "width int, height int, rgb binary")(media_col))


def payload_of(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that ``encode_payloads`` stored; their number is in the file's comment."""
    (size,) = struct.unpack(">Q", image.comment)
    return (coefs[: size // UNIT] + BIAS).astype(np.uint8).tobytes()


def _features(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data, (image, coefs, tensor) in zip(media, decoded(media.tolist()), strict=True):
        payload = payload_of(image, coefs)
        mean = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) // max(1, tensor.size // 3)
        feature = f"{image.width}x{image.height} rgb {mean[0]},{mean[1]},{mean[2]} crc {zlib.crc32(tensor):08x}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, read it back and describe both: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.  The two functions of one argument run in one worker, one after the other."""
    features = F.pandas_udf(_features, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col), size.alias("n_bytes"), features(stored(F.col(text_col))).alias("f"))
    return rows.select(id_col, "n_bytes", "f.*")
