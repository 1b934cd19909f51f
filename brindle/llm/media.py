"""Progressive JPEG as a column type: decoding to RGB tensors, and lossless payloads in coefficients.

The decoder works on many files at once. A restart interval of a scan is a lane: it can be decoded
without any other, since prediction and runs start anew there. All lanes of all files that share a
band, a bit position and a Huffman table advance together, one symbol a step, as numpy arrays; the
scans of spectral selection and successive approximation add up in one array of coefficients. A file
without restart markers has one lane a scan, which is correct and slow.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import text as tx
from brindle.session import bound_batches, materialize, scratch

U = np.uint64
#: Payloads are padded with blanks to a multiple of this.
UNIT = 192
#: Blocks (or, in interleaved scans, groups of blocks) between restart markers of what is written here.
INTERVAL = 4
#: Bytes of files that are decoded together.
BYTES_AT_ONCE = 1 << 21
#: Bands of spectral selection of what is written here.
BANDS = ((1, 5), (6, 63))

#: Fixed values of the format: the order of coefficients in a block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _basis() -> np.ndarray:
    """Row k: the 8 x 8 pixels of the coefficient that comes k-th in zigzag order."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG]


_BASIS = _basis()


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, number: int, codes: dict[int, list[int]]) -> bytes:
    """A table segment: symbols by length of code."""
    return _segment(0xC4, bytes([kind << 4 | number]) + bytes(len(codes.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in codes.get(n, [])))


#: The tables of what is written here. DC: sizes 0 to 11 in four bits each. First AC scans: a coefficient
#: of seven bits has the one-bit code. AC refinement: runs of four blocks and more have it.
_TABLES = _huffman(0, 0, {4: list(range(12))}) + _huffman(1, 0, {1: [0x07], 2: [0x00], 3: [0xF0]}) + _huffman(1, 1, {1: [0x20], 2: [0x10], 3: [0x00]})
_QUANT = _segment(0xDB, b"\0" + b"\1" * 64)


@lru_cache(maxsize=64)
def _scan(components: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    table = 0 if not first or not high else 1
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, table if first else 0]) for c in components) + bytes([first, last, high << 4 | low]))


_MARKS = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def _with_marks(lanes: list[bytes]) -> list[bytes]:
    """Lanes with restart markers between them; bytes of 255 are stuffed."""
    out = []
    for i, lane in enumerate(lanes):
        out += (lane.replace(b"\xff", b"\xff\0"), _MARKS[i & 7])
    out.pop()
    return out


def _cut(data: bytes, width: int) -> list[bytes]:
    return [data[i : i + width] for i in range(0, len(data), width)]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as bytes, filled up with ones."""
    short = -bits.shape[1] % 8
    if short:
        bits = np.hstack([bits, np.ones((len(bits), short), np.uint8)])
    return np.packbits(bits, axis=1)


def _dc_first(dc: np.ndarray) -> list[bytes]:
    """The first DC scan of an array of MCUs by six blocks, halved: differences by component."""
    half = (dc >> 1).astype(np.int64)
    n = len(half)
    before = np.zeros_like(half)
    before[:, 1:4] = half[:, :3]
    before[1:, 0], before[1:, 4], before[1:, 5] = half[:-1, 3], half[:-1, 4], half[:-1, 5]
    before[::INTERVAL][:, [0, 4, 5]] = 0
    diff = (half - before).ravel()
    size = np.frexp(np.abs(diff))[1].astype(np.int64)  # bits of the magnitude
    value = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = size + 4
    lane = np.arange(len(diff)) // (6 * INTERVAL)
    start = np.cumsum(length) - length
    first = start[:: 6 * INTERVAL]
    total = np.diff(np.append(first, start[-1] + length[-1]))
    width = (total + 7) // 8
    at = np.cumsum(width) - width
    bits = np.ones(int(width.sum()) * 8, np.uint8)
    offset = start - first[lane] + at[lane] * 8
    which = np.repeat(np.arange(len(diff)), length)
    inner = np.arange(len(which)) - np.repeat(start, length)
    bits[offset[which] + inner] = value[which] >> (length[which] - 1 - inner) & 1
    data, ends = np.packbits(bits).tobytes(), (at + width).tolist()
    return _with_marks([data[x:y] for x, y in zip(at.tolist(), ends, strict=True)])


def grid(mcus: int) -> tuple[int, int]:
    """Columns and rows of MCUs of a picture that holds so many."""
    columns = int(np.ceil(np.sqrt(mcus)))
    return columns, -(-mcus // columns)


def encode_payload(payload: bytes, stated: int) -> bytes:
    """A progressive 4:2:0 JPEG whose quantized coefficients hold the payload, a byte each.

    Byte b is the coefficient b if it is 128 or more, else b - 255: all have eight bits, of which the
    first scans carry seven and the refinement scans the last. ``stated`` is the number of bytes
    before padding; it stands in a comment.
    """
    columns, rows = grid(max(1, -(-len(payload) // 384)))
    if max(columns, rows) > 4095:
        raise ValueError("the payload is too long for one picture")
    n = columns * rows
    data = np.full(n * 384, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    mcu = data.reshape(n, 6, 64)

    def planes(x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64), x[:, 4], x[:, 5]]

    out = [b"\xff\xd8", _segment(0xFE, f"payload {len(payload)} of {stated}".encode()), _QUANT]
    out += [_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + b"\1\x22\0\2\x11\0\3\x11\0"), _TABLES, _segment(0xDD, struct.pack(">H", INTERVAL))]
    dc = mcu[:, :, 0].astype(np.int16)
    dc -= (dc < 128) * np.int16(255)
    out += [_scan((1, 2, 3), 0, 0, 0, 1), *_dc_first(dc)]
    high = planes(mcu >> 1)
    for first, last in BANDS:
        for c, plane in enumerate(high, 1):
            out += [_scan((c,), first, last, 0, 1), *_with_marks(_cut(plane[:, first : last + 1].tobytes(), INTERVAL * (last - first + 1)))]
    for c, plane in enumerate(planes((mcu & 1) ^ (mcu < 128)), 1):
        whole = len(plane) // INTERVAL * INTERVAL
        body = np.zeros((whole // INTERVAL, 3 + 63 * INTERVAL), np.uint8)  # the code of a run of four, and its two bits
        body[:, 3:] = plane[:whole, 1:].reshape(-1, 63 * INTERVAL)
        lanes = _cut(_packed(body).tobytes(), (63 * INTERVAL + 10) // 8)
        if left := len(plane) - whole:
            code = {1: [1, 1, 0], 2: [1, 0, 0], 3: [1, 0, 1]}[left]
            lanes.append(_packed(np.concatenate([code, plane[whole:, 1:].ravel()]).astype(np.uint8)[None, :]).tobytes())
        out += [_scan((c,), 1, 63, 1, 0), *_with_marks(lanes)]
    bit = (dc & 1).astype(np.uint8)
    whole = n // INTERVAL * INTERVAL
    lanes = _cut(_packed(bit[:whole].reshape(-1, 6 * INTERVAL)).tobytes(), 6 * INTERVAL // 8)
    if whole < n:
        lanes.append(_packed(bit[whole:].reshape(1, -1)).tobytes())
    out += [_scan((1, 2, 3), 0, 0, 1, 0), *_with_marks(lanes), b"\xff\xd9"]
    return b"".join(out)


# ---------------------------------------------------------------- reading


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: length of the code there, times 256, and its symbol."""
    out = np.zeros(1 << 16, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[at]
            code += 1
            at += 1
        code <<= 1
    return out


@dataclass
class Component:
    """Blocks of a component: the grid that is stored, the part that scans of it alone cover, and where it starts in the array of all blocks."""

    h: int
    v: int
    quant: int
    columns: int = 0
    rows: int = 0
    own_columns: int = 0
    own_rows: int = 0
    start: int = 0


@dataclass
class Picture:
    """A parsed file; ``coefficients`` are set once all scans are decoded."""

    width: int = 0
    height: int = 0
    mcu_columns: int = 0
    mcu_rows: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    base: int = 0
    blocks: int = 0


@dataclass
class _Scan:
    picture: int
    components: list[int]
    tables: tuple
    interval: int
    start: int
    end: int


def _parse(buf: bytes, lo: int, hi: int, real: list[int], number: int, base: int, scans: dict) -> Picture:
    """Reads the segments of the file in buf[lo:hi] and files its scans by what lanes have to share."""
    p, at, huffman, interval = Picture(base=base), lo, {}, 0
    if buf[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at += 2
    while at < hi:
        if buf[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = buf[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return p
        size = buf[at + 2] << 8 | buf[at + 3]
        body = buf[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                p.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            interval = body[0] << 8 | body[1]
        elif marker == 0xFE:
            p.comments.append(body)
        elif marker == 0xC2:
            p.height, p.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            for i in range(body[5]):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                p.components[c] = Component(hv >> 4, hv & 15, q)
            most_h, most_v = max(c.h for c in p.components.values()), max(c.v for c in p.components.values())
            p.mcu_columns, p.mcu_rows = -(-p.width // (8 * most_h)), -(-p.height // (8 * most_v))
            for c in p.components.values():
                c.columns, c.rows = p.mcu_columns * c.h, p.mcu_rows * c.v
                c.own_columns, c.own_rows = -(-(-(-p.width * c.h // most_h)) // 8), -(-(-(-p.height * c.v // most_v)) // 8)
                c.start = base + p.blocks
                p.blocks += c.columns * c.rows
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif marker == 0xDA:
            n = body[0]
            ids, tables = list(body[1 : 1 + 2 * n : 2]), body[2 : 2 + 2 * n : 2]
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            high, low = bits >> 4, bits & 15
            used = tuple(huffman.get(t >> 4) for t in tables) if not first and not high else (huffman[0x10 | tables[0] & 15],) if first else ()
            shape = tuple((p.components[c].h, p.components[c].v) for c in ids) if len(ids) > 1 else ()
            end = real[bisect_left(real, at)]
            scans[(first, last, high, low, used, shape)].append(_Scan(number, ids, used, interval, at, end))
            at = end
    raise ValueError("the file has no end")


@lru_cache(maxsize=4096)
def _layout(mcu_columns: int, mcu_rows: int, parts: tuple, interval: int) -> np.ndarray:
    """The blocks of each lane of a scan in a row each, counted from the picture's first, -1 after the last.

    ``parts`` has start, columns, rows, own columns, own rows, h and v of each component in the scan.
    """
    if len(parts) > 1:
        row, column = np.divmod(np.arange(mcu_columns * mcu_rows), mcu_columns)
        every = np.stack([start + (row * v + y) * columns + column * h + x for start, columns, _, _, _, h, v in parts for y in range(v) for x in range(h)], axis=1)
    else:
        start, columns, _, own_columns, own_rows, _, _ = parts[0]
        every = (start + np.arange(own_rows)[:, None] * columns + np.arange(own_columns)).reshape(-1, 1)
    n = interval or len(every)
    count = -(-len(every) // n)
    out = np.full((count * n, every.shape[1]), -1)
    out[: len(every)] = every
    return out.reshape(count, -1)


def _lanes(group: list[_Scan], pictures: list[Picture], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each lane, and the numbers of its blocks in a row each, -1 after the last."""
    layouts, bases = [], []
    for s in group:
        p = pictures[s.picture]
        c = [p.components[c] for c in s.components]
        layouts.append(_layout(p.mcu_columns, p.mcu_rows, tuple((x.start - p.base, x.columns, x.rows, x.own_columns, x.own_rows, x.h, x.v) for x in c), s.interval))
        bases.append(p.base)
    count = np.array([len(x) for x in layouts])
    start, end = np.array([s.start for s in group]), np.array([s.end for s in group])
    a = np.searchsorted(marks, start)
    if (np.searchsorted(marks, end) - a != count - 1).any():
        raise ValueError("restart markers are missing")
    lane = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(start, count)
    later = lane > 0
    starts[later] = marks[(np.repeat(a, count) + lane - 1)[later]] + 2
    wide = max(x.shape[1] for x in layouts)
    blocks = np.concatenate([x if x.shape[1] == wide else np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=-1) for x in layouts])
    there = blocks >= 0
    blocks += np.where(there, np.repeat(bases, count)[:, None], 0)
    return starts, blocks, there.sum(axis=1)


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number that ``size`` extra bits stand for."""
    return extra - np.where((extra << 1) >> size == 0, (1 << size) - 1, 0)


class _Bits:
    """Bytes without stuffing, as 64-bit windows and as single bits."""

    def __init__(self, data: np.ndarray):
        data = np.concatenate([data, np.full(24, 0xFF, np.uint8)])
        self.data = data
        self.windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8").ravel().astype(U)
        self._single = None

    @property
    def single(self) -> np.ndarray:
        if self._single is None:
            self._single = np.unpackbits(self.data)
        return self._single

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 or more bits from each place, at the top."""
        return self.windows[at >> 3] << (at & 7).astype(U)


def _dc_first_scan(bits: _Bits, at: np.ndarray, blocks: np.ndarray, count: np.ndarray, tables: tuple, shape: tuple, low: int, out: np.ndarray) -> None:
    owner = [c for c, (h, v) in enumerate(shape) for _ in range(h * v)] or [0]
    lut = [_lookup(*t) for t in tables]
    before = np.zeros((len(tables), len(at)), np.int64)
    for i in range(blocks.shape[1]):
        live = np.flatnonzero(count > i)
        c = owner[i % len(owner)]
        w = bits.peek(at[live])
        e = lut[c][(w >> U(48)).astype(np.int64)]
        n, s = e >> 8, e & 255
        extra = ((w << n.astype(U)) >> U(1) >> (63 - s).astype(U)).astype(np.int64)
        before[c, live] += _signed(extra, s)
        out[blocks[live, i], 0] = before[c, live] << low
        at[live] += n + s


def _dc_more_scan(bits: _Bits, at: np.ndarray, blocks: np.ndarray, low: int, out: np.ndarray) -> None:
    lane, i = np.nonzero(blocks >= 0)
    out[blocks[lane, i], 0] |= bits.single[at[lane] + i].astype(np.int64) << low


def _ac_first_scan(bits: _Bits, at: np.ndarray, blocks: np.ndarray, count: np.ndarray, table: tuple, first: int, last: int, low: int, out: np.ndarray) -> None:
    lut, flat = _lookup(*table), out.ravel()
    b, k = np.zeros(len(at), np.int64), np.full(len(at), first)
    row = np.arange(len(at))
    base = blocks[:, 0] << 6
    while len(at):
        w = bits.peek(at)
        e = lut[(w >> U(48)).astype(np.int64)]
        n = e >> 8
        s, r = e & 15, e >> 4 & 15
        blank = s == 0
        some = blank.any()
        extra = ((w << n.astype(U)) >> U(1) >> (63 - s).astype(U)).astype(np.int64)
        k += r
        value = _signed(extra, s) << low
        if some:
            if (n == 0).any():
                raise ValueError("a code that the table doesn't have")
            put = ~blank
            flat[(base + k)[put]] = value[put]
        else:
            flat[base + k] = value
        at = at + n + s
        k += 1
        over = k > last
        skip = over.astype(np.int64)
        if some:
            end = np.flatnonzero(blank & (r < 15))
            if len(end):
                more = r[end]
                run = (bits.peek(at[end]) >> U(1) >> (63 - more).astype(U)).astype(np.int64)
                at[end] += more
                skip[end] = (1 << more) + run
                over[end] = True
        if over.any():
            k[over] = first
            b += skip
            done = b >= count[row]
            if done.any():
                keep = ~done
                at, b, k, row = at[keep], b[keep], k[keep], row[keep]
            base = blocks[row, np.minimum(b, blocks.shape[1] - 1)] << 6


def _ac_more_scan(bits: _Bits, at: np.ndarray, blocks: np.ndarray, count: np.ndarray, table: tuple, first: int, last: int, low: int, out: np.ndarray) -> None:
    lut = _lookup(*table)
    b, k, run = np.zeros(len(at), np.int64), np.full(len(at), first), np.zeros(len(at), np.int64)
    row = np.arange(len(at))
    place = np.arange(first, last + 1)
    step = 1 << low
    while len(at):
        block = blocks[row, b]
        now = out[block, first : last + 1]
        read = run == 0
        new = np.zeros(len(at), np.int64)
        skip = np.full(len(at), 99)  # coefficients without history that are passed by
        if read.any():
            i = np.flatnonzero(read)
            w = bits.peek(at[i])
            e = lut[(w >> U(48)).astype(np.int64)]
            n, s, r = e >> 8, e & 15, e >> 4 & 15
            if (n == 0).any():
                raise ValueError("a code that the table doesn't have")
            extra = np.where(s > 0, s, np.where(r < 15, r, 0))
            value = ((w << n.astype(U)) >> U(1) >> (63 - extra).astype(U)).astype(np.int64)
            at[i] += n + extra
            new[i] = np.where(s > 0, np.where(value > 0, step, -step), 0)
            run[i] = np.where((s == 0) & (r < 15), (1 << np.minimum(r, 14)) + value, 0)
            skip[i] = np.where((s > 0) | (r == 15), r, 99)
        if (skip == 99).all() and (k == first).all() and now.all():  # every coefficient has one more bit
            up = bits.single[at[:, None] + (place - first)]
            now += np.where(up, np.where(now > 0, step, -step), 0).astype(np.int32)
            out[block, first : last + 1] = now
            at += last - first + 1
            run = np.maximum(run - 1, 0)
            b = b + 1
            done = b >= count[row]
            if done.any():
                keep = ~done
                at, b, k, run, row = at[keep], b[keep], k[keep], run[keep], row[keep]
            continue
        ahead = place >= k[:, None]
        plain = (now == 0) & ahead
        if (skip < 99).any():
            passed = np.cumsum(plain, axis=1)
            stop = (plain & (passed == skip[:, None] + 1)).argmax(axis=1)
            stop = np.where((passed[:, -1] > skip), stop, last - first + 1)
            old = ~plain & ahead & (np.arange(last - first + 1) < stop[:, None])
        else:
            stop = np.full(len(at), last - first + 1)
            old = ~plain & ahead
        rank = np.cumsum(old, axis=1)
        i, j = np.nonzero(old)
        up = bits.single[at[i] + rank[i, j] - 1]
        change = now[i, j]
        now[i, j] = change + np.where(up, np.where(change > 0, step, -step), 0)
        at += rank[:, -1]
        put = np.flatnonzero((new != 0) & (stop <= last - first))
        now[put, stop[put]] = new[put]
        out[block, first : last + 1] = now
        k = first + stop + 1
        over = (k > last) | (run > 0)
        run = np.maximum(run - 1, 0)
        k[over] = first
        b = b + over
        done = b >= count[row]
        if done.any():
            keep = ~done
            at, b, k, run, row = at[keep], b[keep], k[keep], run[keep], row[keep]


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[list[Picture], np.ndarray]:
    """Parses files that stand one after another and decodes all their scans.

    Returns the pictures and one array with a row of 64 quantized coefficients, in zigzag order, for
    each block of all of them.
    """
    buf = data.tobytes()
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    restart = (after >= 0xD0) & (after <= 0xD7)
    marks, real = ff[restart], ff[(after != 0) & (after != 0xFF) & ~restart]
    stuffed = ff[after == 0] + 1
    pictures, scans, total, real = [], defaultdict(list), 0, real.tolist()
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        pictures.append(_parse(buf, lo, hi, real, i, total, scans))
        total += pictures[-1].blocks
    out = np.zeros((total, 64), np.int32)
    bits = _Bits(np.delete(data, stuffed))
    # a bit position is refined only after the one above it, so from high to low all scans can run together
    for key in sorted(scans, key=lambda x: (-x[3], x[0], x[1], x[2])):
        first, last, high, low, tables, shape = key
        at, blocks, count = _lanes(scans[key], pictures, marks)
        at = (at - np.searchsorted(stuffed, at)) * 8
        if not first:
            if high:
                _dc_more_scan(bits, at, blocks, low, out)
            else:
                _dc_first_scan(bits, at, blocks, count, tables, shape, low, out)
        elif high:
            _ac_more_scan(bits, at, blocks, count, tables[0], first, last, low, out)
        else:
            _ac_first_scan(bits, at, blocks, count, tables[0], first, last, low, out)
    return pictures, out


def pixels(pictures: list[Picture], coefficients: np.ndarray) -> np.ndarray:
    """The 8 x 8 samples of every block, 0 to 255, by dequantization and the inverse transform."""
    scale = np.ones((len(coefficients), 1), np.int64)
    tables = {q.tobytes() for p in pictures for q in p.quant.values()}
    if len(tables) == 1:
        scale = np.frombuffer(next(iter(tables)), np.int64)[None, :]
    else:
        scale = np.concatenate([np.broadcast_to(p.quant[c.quant], (c.columns * c.rows, 64)) for p in pictures for c in p.components.values()])
    x = (coefficients * scale).astype(np.float64) @ _BASIS
    # the small shift makes halves round alike in any order of summation
    return np.clip(np.floor(x + (128.5 + 1e-6)), 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def planar(p: Picture, samples: np.ndarray) -> np.ndarray:
    """Red, green and blue planes of a picture (or its own components if they aren't three): chroma is upsampled to full resolution."""
    most_h, most_v = max(c.h for c in p.components.values()), max(c.v for c in p.components.values())
    planes = []
    for c in p.components.values():
        x = samples[c.start : c.start + c.columns * c.rows].reshape(c.rows, c.columns, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.columns * 8)
        if most_v // c.v > 1:
            x = np.repeat(x, most_v // c.v, axis=0)
        if most_h // c.h > 1:
            x = np.repeat(x, most_h // c.h, axis=1)
        planes.append(x[: p.height, : p.width])
    if len(planes) != 3:
        return np.stack(planes)
    y, b, r = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((3, p.height, p.width), np.uint8)
    for i, x in enumerate((y + ((91881 * r + 32768) >> 16), y - ((22554 * b + 46802 * r + 32768) >> 16), y + ((116130 * b + 32768) >> 16))):
        out[i] = np.minimum(np.maximum(x, 0), 255)
    return out


def tensor(p: Picture, samples: np.ndarray) -> np.ndarray:
    """The full-resolution height x width x channels tensor of a picture."""
    return np.ascontiguousarray(planar(p, samples).transpose(1, 2, 0))


def payload(p: Picture, coefficients: np.ndarray) -> tuple[bytes, int]:
    """The payload that ``encode_payload`` stored, and how many of its bytes come before the padding."""
    _, size, _, stated = next(c for c in p.comments if c.startswith(b"payload ")).split()
    y, b, r = p.components.values()
    rows, columns = p.mcu_rows, p.mcu_columns
    part = lambda c: coefficients[c.start : c.start + c.columns * c.rows]
    mcu = np.empty((rows * columns, 6, 64), np.int32)
    mcu[:, :4] = part(y).reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    mcu[:, 4], mcu[:, 5] = part(b), part(r)
    mcu[mcu < 0] += 255
    return mcu.astype(np.uint8).tobytes()[: int(size)], int(stated)


# ---------------------------------------------------------------- columns


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        for a, b in tx.groups(offsets, BYTES_AT_ONCE):
            out = []
            for lo, hi in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True):
                size = max(UNIT, -(-(hi - lo) // UNIT) * UNIT)
                out.append(encode_payload(data[lo:hi].tobytes().ljust(size, b" "), hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(out, pa.binary())], ["doc_id", "media"])


def _decoded(column: pa.Array) -> Iterator[tuple[int, int, list[Picture], np.ndarray, np.ndarray]]:
    data, offsets = tx.utf8(column)
    for a, b in tx.groups(offsets, BYTES_AT_ONCE):
        pictures, coefficients = decode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, pictures, coefficients, pixels(pictures, coefficients)


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, pictures, _, samples in _decoded(batch.column("media")):
            made = [tensor(p, samples) for p in pictures]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], *(pa.array([x.shape[i] for x in made], pa.int32()) for i in range(3)), pa.array([x.tobytes() for x in made], pa.binary())],
                ["doc_id", "height", "width", "channels", "pixels"],
            )


def feature(planes: np.ndarray) -> str:
    """A description of a picture: its size and, by channel, mean and mean difference of neighbours."""
    _, h, w = planes.shape
    mean = planes.reshape(len(planes), -1).sum(axis=1, dtype=np.int64) / (h * w)
    step = np.abs(np.diff(planes.astype(np.int16), axis=2)).reshape(len(planes), -1).sum(axis=1, dtype=np.int64) / (h * max(w - 1, 1))
    return f"{w}x{h} " + " ".join(f"{c}{m:.3f}/{s:.3f}" for c, m, s in zip("rgb", mean.tolist(), step.tolist(), strict=False))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column("media")
        for a, b, pictures, coefficients, samples in _decoded(media):
            rows = []
            for p, file in zip(pictures, media[a:b].to_pylist(), strict=True):
                stored, stated = payload(p, coefficients)
                rows.append((stated, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(planar(p, samples))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: the whole UTF-8 text, padded with blanks to a positive multiple of 192 bytes, as a JPEG file."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_store, "doc_id bigint, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width, channels and pixels (bytes in that order) of a column of progressive JPEG files."""
    return media.select("doc_id", "media").mapInArrow(_load, "doc_id bigint, height int, width int, channels int, pixels binary")


def described(media: DataFrame) -> DataFrame:
    """What the stored files hold: sizes, digests of payload and file, and features of the decoded tensor."""
    return media.select("doc_id", "media").mapInArrow(_described, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a JPEG file in a column of a written table and reads the files back from there.

    The files are deleted when they are described; ``stored_media`` and ``tensors`` give columns to keep.

    Defined results: a null or empty text is 192 blanks with n_bytes 0; equal texts have equal files and
    features, so repeated rows and ties do; repeated rows have a row each; a null doc_id is kept; a text of
    any length up to a picture's limit of 65535 rows of 16 x 65535 samples is stored whole, in one file; an
    empty table gives no rows; other columns, whatever their names, are left out.
    """
    with scratch() as keep:
        stored = materialize(stored_media(docs), "media", "zstd")
        return keep(materialize(described(stored), "digests"))
