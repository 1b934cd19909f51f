"""The decoder against streams of a plain scalar encoder, and payloads against themselves."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import media
from brindle.llm import text as tx


class Encoder:
    """Progressive scans of any coefficients, a bit at a time. Each symbol has a code of eight bits."""

    def __init__(self, width, height, sampling, interval, rng):
        self.sampling, self.interval = sampling, interval
        self.h, self.v = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.columns, self.rows = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        self.own = [(-(-(-(-width * h // self.h)) // 8), -(-(-(-height * v // self.v)) // 8)) for h, v in sampling]
        self.planes = []
        for h, v in sampling:
            n = self.columns * h * self.rows * v
            x = np.where(rng.random((n, 64)) < rng.choice([0.05, 0.3, 0.9]), rng.integers(-300, 300, (n, 64)), 0)
            x[:: 3, 20:] = 0
            x[:, 0] = rng.integers(-900, 900, n)
            self.planes.append(x)
        self.out = [b"\xff\xd8", media._segment(0xFE, b"a comment \xff\x01 with a marker"), media._QUANT]
        self.out.append(media._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))))
        for kind in (0, 1):
            symbols = list(range(12)) if not kind else [r << 4 | s for r in range(16) for s in range(15)]
            self.out.append(media._huffman(kind, 0, {8: symbols}))
            setattr(self, f"code{kind}", {s: i for i, s in enumerate(symbols)})
        self.out.append(media._segment(0xDD, struct.pack(">H", interval)))

    def bits(self, value, n):
        self.acc += f"{value:0{n}b}" if n else ""

    def number(self, v, n):
        self.bits(v if v > 0 else v + (1 << n) - 1, n)

    def scan(self, parts, first, last, high, low, units):
        """``units(lane)`` writes one lane."""
        self.out.append(media._segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([first, last, high << 4 | low])))
        if len(parts) > 1:
            order = []
            for m in range(self.columns * self.rows):
                r, c = divmod(m, self.columns)
                unit = []
                for p in parts:
                    h, v = self.sampling[p]
                    unit += [(p, (r * v + y) * self.columns * h + c * h + x) for y in range(v) for x in range(h)]
                order.append(unit)
        else:
            p = parts[0]
            w, t = self.own[p]
            order = [[(p, r * self.columns * self.sampling[p][0] + c)] for r in range(t) for c in range(w)]
        n = self.interval or len(order)
        for i in range(0, len(order), n):
            self.acc = ""
            units([b for unit in order[i : i + n] for b in unit])
            self.acc += "1" * (-len(self.acc) % 8)
            data = bytes(int(self.acc[j : j + 8], 2) for j in range(0, len(self.acc), 8))
            self.out.append(data.replace(b"\xff", b"\xff\0"))
            if i + n < len(order):
                self.out.append(bytes([0xFF, 0xD0 + i // n % 8]))

    def dc_first(self, parts, low):
        def lane(blocks):
            before = {}
            for p, b in blocks:
                v = int(self.planes[p][b, 0]) >> low
                d = v - before.get(p, 0)
                before[p] = v
                n = abs(d).bit_length()
                self.bits(self.code0[n], 8)
                self.number(d, n)

        self.scan(parts, 0, 0, 0, low, lane)

    def dc_more(self, parts, low):
        self.scan(parts, 0, 0, low + 1, low, lambda blocks: [self.bits(int(self.planes[p][b, 0]) >> low & 1, 1) for p, b in blocks])

    def run(self):
        if self.eob:
            n = self.eob.bit_length() - 1
            self.bits(self.code1[n << 4], 8)
            self.bits(self.eob - (1 << n), n)
            self.eob = 0
            self.acc += self.late
            self.late = ""

    def ac_first(self, p, first, last, low):
        def lane(blocks):
            self.eob, self.late = 0, ""
            for _, b in blocks:
                r = 0
                for k in range(first, last + 1):
                    c = int(self.planes[p][b, k])
                    v = (abs(c) >> low) * (1 if c > 0 else -1)
                    if not v:
                        r += 1
                        continue
                    self.run()
                    while r > 15:
                        self.bits(self.code1[0xF0], 8)
                        r -= 16
                    n = abs(v).bit_length()
                    self.bits(self.code1[r << 4 | n], 8)
                    self.number(v, n)
                    r = 0
                self.eob += r > 0
            self.run()

        self.scan([p], first, last, 0, low, lane)

    def ac_more(self, p, first, last, low):
        def lane(blocks):
            self.eob, self.late = 0, ""
            for _, b in blocks:
                a = [abs(int(x)) >> low for x in self.planes[p][b]]
                end = max((k for k in range(first, last + 1) if a[k] == 1), default=-1)
                r, own = 0, ""
                for k in range(first, last + 1):
                    if not a[k]:
                        r += 1
                        continue
                    while r > 15 and k <= end:
                        self.run()
                        self.bits(self.code1[0xF0], 8)
                        r -= 16
                        self.acc, own = self.acc + own, ""
                    if a[k] > 1:
                        own += str(a[k] & 1)
                        continue
                    self.run()
                    self.bits(self.code1[r << 4 | 1], 8)
                    self.bits(int(self.planes[p][b, k] > 0), 1)
                    self.acc, own, r = self.acc + own, "", 0
                if r or own:
                    self.eob += 1
                    self.late += own
            self.run()

        self.scan([p], first, last, low + 1, low, lane)

    def file(self):
        every = list(range(len(self.sampling)))
        self.dc_first(every, 1)
        for p in every:
            self.ac_first(p, 1, 5, 2)
            self.ac_first(p, 6, 63, 2)
        for p in every:
            self.ac_more(p, 1, 63, 1)
        self.dc_more(every, 0)
        for p in reversed(every):
            self.ac_more(p, 1, 63, 0)
        return b"".join(self.out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_scans_of_any_coefficients(interval):
    rng = np.random.default_rng(interval)
    made = [Encoder(w, h, s, interval, rng) for w, h in ((8, 8), (17, 33), (50, 20)) for s in ([(2, 2), (1, 1), (1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(1, 1)])]
    files = [e.file() for e in made]
    pictures, got = media.decode(*tx.utf8(pa.array(files, pa.binary())))
    for e, p in zip(made, pictures, strict=True):
        for plane, c, (w, t), (h, _) in zip(e.planes, p.components.values(), e.own, e.sampling, strict=True):
            there = np.zeros((c.rows, c.columns), bool)
            there[:t, :w] = True
            mine = got[c.start : c.start + c.columns * c.rows]
            assert (mine[:, 0] == plane[:, 0]).all() or len(e.sampling) == 1
            assert (mine[there.ravel()] == plane[there.ravel()]).all()
    samples = media.pixels(pictures, got)
    for e, p in zip(made, pictures, strict=True):
        x = media.tensor(p, samples)
        assert x.shape == (p.height, p.width, len(e.sampling))


def test_inverse_transform_and_colour():
    rng = np.random.default_rng(5)
    q = rng.integers(-60, 60, (4, 64))
    p = media.Picture(16, 16, 1, 1, {1: media.Component(2, 2, 0, 2, 2, 2, 2, 0)}, {0: np.full(64, 2)})
    got = media.pixels([p], q)
    for b in range(4):
        f = np.zeros(64)
        f[media.ZIGZAG] = q[b] * 2
        f = f.reshape(8, 8)
        for y in range(8):
            for x in range(8):
                c = lambda k: 2**-0.5 if k == 0 else 1.0
                s = sum(c(u) * c(v) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
                assert abs(got[b, y, x] - np.clip(s + 128, 0, 255)) <= 0.51
    one = media.Picture(16, 16, 1, 1, {1: media.Component(2, 2, 0, 2, 2, 2, 2, 0), 2: media.Component(1, 1, 0, 1, 1, 1, 1, 4), 3: media.Component(1, 1, 0, 1, 1, 1, 1, 5)})
    samples = np.zeros((6, 8, 8), np.uint8)
    samples[:4], samples[4], samples[5] = 100, 90, np.arange(64).reshape(8, 8) * 4
    x = media.tensor(one, samples).astype(int)
    cr = np.repeat(np.repeat(samples[5].astype(int), 2, 0), 2, 1) - 128
    assert np.abs(x[:, :, 0] - np.clip(100 + 1.402 * cr, 0, 255)).max() <= 1 and np.abs(x[:, :, 2] - np.clip(100 + 1.772 * (90 - 128), 0, 255)).max() <= 1


def test_payloads_come_back():
    rng = np.random.default_rng(6)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (*range(1, 20), 97, 500)] + [b"\xff" * 1920, b"\0" * 1920]
    files = [media.encode_payload(p, len(p) - 1) for p in payloads]
    pictures, got = media.decode(*tx.utf8(pa.array(files, pa.binary())))
    assert [media.payload(p, got) for p in pictures] == [(p, len(p) - 1) for p in payloads]


def test_broken_files():
    good = media.encode_payload(b"x" * 192, 0)
    for bad in (b"", b"GIF", good[:40], good[:-2], good.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError)):
            media.decode(*tx.utf8(pa.array([bad], pa.binary())))


def test_columns(spark):
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é" * 96), (4, "x" * 192), (5, "y" * 193), (6, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(9000)))]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, media string")
    got = media.media_digests(df).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want[d, len(raw)] = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    for r in got:
        assert want[r["doc_id"], r["n_bytes"]] == (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
    files = {r["doc_id"]: bytes(r["media"]) for r in media.stored_media(df).collect()}
    assert all(len(files[r["doc_id"]]) == r["media_bytes"] and hashlib.sha256(files[r["doc_id"]]).hexdigest() == r["media_sha256"] for r in got)
    pictures = media.tensors(media.stored_media(df)).collect()
    assert all(len(r["pixels"]) == r["height"] * r["width"] * r["channels"] for r in pictures)
    assert media.media_digests(df.limit(0)).collect() == []
