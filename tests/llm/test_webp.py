"""The lossless decoder on streams that use every part of the format, written by a small encoder here."""

import base64
import random

import numpy as np
import pytest

from codelode.llm import webp
from codelode.llm.media import padded


class Writer(webp.BitWriter):
    """Writes images symbol by symbol with flat codes."""

    def flat(self, size, used):
        """A code of equal lengths over 2^k symbols that include ``used``."""
        used = sorted(used)
        if len(used) == 1 and used[0] < 256:
            self.one_symbol(used[0])
            return {used[0]: (0, 0)}
        k = max(1, (len(used) - 1).bit_length())
        filler = [s for s in range(size) if s not in set(used)]
        chosen = sorted(used + filler[: (1 << k) - len(used)])
        lengths = bytearray(size)
        for s in chosen:
            lengths[s] = k
        # plain lengths: a code of one bit for 0 and k
        of = bytearray(19)
        of[0] = of[k] = 1
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(of[s], 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(n != 0), 1)
        return {s: (int(f"{i:0{k}b}"[::-1], 2), k) for i, s in enumerate(chosen)}

    @staticmethod
    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        high = v.bit_length() - 1
        second = (v >> (high - 1)) & 1
        return 2 * high + second, high - 1, v & ((1 << (high - 1)) - 1)

    def image(self, ops, top, cache_bits=0, groups=None):
        """ops: ('px', argb), ('copy', length, distance code) or ('hit', index); groups: (tile bits, meta argb list, group of op)."""
        self.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if top:
            self.put(int(groups is not None), 1)
            if groups:
                self.put(groups[0] - 2, 3)
                self.image([("px", v) for v in groups[1]], False)
        n = 1 + max(groups[2]) if groups else 1
        of = groups[2] if groups else [0] * len(ops)
        codes = []
        for g in range(n):
            own = [o for o, k in zip(ops, of, strict=True) if k == g]
            px = [o[1] for o in own if o[0] == "px"]
            green = {v >> 8 & 255 for v in px} | {256 + self.prefix(o[1])[0] for o in own if o[0] == "copy"} | {280 + o[1] for o in own if o[0] == "hit"}
            sets = [green or {0}, {v >> 16 & 255 for v in px} or {0}, {v & 255 for v in px} or {0}, {v >> 24 for v in px} or {0}, {self.prefix(o[2])[0] for o in own if o[0] == "copy"} or {0}]
            sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
            codes.append([self.flat(s, u) for s, u in zip(sizes, sets, strict=True)])
        for o, g in zip(ops, of, strict=True):
            c = codes[g]
            if o[0] == "px":
                for code, s in zip(c, (o[1] >> 8 & 255, o[1] >> 16 & 255, o[1] & 255, o[1] >> 24), strict=False):
                    self.put(*code[s])
            elif o[0] == "copy":
                for code, add, v in ((c[0], 256, o[1]), (c[4], 0, o[2])):
                    p, extra, rest = self.prefix(v)
                    self.put(*code[p + add])
                    self.put(rest, extra)
            else:
                self.put(*c[0][280 + o[1]])

    def start(self, width, height):
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(0, 4)

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def argb(image):
    return (image.astype(np.uint32) * (np.uint32(1), np.uint32(1 << 8), np.uint32(1 << 16), np.uint32(1 << 24))).sum(axis=2).astype(np.uint32).ravel().tolist()


def test_store_and_load_any_bytes():
    rng = random.Random(5)
    for n in (0, 1, 191, 192, 193, 5000, 400_000):
        data = padded(bytes(rng.randrange(256) for _ in range(n)))
        assert webp.load(webp.store(data)) == data
    assert padded(b"") == b" " * 192


def test_back_references_and_cache():
    px = [0xFF102030, 0xFF405060, 0xFF708090, 0xFF0A0B0C]
    slot = lambda v: (webp.CACHE_FACTOR * v & 0xFFFFFFFF) >> 28
    ops = [("px", v) for v in px] + [("hit", slot(px[1])), ("copy", 5, 120 + 2), ("copy", 6, 1)]
    want = px + [px[1]]
    for n, d in ((5, 2), (6, 8)):
        for _ in range(n):
            want.append(want[-d])
    w = Writer()
    w.start(8, 2)
    w.put(0, 1)
    w.image(ops, True, cache_bits=4)
    assert argb(webp.decode_stream(w.data())) == want


def test_literals_between_back_references_without_cache():
    rng = random.Random(2)
    ops, want = [], []
    while len(want) < 64:
        if want and rng.random() < 0.3:
            n, d = min(64 - len(want), rng.randint(1, 9)), rng.randint(1, len(want))
            ops.append(("copy", n, 120 + d))
            for _ in range(n):
                want.append(want[-d])
        else:
            want.append(0xFF000000 | rng.randrange(1 << 24))
            ops.append(("px", want[-1]))
    w = Writer()
    w.start(16, 4)
    w.put(0, 1)
    w.image(ops, True)
    assert argb(webp.decode_stream(w.data())) == want


def test_code_groups():
    px = [0xFF000000 | i * 3 << 16 | i * 5 << 8 | i for i in range(32)]
    w = Writer()
    w.start(8, 4)
    w.put(0, 1)
    w.image([("px", v) for v in px], True, groups=(2, [0, 1 << 8], [int(i % 8 >= 4) for i in range(32)]))
    assert argb(webp.decode_stream(w.data())) == px


def test_subtract_green_and_palette():
    rng = random.Random(1)
    want = [0xFF000000 | rng.randrange(1 << 24) for _ in range(20)]
    less = [v & 0xFF00FF00 | ((v >> 16) - (v >> 8) & 255) << 16 | (v - (v >> 8) & 255) for v in want]
    w = Writer()
    w.start(5, 4)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    w.image([("px", v) for v in less], True)
    assert argb(webp.decode_stream(w.data())) == want
    for n, pack in ((2, 3), (4, 2), (7, 1), (20, 0)):
        table = [0xFF000000 | rng.randrange(1 << 24) for _ in range(n)]
        deltas = [table[0]] + [sum((((b >> s & 255) - (a >> s & 255)) & 255) << s for s in (0, 8, 16, 24)) for a, b in zip(table, table[1:], strict=False)]
        index = [rng.randrange(n) for _ in range(33)]
        w = Writer()
        w.start(11, 3)
        w.put(1, 1)
        w.put(3, 2)
        w.put(n - 1, 8)
        w.image([("px", v) for v in deltas], False)
        w.put(0, 1)
        depth, packed = 8 >> pack, []
        for y in range(3):
            row = index[11 * y : 11 * y + 11]
            for x in range(0, 11, 1 << pack):
                packed.append(("px", 0xFF000000 | sum(v << (depth * k) for k, v in enumerate(row[x : x + (1 << pack)])) << 8))
        w.image(packed, True)
        assert argb(webp.decode_stream(w.data())) == [table[i] for i in index]


def test_predictors_and_cross_colour():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (8, 8, 4), dtype=np.uint8)
    half = lambda a, b: (a.astype(int) + b) // 2
    clamp = lambda v: np.clip(v, 0, 255)
    for mode in range(14):
        rest = image.astype(int).copy()
        for y in range(8):
            for x in range(8):
                left, up = image[y, x - 1].astype(int) if x else None, image[y - 1, x].astype(int) if y else None
                if y == 0:
                    p = np.array((0, 0, 0, 255)) if x == 0 else left
                elif x == 0:
                    p = up
                else:
                    ul, ur = image[y - 1, x - 1].astype(int), (image[y - 1, x + 1] if x < 7 else image[y, 0]).astype(int)
                    full = left + up - ul
                    p = [np.array((0, 0, 0, 255)), left, up, ur, ul, half(half(left, ur), up), half(left, ul), half(left, up), half(ul, up), half(up, ur), half(half(left, ul), half(up, ur)),
                         left if abs(full - left).sum() < abs(full - up).sum() else up, clamp(full), clamp(half(left, up) + np.trunc((half(left, up) - ul) / 2).astype(int))][mode]
                rest[y, x] = (rest[y, x] - p) & 255
        w = Writer()
        w.start(8, 8)
        w.put(1, 1)
        w.put(0, 2)
        w.put(1, 3)
        w.image([("px", 0xFF000000 | mode << 8)], False)
        w.put(0, 1)
        w.image([("px", v) for v in argb(rest)], True)
        assert (webp.decode_stream(w.data()) == image).all(), mode
    g2r, g2b, r2b = -30, 77, 5
    signed = image.view(np.int8).astype(int)
    less = image.astype(int).copy()
    less[:, :, 2] = (less[:, :, 2] - (g2r * signed[:, :, 1] >> 5)) & 255
    less[:, :, 0] = (less[:, :, 0] - (g2b * signed[:, :, 1] >> 5) - (r2b * signed[:, :, 2] >> 5)) & 255
    w = Writer()
    w.start(8, 8)
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 3)
    w.image([("px", 0xFF000000 | (r2b & 255) << 16 | (g2b & 255) << 8 | g2r & 255)], False)
    w.put(0, 1)
    w.image([("px", v) for v in argb(less)], True)
    assert (webp.decode_stream(w.data()) == image).all()


def test_broken_streams():
    good = webp.store(b"x" * 192)
    for bad in (good[:30], b"RIFF" + bytes(20), good[:20] + b"\x00" + good[21:]):
        with pytest.raises(ValueError):
            webp.load(bad)


def test_stream_of_another_encoder():
    """The lossless feature-detection image that web pages carry: one transparent pixel."""
    image = webp.decode_stream(next(webp.chunks(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))))
    assert image.tolist() == [[[0, 0, 0, 0]]]


def form(payload):
    bits = webp.Bits(next(webp.chunks(webp.store(payload))))
    bits.at = 8 + 28 + 4
    return ("palette" if bits.read(2) == 3 else "other") if bits.read(1) else "cache" if bits.read(1) else "literals"


def test_store_chooses_by_the_data():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = padded(" ".join(rng.choices(vocabulary, k=4000)).encode())
    few = padded(b"".join(rng.choice((b"\x00\xfe\x01", b"\xf0\xf1\xf2", b"\x80\x90\xa0")) for _ in range(900)))
    noise = padded(rng.randbytes(3000))
    line = rng.randbytes(333)
    again = padded(rng.randbytes(300) + line + rng.randbytes(600) + line + line)
    assert [form(x) for x in (prose, few, noise)] == ["cache", "palette", "literals"]
    for x in (prose, few, noise, again, b" " * 19_200, b"ab" * 96_000, line * 576):
        assert webp.load(webp.store(x)) == x
    px = np.frombuffer(again, np.uint8).reshape(-1, 3)
    found = webp.repeats(px[:, 0].astype(np.uint32) << 16 | px[:, 1].astype(np.uint32) << 8 | px[:, 2])
    assert [(n, back) for _, n, back in found] == [(111, 311), (111, 111)] or sum(n for _, n, _ in found) >= 222
    assert len(webp.store(b" " * 192 * 1024)) < 300 and len(webp.store(line * 576)) < 3000


def test_repeats_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        v = rng.integers(0, 3, 400, dtype=np.uint32)
        v[200:300] = v[37:137]
        v[330:] = v[329]
        done = 0
        for at, n, back in webp.repeats(v):
            assert at >= done and n >= webp.LEAST and all(v[i] == v[i - back] for i in range(at, at + n)) and (at + n == len(v) or v[at + n] != v[at + n - back])
            done = at + n
        assert any(n >= 60 for _, n, _ in webp.repeats(v))


def test_cache_across_back_references():
    """Copied pixels enter the cache as well, and slots never written to give transparent black."""
    rng = random.Random(11)
    for bits in (1, 3, 6):
        ops, want, held = [("hit", 1)], [0], {}
        held[0] = 0
        while len(want) < 300:
            kind = rng.random()
            if kind < 0.15 and len(want) > 4:
                n, d = min(300 - len(want), rng.randint(1, 20)), rng.randint(1, len(want))
                ops.append(("copy", n, 120 + d))
                own = []
                for _ in range(n):
                    want.append(want[-d])
                    own.append(want[-1])
            elif kind < 0.6 and held:
                own = [rng.choice(list(held.values()))]
                own = [held[webp._slot(own[0], bits)]]
                ops.append(("hit", webp._slot(own[0], bits)))
                want += own
            else:
                own = [0xFF000000 | rng.randrange(40) * 0x010305]
                ops.append(("px", own[0]))
                want += own
            for v in own:
                held[webp._slot(v, bits)] = v
        w = Writer()
        w.start(20, 15)
        w.put(0, 1)
        w.image(ops, True, cache_bits=bits)
        assert argb(webp.decode_stream(w.data())) == want


def test_predictor_rows_of_several_modes():
    """Tiles of different modes side by side: array-wise rows and pixel-wise ones agree with the rules."""
    rng = np.random.default_rng(9)
    for allowed in ((0, 2, 3, 4, 8, 9), tuple(range(14)), (1,), (2,), (3,)):
        residual = rng.integers(0, 256, (13, 11, 4), dtype=np.uint8)
        modes = rng.choice(allowed, (4, 3)).astype(np.uint8)
        got = residual.copy()
        webp._undo_predictor(got, modes, 2)
        half = lambda a, b: (a + b) // 2
        want = np.zeros((13, 11, 4), int)
        for y in range(13):
            for x in range(11):
                if y == 0:
                    p = want[0, x - 1] if x else np.array((0, 0, 0, 255))
                elif x == 0:
                    p = want[y - 1, 0]
                else:
                    le, up, ul, ur = want[y, x - 1], want[y - 1, x], want[y - 1, x - 1], want[y - 1, x + 1] if x < 10 else want[y, 0]
                    full, mean = le + up - ul, half(le, up)
                    p = (np.array((0, 0, 0, 255)), le, up, ur, ul, half(half(le, ur), up), half(le, ul), mean, half(ul, up), half(up, ur), half(half(le, ul), half(up, ur)),
                         le if abs(full - le).sum() < abs(full - up).sum() else up, np.clip(full, 0, 255), np.clip(mean + np.trunc((mean - ul) / 2).astype(int), 0, 255))[modes[y >> 2, x >> 2]]
                want[y, x] = (residual[y, x] + p) & 255
        assert (got == want).all(), allowed
