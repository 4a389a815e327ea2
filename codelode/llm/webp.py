"""Lossless WebP: a full decoder to pixel arrays, and an encoder that stores bytes as pixels.

The decoder reads prefix codes, back-references and the colour cache and inverts the
predictor, cross-colour, subtract-green and palette transforms. Literal and cached pixels are
decoded by array arithmetic: a table gives, for every bit of the stream, where the pixel that
starts there ends; following it yields the pixels, and a sort by cache slot gives each cached
pixel the last colour written there. Images with several code groups go symbol by symbol.

Bytes are stored three to a pixel, 64 pixels to a row, in images of at most ``ROWS`` rows, one
after the other. Repeats of ``LEAST`` pixels or more become back-references; what is left is
written as literals, with a colour cache, or as indices into a palette, whichever takes fewest
bits. The prefix codes are fixed ones made for text. Any bytes can be stored.
"""

from __future__ import annotations

import heapq
import struct
from functools import cache, lru_cache

import numpy as np

WIDTH, ROWS = 64, 1024
#: Bits of the colour cache that ``store`` uses, and pixels of its shortest back-reference.
CACHE_BITS, LEAST = 9, 16
ROW_BYTES = 3 * WIDTH

# Fixed values of the format: order of the code length codes, and the near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Bits from the lowest of each byte on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        b = self.at >> 3
        return (int.from_bytes(self.data[b : b + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        out = self.peek(n)
        self.at += n
        return out

    def span(self, at: int, n: int) -> int:
        """Any number of bits from ``at`` on as one integer; -1 where the stream is too short."""
        if at + n > 8 * len(self.data):
            return -1
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


class Code:
    """A prefix code: symbol and length by the next ``most`` bits."""

    def __init__(self, lengths: bytes):
        n = np.frombuffer(lengths, np.uint8)
        used = np.flatnonzero(n)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.most, self.symbols, self.lengths = 0, np.array([used[0]], np.int32), np.zeros(1, np.int32)
        else:
            self.most = int(n.max())
            self.symbols, self.lengths = np.zeros(1 << self.most, np.int32), np.zeros(1 << self.most, np.int32)
            code = last = 0
            for s in sorted(used.tolist(), key=lambda s: (n[s], s)):
                size = int(n[s])
                code <<= size - last
                last = size
                if code >> size:
                    raise ValueError("too many codes")
                turned = int(f"{code:0{size}b}"[::-1], 2)
                self.symbols[turned :: 1 << size], self.lengths[turned :: 1 << size] = s, size
                code += 1
            if code != 1 << last:
                raise ValueError("an incomplete prefix code")
        self.s, self.n, self.top = self.symbols.tolist(), self.lengths.tolist(), int(used[-1])

    def read(self, bits: Bits) -> int:
        w = bits.peek(self.most)
        bits.at += self.n[w]
        return self.s[w]


@lru_cache(64)
def code_of(lengths: bytes) -> Code:
    return Code(lengths)


@lru_cache(16)
def _header_code(lengths: bytes) -> Code:
    return Code(lengths)


def read_code(bits: Bits, size: int) -> Code:
    lengths = bytearray(size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return code_of(bytes(lengths))
    of = bytearray(19)
    for k in range(4 + bits.read(4)):
        of[LENGTH_ORDER[k]] = bits.read(3)
    code = _header_code(bytes(of))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n, value = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > size:
                raise ValueError("code lengths overrun")
            lengths[at : at + n] = bytes([value]) * n
            at += n
    return code_of(bytes(lengths))


#: Groups of codes read last: their sizes, bits as one integer, and the codes.
_read: list[tuple[tuple, int, int, list[Code]]] = []


def read_codes(bits: Bits, sizes: tuple) -> list[Code]:
    """A group of codes; one that was read lately is known by its bits."""
    for k, (own, n, value, codes) in enumerate(_read):
        if own == sizes and bits.span(bits.at, n) == value:
            bits.at += n
            if k:
                _read.insert(0, _read.pop(k))
            return codes
    start = bits.at
    codes = [read_code(bits, n) for n in sizes]
    _read.insert(0, (sizes, bits.at - start, bits.span(start, bits.at - start), codes))
    del _read[32:]
    return codes


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _slot(argb, cache_bits: int):
    """The cache slot of colours (an int, or an array of 32-bit ones)."""
    if isinstance(argb, int):
        return (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - cache_bits)
    return ((argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)


class _Run:
    """Pixels that aren't back-references, in pieces of the stream that are worked through at once."""

    PIECE = 1 << 17

    def __init__(self, bits: Bits, group: list[Code]):
        self.bits, self.group, self.base, self.n = bits, group, 0, -1

    def _load(self) -> None:
        bits, (green, red, blue, alpha, _) = self.bits, self.group
        self.base = bits.at >> 3
        part = np.frombuffer(bits.data[self.base : self.base + self.PIECE] + bytes(4), np.uint8).astype(np.uint32)
        self.n = n = 8 * (len(part) - 4)
        words = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
        window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).ravel()[: n + 8]
        self.window = np.concatenate((window, np.zeros(64, np.uint32)))
        head = self.window[:n] & np.uint32((1 << green.most) - 1)
        after = np.arange(n) + green.lengths[head]
        jump, taken = after, {}
        for code in (red, blue, alpha):
            if code.most:
                if id(code) not in taken:  # red and blue often have the same code
                    taken[id(code)] = code.lengths[self.window & np.uint32((1 << code.most) - 1)]
                jump = jump + taken[id(code)][jump]
        if green.top > 255:
            kind = green.symbols[head]
            if green.top > 279:
                jump = np.where(kind > 279, after, jump)
        jump[jump > n] = n + 256  # beyond this piece
        if green.top > 255:
            jump[(kind > 255) & (kind < 280)] = n + 128  # a back-reference
        self.follow = memoryview(np.ascontiguousarray(jump, np.int64))

    def read(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of the green code, colour if that is a literal) of up to ``most`` pixels from here on."""
        bits, n = self.bits, self.n
        p = bits.at - 8 * self.base
        if not 0 <= p < n or self.follow[p] == n + 256 and self.base < bits.at >> 3:
            self._load()
            p, n = bits.at - 8 * self.base, self.n
        starts: list[int] = []
        follow, add = self.follow, starts.append
        while most and p < n:
            q = follow[p]
            if q > n:
                break
            add(p)
            p = q
            most -= 1
        at = np.array(starts, np.int64)
        bits.at = 8 * self.base + p
        green, *rest = self.group[:4]
        w = self.window[at] & np.uint32((1 << green.most) - 1)
        symbol = green.symbols[w]
        at = at + green.lengths[w]
        value = symbol.astype(np.uint32) << np.uint32(8)
        for code, shift in zip(rest, (16, 0, 24), strict=True):
            if code.most:
                w = self.window[at] & np.uint32((1 << code.most) - 1)
                value |= code.symbols[w].astype(np.uint32) << np.uint32(shift)
                at = np.minimum(at + code.lengths[w], n + 32)
            else:
                value |= np.uint32(code.s[0] << shift)
        return symbol, value


def _resolve(symbol: np.ndarray, value: np.ndarray, held: np.ndarray, cache_bits: int) -> np.ndarray | None:
    """The colours of literal and cached pixels in a row; ``held`` is brought up to date. None if a slot is asked that nothing was written to."""
    known = symbol < 280
    slot = np.where(known, _slot(value, cache_bits), symbol - 280)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    s, k, v = slot[order], known[order], value[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    begin = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    last = np.maximum.accumulate(np.where(k, np.arange(len(s)), -1))
    v = np.where(last >= begin, v[last], held[s])
    if (_slot(v, cache_bits) != s).any():
        return None
    ends = np.append(np.flatnonzero(first)[1:], len(s)) - 1
    held[s[ends]] = v[ends]
    out = np.empty(len(v), np.uint32)
    out[order] = v
    return out


def _one_group(bits: Bits, group: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray | None:
    """All pixels of an image with one group of codes; None where only the symbol by symbol way will do."""
    green = group[0]
    if not green.most and green.s[0] > 255:
        return None
    if not any(c.most for c in group[:4]):
        return np.full(total, group[3].s[0] << 24 | group[1].s[0] << 16 | green.s[0] << 8 | group[2].s[0], np.uint32)
    out, at, run = np.zeros(total, np.uint32), 0, _Run(bits, group)
    held = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None
    while at < total:
        symbol, value = run.read(total - at)
        if n := len(value):
            if held is not None and (value := _resolve(symbol, value, held, cache_bits)) is None:
                return None
            out[at : at + n] = value
            at += n
            continue
        s = green.read(bits)
        if not 256 <= s < 280 or bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends too early")
        n = _copy(bits, group, s, out, at, width)
        if held is not None:  # of equal slots the last one stays
            held[_slot(out[at : at + n], cache_bits)] = out[at : at + n]
        at += n
    return out


def _copy(bits: Bits, group: list[Code], s: int, out: np.ndarray, at: int, width: int) -> int:
    n = _value(bits, s - 256)
    back = _distance(_value(bits, group[4].read(bits)), width)
    if back > at or at + n > len(out):
        raise ValueError("a back-reference outside the image")
    for k in range(0, n, back):
        m = min(back, n - k)
        out[at + k : at + k + m] = out[at + k - back : at + k - back + m]
    return n


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as a flat ARGB array."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11 or cache_bits < 0:
        raise ValueError("a colour cache of this size isn't allowed")
    groups_of, tile, across = None, 0, 0
    if top and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        groups_of = ((_pixels(bits, across, -(-height >> tile), False) >> 8) & 0xFFFF).tolist()
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [read_codes(bits, sizes) for _ in range(max(groups_of) + 1 if groups_of else 1)]
    if groups_of is None:
        start = bits.at
        if (out := _one_group(bits, groups[0], width, width * height, cache_bits)) is not None:
            if bits.at > 8 * len(bits.data):
                raise ValueError("the stream ends too early")
            return out
        bits.at = start
    total, at = width * height, 0
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    kept = 0  # pixels that the cache has seen
    while at < total:
        group = groups[0]
        if groups_of is not None:
            y, x = divmod(at, width)
            group = groups[groups_of[(y >> tile) * across + (x >> tile)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            at += _copy(bits, group, s, out, at, width)
        else:
            if cache is None:
                raise ValueError("no colour cache")
            for v in out[kept:at].tolist():
                cache[_slot(v, cache_bits)] = v
            kept = at
            out[at] = cache[s - 280]
            at += 1
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends too early")
    return out


def _channels(argb: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(height, width, 4).copy()


def _add(a, b):
    """Sum of packed colours, channel by channel modulo 256; ints or arrays."""
    return ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF) | ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00)


def _half(a, b):
    """Mean of packed colours, channel by channel, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _four(v: int) -> tuple[int, int, int, int]:
    return v & 255, v >> 8 & 255, v >> 16 & 255, v >> 24


def _joined(channels) -> int:
    return sum(min(255, max(0, c)) << 8 * k for k, c in enumerate(channels))


def _nearer(left: int, above: int, corner: int) -> int:
    """Mode 11: the neighbour that lies nearer to left + above - corner."""
    own = list(zip(_four(left), _four(above), _four(corner), strict=True))
    return left if sum(abs(a - c) for _, a, c in own) < sum(abs(x - c) for x, _, c in own) else above


def _steep(left: int, above: int, corner: int) -> int:
    """Mode 13: the mean of left and above, and half its distance from the corner, towards zero, on top."""
    own = zip(_four(_half(left, above)), _four(corner), strict=True)
    return _joined(m + (abs(m - c) // 2 if m >= c else -(abs(m - c) // 2)) for m, c in own)


BLACK = 0xFF000000
#: Predictions that need no pixel of the same row: whole rows at once. Arguments: above, corner, right.
_BY_ROW = {0: lambda a, c, r: a & 0 | BLACK, 2: lambda a, c, r: a, 3: lambda a, c, r: r, 4: lambda a, c, r: c, 8: lambda a, c, r: _half(c, a), 9: lambda a, c, r: _half(a, r), 14: lambda a, c, r: a & 0 | BLACK, 15: lambda a, c, r: a & 0 | BLACK}
#: Those that need the pixel on the left. Arguments: left, above, corner, right.
_BY_PIXEL = {
    1: lambda x, a, c, r: x,
    5: lambda x, a, c, r: _half(_half(x, r), a),
    6: lambda x, a, c, r: _half(x, c),
    7: lambda x, a, c, r: _half(x, a),
    10: lambda x, a, c, r: _half(_half(x, c), _half(a, r)),
    11: lambda x, a, c, r: _nearer(x, a, c),
    12: lambda x, a, c, r: _joined(p + q - s for p, q, s in zip(_four(x), _four(a), _four(c), strict=True)),
    13: lambda x, a, c, r: _steep(x, a, c),
}


def _undo_predictor(image: np.ndarray, modes: np.ndarray, tile: int) -> None:
    """Rows whose modes look only up are added as arrays; the pixels of others one by one."""
    height, width, _ = image.shape
    modes = modes & 15
    image[0, 0, 3] = (int(image[0, 0, 3]) + 255) & 255
    image[0] = image[0].cumsum(axis=0, dtype=np.uint8)
    if (modes == 2).all():
        image[:] = image.cumsum(axis=0, dtype=np.uint8)
        return
    image[:, 0] = image[:, 0].cumsum(axis=0, dtype=np.uint8)
    px = image.view(np.uint32)[:, :, 0].astype(np.int64)
    for y in range(1, height):
        above, corner, right = px[y - 1, 1:], px[y - 1, :-1], np.append(px[y - 1, 2:], px[y, 0])
        own = modes[y >> tile].repeat(1 << tile)[1:width]
        present = set(own.tolist())
        if present == {1}:
            row = px[y].astype("<u4").view(np.uint8).reshape(width, 4).cumsum(axis=0, dtype=np.uint8)
            px[y] = row.view("<u4")[:, 0]
        elif present <= _BY_ROW.keys():
            guess = np.zeros(width - 1, np.int64)
            for m in present:
                guess = np.where(own == m, _BY_ROW[m](above, corner, right), guess)
            px[y, 1:] = _add(px[y, 1:], guess[: width - 1])
        else:
            row, a, c, r = px[y].tolist(), above.tolist(), corner.tolist(), right.tolist()
            for x, m in enumerate(own.tolist()):
                row[x + 1] = _add(row[x + 1], _BY_PIXEL[m](row[x], a[x], c[x], r[x]) if m in _BY_PIXEL else _BY_ROW[m](a[x], c[x], r[x]))
            px[y] = row
    image[:] = _channels(px.astype(np.uint32), height, width)


def _spread(tiles: np.ndarray, tile: int, height: int, width: int) -> np.ndarray:
    return tiles.repeat(1 << tile, 0).repeat(1 << tile, 1)[:height, :width]


def _undo_cross(image: np.ndarray, factors: np.ndarray, tile: int) -> None:
    height, width, _ = image.shape
    f = _spread(factors, tile, height, width).view(np.int8).astype(np.int32)
    signed = lambda c: image[:, :, c].view(np.int8).astype(np.int32)
    green = signed(1)
    image[:, :, 2] = (image[:, :, 2].astype(np.int32) + (f[:, :, 0] * green >> 5)) & 255
    image[:, :, 0] = (image[:, :, 0].astype(np.int32) + (f[:, :, 1] * green >> 5) + (f[:, :, 2] * signed(2) >> 5)) & 255


def decode_stream(data: bytes) -> np.ndarray:
    """The ARGB image of a VP8L chunk as (height, width, 4) bytes in the order blue, green, red, alpha."""
    bits = Bits(bytes(data))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is there twice")
        seen.add(kind)
        if kind < 2:
            tile = bits.read(3) + 2
            w, h = -(-inner >> tile), -(-height >> tile)
            undo.append((kind, tile, _channels(_pixels(bits, w, h, False), h, w), inner))
        elif kind == 2:
            undo.append((kind, 0, None, inner))
        else:
            n = bits.read(8) + 1
            table = _channels(_pixels(bits, n, 1, False), 1, n)[0].astype(np.int64).cumsum(axis=0).astype(np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, table, inner))
            inner = -(-inner >> pack)
    image = _channels(_pixels(bits, inner, height, True), height, inner)
    for kind, tile, extra, wide in reversed(undo):
        if kind == 0:
            _undo_predictor(image, extra[:, :, 1], tile)
        elif kind == 1:
            _undo_cross(image, extra, tile)
        elif kind == 2:
            image[:, :, 0] += image[:, :, 1]
            image[:, :, 2] += image[:, :, 1]
        else:
            depth = 8 >> tile
            x = np.arange(wide)
            index = (image[:, x >> tile, 1] >> ((x & ((1 << tile) - 1)) * depth).astype(np.uint8)) & np.uint8((1 << depth) - 1)
            full = np.zeros((256, 4), np.uint8)
            full[: len(extra)] = extra
            image = full[index]
    return image


def chunks(data: bytes):
    """The VP8L chunk of each WebP file in a row of files."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end, p, found = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, False
        while p + 8 <= end:
            name, size = data[p : p + 4], struct.unpack_from("<I", data, p + 4)[0]
            if name == b"VP8L":
                found = True
                yield data[p + 8 : p + 8 + size]
            p += 8 + size + (size & 1)
        if not found:
            raise ValueError("no lossless image in the file")
        at = end


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


# ---- storing bytes


def text_lengths() -> bytes:
    """Code lengths for bytes of text: 16 of 5 bits, 32 of 7, and the rest in order, 48 of 9 and 160 of 10; this is complete."""
    common = b" etaonirshdlucmp"
    second = bytes(x for x in range(97, 123) if x not in common) + b".,\n|\xc3" + bytes(range(65, 65 + 32))
    out = bytearray(256)
    for s in common:
        out[s] = 5
    n = 0
    for s in second:
        if n < 32 and not out[s]:
            out[s], n = 7, n + 1
    for k, s in enumerate([s for s in range(256) if not out[s]]):
        out[s] = 9 if k < 48 else 10
    return bytes(out)


def bit_rows(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its bits in stream order, and which of the columns count."""
    code, most = Code(lengths), max(lengths)
    bits, used = np.zeros((len(lengths), most), np.uint8), np.zeros((len(lengths), most), bool)
    for w in range(len(code.s) - 1, -1, -1):
        s, n = code.s[w], code.n[w]
        bits[s] = [(w >> k) & 1 for k in range(most)]
        used[s, :n] = True
    return bits, used


class BitWriter:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [(value >> k) & 1 for k in range(n)]

    def one_symbol(self, symbol: int) -> None:
        """A code with a single symbol, which takes no bits."""
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def two_symbols(self, first: int, second: int) -> None:
        """A code with two symbols of a bit each."""
        self.put(1, 1)
        self.put(1, 1)
        self.put(1, 1)
        self.put(first, 8)
        self.put(second, 8)

    def lengths(self, lengths: bytes) -> None:
        """A code by its lengths, with repeats of 3 to 6 for equal neighbours; what follows the last is 0."""
        out, k = [], 0
        while k < len(lengths):
            same = 1
            while k + same < len(lengths) and lengths[k + same] == lengths[k]:
                same += 1
            out.append((lengths[k], None))
            left = same - 1
            while left >= 3 and lengths[k]:
                n = min(6, left)
                out.append((16, n - 3))
                left -= n
            out += [(lengths[k], None)] * left
            k += same
        used = sorted({s for s, _ in out})
        depth = max(1, (len(used) - 1).bit_length())
        short = (1 << depth) - len(used) if len(used) > 1 else 0
        of = bytearray(19)
        for j, s in enumerate(used):
            of[s] = depth - 1 if j < short else depth
        self.put(0, 1)
        self.put(15, 4)
        for s in LENGTH_ORDER:
            self.put(of[s], 3)
        wide = 3 if len(out) < 258 else 4
        self.put(1, 1)
        self.put(wide, 3)
        self.put(len(out) - 2, 2 + 2 * wide)
        bits, mask = bit_rows(bytes(of)) if len(used) > 1 else (np.zeros((19, 1), np.uint8), np.zeros((19, 1), bool))
        for s, extra in out:
            self.bits += bits[s][mask[s]].tolist()
            if extra is not None:
                self.put(extra, 2)


def huffman(weights: list[float]) -> bytes:
    """Code lengths of an optimal prefix code."""
    heap = [(w, k, [k]) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    out = bytearray(len(weights))
    while len(heap) > 1:
        (v, _, a), (w, k, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            out[s] += 1
        heapq.heappush(heap, (v + w, k, a + b))
    return bytes(out)


def prefixed(value: int) -> tuple[int, int, int]:
    """(prefix symbol, number of extra bits, their value) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = ((value - 1) >> (high - 1)) & 1
    return 2 * high + second, high - 1, (value - 1) & ((1 << (high - 1)) - 1)


class Plan:
    """Fixed codes for an image: its header's bits, and a table of the bits of every symbol.

    Rows of the table: the green code (literals, lengths, cache slots), one code for red and blue,
    the distance code, and an empty row.
    """

    def __init__(self, cache_bits: int = 0, index_bits: int | None = None, alpha: tuple[int, ...] = (255,), top: bool = True):
        slots = 1 << cache_bits if cache_bits else 0
        if index_bits is None:
            text = text_lengths()
            hits, copies = 0.45 if slots else 0.0, 0.02
            green = huffman([2.0**-n * (1 - hits - copies) for n in text] + [copies / 24] * 24 + [hits / max(1, slots)] * slots)
            far = huffman([0.5 if s == 1 else 0.5 / 39 for s in range(40)])
        else:
            text = green = bytes([index_bits]) * (1 << index_bits)
            far = None
        w = BitWriter()
        w.put(int(bool(slots)), 1)
        if slots:
            w.put(cache_bits, 4)
        if top:
            w.put(0, 1)  # one group of codes
        if index_bits == 0:
            w.one_symbol(0)
        else:
            w.lengths(green)
        for _ in range(2):
            if top and index_bits is not None:
                w.one_symbol(0)
            else:
                w.lengths(text)
        if len(alpha) == 1:
            w.one_symbol(alpha[0])
        else:
            w.two_symbols(*alpha)
        if far:
            w.lengths(far)
        else:
            w.one_symbol(0)
        self.head = np.array(w.bits, np.uint8)
        parts = [bit_rows(x) for x in (green, text, far) if x and len(x) > 1]
        most = max(b.shape[1] for b, _ in parts) if parts else 1
        wide = [[np.pad(x, ((0, 0), (0, most - x.shape[1]))) for x in p] for p in parts] + [[np.zeros((1, most), t) for t in (np.uint8, bool)]]
        self.bits, self.used = (np.concatenate([p[k] for p in wide]) for k in (0, 1))
        self.other, self.far, self.none = len(green), len(green) + len(text), len(self.bits) - 1
        self.cost = self.used.sum(axis=1, dtype=np.int32)

    def body(self, symbols: np.ndarray) -> np.ndarray:
        """The bits of a row of symbols."""
        return self.bits[symbols][self.used[symbols]]

    def copy(self, n: int, distance: int) -> np.ndarray:
        """The bits of back-references, as many as a run of n pixels takes."""
        out = BitWriter()
        while n:
            part = min(n, 4096)
            for symbol, (extra, rest) in ((256 + prefixed(part)[0], prefixed(part)[1:]), (lambda p: (self.far + p[0], p[1:]))(prefixed(2 if distance == 1 else len(NEAR) + distance))):
                out.bits += self.body(np.array([symbol])).tolist()
                out.put(rest, extra)
            n -= part
        return np.array(out.bits, np.uint8)


plan = cache(Plan)


def repeats(v: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, pixels, distance) of runs of ``LEAST`` pixels or more that stood before."""
    n = len(v) - LEAST + 1
    if n <= 1:
        return []
    h, size = v.astype(np.uint64), 1
    while size < LEAST:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size *= 2
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(again):
        return []
    before = np.full(n, -1, np.int64)
    before[order[again + 1]] = order[again]
    out, done = [], 0
    for at in np.flatnonzero(before >= 0).tolist():
        if at < done:
            continue
        back, end, piece = at - int(before[at]), at, 64
        while end < len(v):
            same = v[end : end + piece] == v[end - back : end - back + len(v[end : end + piece])]
            end += len(same) if same.all() else int(same.argmin())
            if not same.all():
                break
            piece *= 2
        if end - at >= LEAST:
            out.append((at, end - at, back))
            done = end
    return out


def hits(v: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, whether the cache holds the colour there) of each pixel."""
    slot = _slot(v, cache_bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    found = np.zeros(len(v), bool)
    found[order[1:]] = v[order[1:]] == v[order[:-1]]
    return slot, found


def encode(part: np.ndarray) -> bytes:
    """Rows of WIDTH pixels of three bytes as a lossless stream, in the cheapest of the three forms."""
    height = len(part) // WIDTH
    wide = part.astype(np.uint32)
    v = wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2] | np.uint32(BLACK)
    copies = repeats(v)
    own = np.ones(len(v), bool)
    for at, n, _ in copies:
        own[at : at + n] = False
    slot, hit = hits(v, CACHE_BITS)
    literal, cached = plan(), plan(CACHE_BITS)
    red, green, blue = (np.ascontiguousarray(part[:, c]) for c in range(3))
    sizes = []
    for p in (literal, cached):
        cost = p.cost[green] + p.cost[p.other :][red] + p.cost[p.other :][blue]
        sizes.append(len(p.head) + 1 + int((np.where(hit, p.cost[280], cost) if p is cached else cost)[own].sum()) + 24 * len(copies))
    size, p = (sizes[1], cached) if sizes[1] < sizes[0] else (sizes[0], literal)
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(WIDTH - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    # a colour has one slot, so that there are as many colours as slots in use at least
    least = np.count_nonzero(np.bincount(slot))
    if least <= 256 and 25 * least + len(v) < size and (painted := _painted(v, height, size)):
        bits = [np.array(w.bits, np.uint8), *painted]
    else:
        symbols = np.empty((len(v), 3), np.int32)
        symbols[:, 0], symbols[:, 1], symbols[:, 2] = green, red, blue
        symbols[:, 1:] += p.other
        if p is cached:
            symbols[hit] = p.none
            symbols[hit, 0] = 280 + slot[hit]
        w.put(0, 1)  # no transform
        bits, done = [np.array(w.bits, np.uint8), p.head], 0
        for at, n, back in copies:
            bits += [p.body(symbols[done:at].ravel()), p.copy(n, back)]
            done = at + n
        bits.append(p.body(symbols[done:].ravel()))
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def _painted(v: np.ndarray, height: int, size: int) -> list[np.ndarray] | None:
    """The bits of an image by its palette, if they are fewer than ``size``."""
    colours = np.unique(v)
    if (n := len(colours)) > 256:
        return None
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    depth = 8 >> pack if pack else (n - 1).bit_length()
    table, index = plan(0, 8, (255,) if n == 1 else (0, 255), False), plan(0, 8 if pack else depth)
    if 12 + len(table.head) + 25 * n + len(index.head) + depth * len(v) >= size:
        return None
    w = BitWriter()
    w.put(1, 1)
    w.put(3, 2)
    w.put(n - 1, 8)
    deltas = np.diff(_channels(colours, 1, n)[0], axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.int64)
    at = np.searchsorted(colours, v).astype(np.int64).reshape(height, WIDTH)
    if pack:
        at = (at.reshape(height, WIDTH >> pack, 1 << pack) << (depth * np.arange(1 << pack))).sum(axis=2)
    tinted = []
    for blue, green, red, alpha in deltas.tolist():
        tinted.append(table.body(np.array([green, table.other + red, table.other + blue])))
        if n > 1:
            tinted.append(np.array([alpha == 255], np.uint8))
    return [np.array(w.bits, np.uint8), table.head, *tinted, np.zeros(1, np.uint8), index.head, index.body(at.ravel())]


def store(payload: bytes) -> bytes:
    """``payload``, a positive multiple of ROW_BYTES, as WebP files in a row."""
    size = ROWS * ROW_BYTES
    return b"".join(riff(encode(np.frombuffer(payload[at : at + size], np.uint8).reshape(-1, 3))) for at in range(0, len(payload), size))


def load(media: bytes) -> bytes:
    """The payload of ``store``."""
    return b"".join(np.ascontiguousarray(decode_stream(c)[:, :, 2::-1]).tobytes() for c in chunks(media))
