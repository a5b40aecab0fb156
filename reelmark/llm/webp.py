"""Lossless WebP: a decoder of the whole format for many pictures at once, and an encoder of grey pictures.

The decoder reads each picture's header, transforms and prefix codes, then decodes all pictures of a batch in step: one numpy operation
takes one token of every picture, a literal, a colour-cache index or a back-reference. Predictor, cross-colour, subtract-green and
palette transforms are then inverted. The encoder writes a palette, prefix codes and back-references to repeated words.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from reelmark.llm.common import mixed

# Fixed values of the format: the order of code-length codes, and the neighbours (dx, dy) of the 120 short distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = """
0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3
2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1
2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7
7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7
"""
_NEAR = np.array([[int(v) for v in pair.split(",")] for pair in NEIGHBOURS.split()], np.int64)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_CACHE_FACTOR = np.uint32(0x1E35A7BD)
_LENGTHS, _DISTANCES = 24, 40
_reversals: dict[int, np.ndarray] = {}


def reversal(bits: int) -> np.ndarray:
    """The numbers below 2^bits with their bits in reverse."""
    if bits not in _reversals:
        out = np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= ((np.arange(1 << bits) >> k) & 1) << (bits - 1 - k)
        _reversals[bits] = out
    return _reversals[bits]


class WebPError(ValueError):
    """The bytes aren't a lossless WebP picture."""


class Bits:
    """Bits of a byte string from the lowest up."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\0" * 16, 0, 8 * len(data)

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > self.end:
            raise WebPError("the data end too early")
        return (int.from_bytes(self.data[a >> 3 : (a >> 3) + 8], "little") >> (a & 7)) & ((1 << n) - 1)

    def peek(self) -> int:
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a >> 3) + 8], "little") >> (a & 7)


@dataclass(frozen=True)
class Code:
    """A prefix code: by the next `bits` bits as they come, 16 * symbol + length."""

    bits: int
    entries: np.ndarray
    listed: list[int]

    def get(self, reader: Bits) -> int:
        entry = self.listed[reader.peek() & ((1 << self.bits) - 1)]
        reader.at += entry & 15
        if reader.at > reader.end:
            raise WebPError("the data end too early")
        return entry >> 4


@lru_cache(maxsize=512)
def canonical(lengths: bytes) -> Code:
    """The code in which shorter lengths, then smaller symbols, come first. It must be complete; a lone symbol takes no bits."""
    length = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(length)
    if len(used) <= 1:
        only = int(used[0]) << 4 if len(used) else 0
        return Code(0, np.array([only], np.int32), [only])
    own = length[used]
    bits = int(own.max())
    order = np.argsort(own, kind="stable")
    spans = 1 << (bits - own[order].astype(np.int64))
    if spans.sum() != 1 << bits:
        raise WebPError("a prefix code isn't complete")
    entries = np.repeat((used[order] << 4 | own[order]).astype(np.int32), spans)[reversal(bits)]
    return Code(bits, entries, entries.tolist() if bits <= 8 else _Lazy(entries))


class _Lazy:
    """Single entries of a large table as plain numbers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries

    def __getitem__(self, k: int) -> int:
        return int(self.entries[k])


def read_code(reader: Bits, alphabet: int) -> Code:
    if reader.read(1):
        two, wide = reader.read(1), reader.read(1)
        symbols = [reader.read(8 if wide else 1)] + ([reader.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebPError("a symbol lies beyond its alphabet")
        few = bytearray(max(symbols) + 1)
        for symbol in symbols:
            few[symbol] = 1
        return canonical(bytes(few))
    of_lengths = bytearray(19)
    for k in range(reader.read(4) + 4):
        of_lengths[CODE_LENGTH_ORDER[k]] = reader.read(3)
    code = canonical(bytes(of_lengths))
    left = alphabet
    if reader.read(1):
        left = 2 + reader.read(2 + 2 * reader.read(3))
        if left > alphabet:
            raise WebPError("more code lengths than symbols")
    entries, mask = code.listed, (1 << code.bits) - 1
    if not code.bits and entries[0] >> 4 < 16:
        return canonical(bytes([entries[0] >> 4]) * left)
    out: list[int] = []
    last, data, at = 8, reader.data, reader.at
    window, room = 0, 0
    while len(out) < alphabet and left:
        left -= 1
        if room < 16:
            window, room = int.from_bytes(data[at >> 3 : (at >> 3) + 60], "little") >> (at & 7), 470
        entry = entries[window & mask]
        symbol, n = entry >> 4, entry & 15
        if symbol < 16:
            out.append(symbol)
            if symbol:
                last = symbol
        else:
            extra, base, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[symbol - 16]
            out += [value] * (base + ((window >> n) & ((1 << extra) - 1)))
            n += extra
        window >>= n
        room -= n
        at += n
    reader.at = at
    if at > reader.end or len(out) > alphabet:
        raise WebPError("the code lengths don't fit")
    return canonical(bytes(out))


def prefix_value(symbol: int, reader: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + reader.read(extra) + 1


def read_group(reader: Bits, cache_bits: int) -> list[Code]:
    return [read_code(reader, n) for n in (256 + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)]


def read_cache_bits(reader: Bits) -> int:
    if not reader.read(1):
        return 0
    if not 1 <= (bits := reader.read(4)) <= 11:
        raise WebPError("the colour cache has no such size")
    return bits


def read_small(reader: Bits, width: int, height: int) -> np.ndarray:
    """A picture inside the header (palette, transform data, numbers of code groups): one group of codes."""
    cache_bits = read_cache_bits(reader)
    green, red, blue, alpha, distance = read_group(reader, cache_bits)
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    n = width * height

    def put(colour: int) -> None:
        out.append(colour)
        if cache_bits:
            cache[(0x1E35A7BD * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour

    if not (cache_bits or red.bits or blue.bits or alpha.bits):  # often so: single steps without the calls below, up to the first copy
        rest, entries, mask, room = (alpha.listed[0] >> 4) << 24 | (red.listed[0] >> 4) << 16 | blue.listed[0] >> 4, green.listed, (1 << green.bits) - 1, 0
        while len(out) < n:
            if room < 16:
                window, room = int.from_bytes(reader.data[reader.at >> 3 : (reader.at >> 3) + 60], "little") >> (reader.at & 7), 470
            entry = entries[window & mask]
            if entry >> 12:
                break
            out.append(rest | (entry >> 4) << 8)
            window >>= entry & 15
            room -= entry & 15
            reader.at += entry & 15
    while len(out) < n:
        symbol = green.get(reader)
        if symbol < 256:
            r, b, a = red.get(reader), blue.get(reader), alpha.get(reader)
            put(a << 24 | r << 16 | symbol << 8 | b)
        elif symbol < 256 + _LENGTHS:
            length = prefix_value(symbol - 256, reader)
            code = prefix_value(distance.get(reader), reader)
            back = code - 120 if code > 120 else max(1, int(_NEAR[code - 1, 0] + _NEAR[code - 1, 1] * width))
            if back > len(out) or len(out) + length > n:
                raise WebPError("a back-reference leaves the picture")
            for _ in range(length):
                put(out[-back])
        else:
            out.append(cache[symbol - 256 - _LENGTHS])
    return np.array(out, np.uint32)


@dataclass
class Picture:
    """A picture between its header and its pixels."""

    width: int
    height: int
    alpha: bool
    data: bytes
    bit: int
    coded_width: int
    transforms: list[tuple]
    cache_bits: int
    groups: list[list[Code]]
    group_bits: int = 0
    group_map: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))


def riff_pictures(stored: bytes) -> list[bytes]:
    """The VP8L data of each of the files that follow one another."""
    out, at = [], 0
    while at < len(stored):
        if stored[at : at + 4] != b"RIFF" or stored[at + 8 : at + 16] != b"WEBPVP8L":
            raise WebPError("no lossless WebP file")
        size, inner = struct.unpack_from("<I", stored, at + 4)[0], struct.unpack_from("<I", stored, at + 16)[0]
        out.append(stored[at + 20 : at + 20 + inner])
        at += 8 + size + (size & 1)
    return out


def read_header(data: bytes) -> Picture:
    reader = Bits(data)
    if reader.read(8) != 0x2F:
        raise WebPError("no VP8L data")
    width, height, alpha = reader.read(14) + 1, reader.read(14) + 1, bool(reader.read(1))
    if reader.read(3):
        raise WebPError("an unknown version")
    coded, transforms, seen = width, [], set()
    while reader.read(1):
        kind = reader.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.read(3) + 2
            across, down = (coded + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            transforms.append((kind, coded, bits, read_small(reader, across, down).reshape(down, across)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, coded))
        else:
            n = reader.read(8) + 1
            table = read_small(reader, n, 1).view(np.uint8).reshape(n, 4)
            table = np.cumsum(table, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, coded, pack, table))
            coded = (coded + (1 << pack) - 1) >> pack
    cache_bits = read_cache_bits(reader)
    picture = Picture(width, height, alpha, data, 0, coded, transforms, cache_bits, [])
    count = 1
    if reader.read(1):
        picture.group_bits = reader.read(3) + 2
        across, down = ((x + (1 << picture.group_bits) - 1) >> picture.group_bits for x in (coded, height))
        picture.group_map = ((read_small(reader, across, down) >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
        count = int(picture.group_map.max()) + 1
    picture.groups = [read_group(reader, cache_bits) for _ in range(count)]
    picture.bit = reader.at
    return picture


class _Tables:
    """One kind of code of all groups of all pictures in flat arrays; each group's table has as many entries as its longest code needs."""

    def __init__(self, codes: list[Code]) -> None:
        self.base = np.concatenate(([0], np.cumsum([1 << c.bits for c in codes])))[:-1]
        self.mask = np.array([(1 << c.bits) - 1 for c in codes], np.uint64)
        self.entries = np.concatenate([c.entries for c in codes])
        self.trivial = not self.mask.any()

    def get(self, group: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = self.entries[self.base[group] + (window & self.mask[group]).astype(np.int64)]
        return entry >> 4, entry & 15

    def only(self, group: np.ndarray) -> np.ndarray:
        return (self.entries[self.base[group]] >> 4).astype(np.uint32)


def _values(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of prefix-coded numbers and how many extra bits each took."""
    extra = np.maximum(0, (symbol - 2) >> 1)
    big = ((2 + (symbol & 1)) << extra) + (window & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64) + 1
    return np.where(symbol < 4, symbol + 1, big), extra


def decode_pixels(pictures: list[Picture]) -> list[np.ndarray]:
    """The coded pixels (before the transforms are undone) of each picture, decoded in step."""
    if not pictures:
        return []
    pad = b"\0" * 16
    stream = b"".join(p.data + pad for p in pictures)
    words = np.ndarray((len(stream) - 7,), "<u8", stream, strides=(1,))
    sizes = np.array([p.coded_width * p.height for p in pictures], np.int64)
    byte_at = np.concatenate(([0], np.cumsum([len(p.data) + len(pad) for p in pictures])))
    bit = 8 * byte_at[:-1] + np.array([p.bit for p in pictures], np.int64)
    last_bit = 8 * (byte_at[1:] - len(pad))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint32)
    flat = [g for p in pictures for g in p.groups]
    green, red, blue, alpha, distance = (_Tables([g[k] for g in flat]) for k in range(5))
    first_group = np.concatenate(([0], np.cumsum([len(p.groups) for p in pictures])))[:-1]
    many = np.array([len(p.groups) > 1 for p in pictures])
    map_at = np.concatenate(([0], np.cumsum([len(p.group_map) for p in pictures])))[:-1]
    maps = np.concatenate([p.group_map for p in pictures])
    group_bits = np.array([p.group_bits for p in pictures], np.int64)
    widths = np.array([p.coded_width for p in pictures], np.int64)
    cache_bits = np.array([p.cache_bits for p in pictures], np.int64)
    cache_at = np.concatenate(([0], np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0))))
    cache = np.zeros(max(1, cache_at[-1]), np.uint32)
    cached = bool(cache_bits.any())
    at = starts[:-1].copy()
    live = np.arange(len(pictures))

    def remember(which: np.ndarray, colours: np.ndarray) -> None:
        has = cache_bits[which] > 0
        which, colours = which[has], colours[has]
        cache[cache_at[which] + ((colours * _CACHE_FACTOR) >> (32 - cache_bits[which]).astype(np.uint32))] = colours

    def group_of(which: np.ndarray) -> np.ndarray:
        group = first_group[which]
        if (split := np.flatnonzero(many[which])).size:
            w = which[split]
            pixel, bits, width = at[w] - starts[w], group_bits[w], widths[w]
            across = (width + (1 << bits) - 1) >> bits
            group = group.copy()
            group[split] += maps[map_at[w] + (pixel // width >> bits) * across + (pixel % width >> bits)]
        return group

    def window(position: np.ndarray) -> np.ndarray:
        return words[position >> 3] >> (position & 7).astype(np.uint64)

    plain = red.trivial and blue.trivial and alpha.trivial
    simple = not many.any()
    everyone = np.arange(len(flat))
    constant = (alpha.only(everyone) << np.uint32(24)) | (red.only(everyone) << np.uint32(16)) | blue.only(everyone)
    while live.size:
        position = bit[live]
        group = first_group[live] if simple else group_of(live)
        look = window(position)
        symbol, used = green.get(group, look)
        position = position + used
        spot = at[live]
        literal = symbol < 256
        every = bool(literal.all())
        # Literals.
        pick = slice(None) if every else np.flatnonzero(literal)
        if every or len(pick):
            g, s = group[pick], symbol[pick].astype(np.uint32)
            if plain:
                colour = constant[g] | (s << np.uint32(8))
            else:
                p = position[pick]
                parts = []
                for table in (red, blue, alpha):
                    value, used = table.get(g, window(p))
                    p = p + used
                    parts.append(value.astype(np.uint32))
                position[pick] = p
                colour = (parts[2] << np.uint32(24)) | (parts[0] << np.uint32(16)) | (s << np.uint32(8)) | parts[1]
            out[spot[pick]] = colour
            if cached:
                remember(live[pick], colour)
        step = np.ones(len(live), np.int64)
        if not every:
            copies = np.flatnonzero((symbol >= 256) & (symbol < 256 + _LENGTHS))
            if len(copies):
                p, w = position[copies], live[copies]
                length, used = _values(symbol[copies].astype(np.int64) - 256, window(p))
                p = p + used
                code, used = distance.get(group[copies], window(p))
                p = p + used
                number, used = _values(code.astype(np.int64), window(p))
                position[copies] = p + used
                near = np.minimum(number, 120) - 1
                back = np.where(number > 120, number - 120, np.maximum(1, _NEAR[near, 0] + _NEAR[near, 1] * widths[w]))
                to = spot[copies]
                if (back > to - starts[w]).any() or (to + length > starts[w + 1]).any():
                    raise WebPError("a back-reference leaves the picture")
                ends = np.cumsum(length)
                within = np.arange(ends[-1]) - np.repeat(ends - length, length)
                whole = np.repeat(back, length)
                target = np.repeat(to, length) + within
                # Pixels that the reference itself writes repeat those before it.
                out[target] = out[np.repeat(to, length) - whole + within % whole]
                if cached:
                    remember(np.repeat(w, length), out[target])
                step[copies] = length
            picks = np.flatnonzero(symbol >= 256 + _LENGTHS)
            if len(picks):
                out[spot[picks]] = cache[cache_at[live[picks]] + symbol[picks] - 256 - _LENGTHS]
        bit[live] = position
        spot = spot + step
        at[live] = spot
        going = spot < starts[live + 1]
        if not going.all():
            live = live[going]
    if (bit > last_bit).any():
        raise WebPError("the data end too early")
    return [out[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _half(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(x: int) -> tuple[int, int, int, int]:
    return x >> 24, (x >> 16) & 255, (x >> 8) & 255, x & 255


def _joined(a: int, r: int, g: int, b: int) -> int:
    return a << 24 | r << 16 | g << 8 | b


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _toward(v: int) -> int:
    return -(-v >> 1) if v < 0 else v >> 1


def predicted(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    lefts, tops, corners = _channels(left), _channels(top), _channels(top_left)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(tops, corners, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(lefts, corners, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return _joined(*(_clamp(x + t - c) for x, t, c in zip(lefts, tops, corners, strict=True)))
    if mode == 13:
        means = _channels(_half(left, top))
        return _joined(*(_clamp(m + _toward(m - c)) for m, c in zip(means, corners, strict=True)))
    return 0xFF000000


def undo_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    out: list[int] = []
    rest = pixels.tolist()
    chosen = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    for y in range(height):
        for x in range(width):
            k = y * width + x
            if not k:
                guess = 0xFF000000
            elif not y:
                guess = out[k - 1]
            elif not x:
                guess = out[k - width]
            else:
                guess = predicted(chosen[y >> bits][x >> bits], out[k - 1], out[k - width], out[k - width - 1], out[k - width + 1])
            a, b = rest[k], guess
            out.append((((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00) | (((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF))
    return np.array(out, np.uint32)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, factors: np.ndarray) -> np.ndarray:
    rows, columns = np.arange(height) >> bits, np.arange(width) >> bits
    f = factors[rows[:, None], columns[None, :]].ravel()
    signed = lambda x: (x & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    green_red, green_blue, red_blue = signed(f), signed(f >> np.uint32(8)), signed(f >> np.uint32(16))
    green = signed(pixels >> np.uint32(8))
    red = (signed(pixels >> np.uint32(16)) + ((green_red * green) >> 5)) & 255
    blue = signed(pixels) + ((green_blue * green) >> 5)
    blue = (blue + ((red_blue * red.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << np.uint32(16)) | blue.astype(np.uint32)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    return (pixels & np.uint32(0xFF00FF00)) | ((pixels + (green << np.uint32(16))) & np.uint32(0x00FF0000)) | ((pixels + green) & np.uint32(0xFF))


def undo_palette(pixels: np.ndarray, width: int, height: int, pack: int, table: np.ndarray) -> np.ndarray:
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if pack:
        bits = 8 >> pack
        shifts = (np.arange(1 << pack) * bits).astype(np.uint32)
        index = ((index.reshape(height, -1, 1) >> shifts) & np.uint32((1 << bits) - 1)).reshape(height, -1)[:, :width].ravel()
    return np.concatenate((table, np.zeros(256, np.uint32)))[index]


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The ARGB pixels, [height, width] of 32 bits, of each VP8L picture."""
    pictures = [read_header(f) for f in files]
    out = []
    for p, pixels in zip(pictures, decode_pixels(pictures), strict=True):
        for kind, width, *rest in reversed(p.transforms):
            if kind == PREDICTOR:
                pixels = undo_predictor(pixels, width, p.height, *rest)
            elif kind == CROSS_COLOUR:
                pixels = undo_cross_colour(pixels, width, p.height, *rest)
            elif kind == SUBTRACT_GREEN:
                pixels = undo_subtract_green(pixels)
            else:
                pixels = undo_palette(pixels, width, p.height, *rest)
        pixels = pixels if p.alpha else pixels | np.uint32(0xFF000000)
        out.append(pixels.reshape(p.height, p.width))
    return out


# The encoder of grey pictures ------------------------------------------------------------------------------------------------------

LONGEST = 11
SHORTEST_MATCH = 8
#: Code-length codes: 15 lengths of 4 bits, and 5 bits each for an unused symbol and for a run of 11 to 138 of them; a complete code.
_LENGTH_CODE = np.array([5] + [4] * 15 + [0, 0, 5], np.uint8)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete prefix codes of at most LONGEST bits, one for each row of counts; symbols that don't occur have length 0."""
    rows = len(counts)
    used = counts > 0
    floor = np.maximum(1, -(-counts.sum(1) // 1500))[:, None]
    weight = np.where(used, np.maximum(counts, floor), 0).astype(np.float64)
    share = weight / np.maximum(weight.sum(1), 1)[:, None]
    with np.errstate(divide="ignore"):
        length = np.where(used, np.clip(np.ceil(-np.log2(share) - 1e-9), 1, LONGEST), 0).astype(np.int64)
    order = np.argsort(-weight, axis=1, kind="stable")[:, : int(used.sum(1).max()) if rows else 0]
    left = (1 << LONGEST) - np.where(used, 1 << (LONGEST - length), 0).sum(1)
    row = np.arange(rows)
    while left.any():  # shorten the most frequent symbols first, as far as room is left
        for k in range(order.shape[1]):
            symbol = order[:, k]
            own = length[row, symbol]
            gain = np.where(own > 1, 1 << (LONGEST - np.maximum(own, 1)), 1 << 30)
            shorter = (gain <= left) & (own > 1)
            length[row[shorter], symbol[shorter]] -= 1
            left = left - np.where(shorter, gain, 0)
    return length


def canonical_codes(length: np.ndarray) -> np.ndarray:
    """The codes of each row's lengths with their bits in the order in which they are written."""
    rows, n = length.shape
    order = np.argsort(np.where(length > 0, length, 99), axis=1, kind="stable")
    sorted_length = np.take_along_axis(length, order, 1)
    span = np.where(sorted_length > 0, 1 << (LONGEST - np.maximum(sorted_length, 0)), 0)
    start = np.cumsum(span, 1) - span
    codes = np.zeros((rows, n), np.int64)
    np.put_along_axis(codes, order, reversal(LONGEST)[start & ((1 << LONGEST) - 1)], 1)
    return codes  # a code shorter than LONGEST has zeros above its bits


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and their value for numbers from 1 on."""
    v = value - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1))
    return symbol, extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


def find_repeats(data: np.ndarray, strip: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, length and distance of back-references, apart from one another: words (after a blank) whose first bytes stood before in the same strip."""
    none = np.zeros(0, np.int64)
    if len(data) < 16:
        return none, none, none
    heads = np.flatnonzero((data[:-1] == 32) & (data[1:] != 32)) + 1
    heads = heads[heads + SHORTEST_MATCH <= starts[strip[heads] + 1]]
    if len(heads) < 2:
        return none, none, none
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    key = mixed(eight[heads]) ^ mixed(strip[heads].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    at, before = heads[order][1:][same], heads[order][:-1][same]
    same = (eight[at] == eight[before]) & (strip[at] == strip[before])
    at, before = at[same], before[same]
    order = np.argsort(at)
    at, before = at[order], before[order]
    if not len(at):
        return none, none, none
    limit = np.minimum(starts[strip[at] + 1], np.concatenate((at[1:], [len(data)])))
    length = np.full(len(at), SHORTEST_MATCH, np.int64)
    grow = np.flatnonzero(at + length < limit)
    while len(grow):
        grow = grow[data[at[grow] + length[grow]] == data[before[grow] + length[grow]]]
        length[grow] += 1
        grow = grow[at[grow] + length[grow] < limit[grow]]
    length = np.minimum(length, limit - at)
    back = at - before
    # References that go on at the same distance become one; a new one begins every 2048 samples, so that lengths stay below 4096.
    place = at - starts[strip[at]]
    begins = np.concatenate(([True], (back[1:] != back[:-1]) | (at[1:] != at[:-1] + length[:-1]) | ((place[1:] >> 11) != (place[:-1] >> 11)) | (strip[at[1:]] != strip[at[:-1]])))
    first = np.flatnonzero(begins)
    return at[first], np.add.reduceat(length, first), back[first]


def encode_grey(data: np.ndarray, offsets: np.ndarray, width: int) -> list[bytes]:
    """WebP files of grey pictures: data[offsets[k]:offsets[k+1]] are the samples of one, whole rows of `width`."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    strip = np.repeat(np.arange(n), sizes)
    present = np.bincount(strip * 256 + data, minlength=n * 256).reshape(n, 256) > 0
    # A palette of 17 colours or more, so that a pixel is one index; unused ones fill up.
    short = np.flatnonzero(present.sum(1) < 17)
    for k in short:
        present[k, np.flatnonzero(~present[k])[: 17 - present[k].sum()]] = True
    colours = present.sum(1)
    index = (np.cumsum(present, 1) - 1)[strip, data]
    at, length, back = find_repeats(data, strip, offsets)
    covered = np.zeros(len(data) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + length, -1)
    literal = np.cumsum(covered)[:-1] == 0
    starts_copy = np.zeros(len(data), bool)
    starts_copy[at] = True
    token_at = np.flatnonzero(literal | starts_copy)
    token_strip = strip[token_at]
    is_copy = starts_copy[token_at]
    len_symbol, len_extra, len_bits = prefix_of(length)
    far_symbol, far_extra, far_bits = prefix_of(back + 120)
    symbol = index[token_at]
    symbol[is_copy] = 256 + len_symbol
    greens = np.bincount(token_strip * 280 + symbol, minlength=n * 280).reshape(n, 280)
    fars = np.bincount(strip[at] * _DISTANCES + far_symbol, minlength=n * _DISTANCES).reshape(n, _DISTANCES)
    copies = fars.sum(1) > 0
    greens[:, 0] += (greens > 0).sum(1) < 2  # a second symbol where there is one only
    greens[:, 1] += (greens > 0).sum(1) < 2
    fars[:, 0] += copies & ((fars > 0).sum(1) < 2)
    fars[:, 1] += copies & ((fars > 0).sum(1) < 2)
    green_length, far_length = code_lengths(greens), np.zeros((n, _DISTANCES), np.int64)
    if copies.any():
        far_length[copies] = code_lengths(fars[copies])
    green_code, far_code = canonical_codes(green_length), canonical_codes(far_length)
    length_codes = canonical_codes(_LENGTH_CODE[None, :].astype(np.int64))[0]

    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each part: picture, value, bits; parts follow one another

    every = np.arange(n)

    def put(value: np.ndarray | int, bits: int, which: np.ndarray = every) -> None:
        fields.append((which, np.broadcast_to(np.asarray(value, np.int64), which.shape), np.full(len(which), bits, np.int64)))

    def put_lengths(which: np.ndarray, table: np.ndarray, first: np.ndarray | int, last: np.ndarray | int) -> None:
        """Code lengths of the symbols from first up to last."""
        ranks = np.arange(table.shape[1])
        row, column = np.nonzero((ranks >= np.reshape(first, (-1, 1))) & (ranks < np.reshape(last, (-1, 1))) & np.ones((len(which), 1), bool))
        own = table[which[row], column]
        fields.append((which[row], length_codes[own], _LENGTH_CODE[own].astype(np.int64)))

    def put_run(which: np.ndarray, run: np.ndarray) -> None:
        put(length_codes[18], 5, which)
        put(run - 11, 7, which)

    def put_code_head(which: np.ndarray = every) -> None:
        put(0, 1, which)
        put(15, 4, which)
        for k in CODE_LENGTH_ORDER:
            put(int(_LENGTH_CODE[k]), 3, which)

    height = sizes // width
    put(0x2F, 8)
    put(width - 1, 14)
    put(height - 1, 14)
    put(0, 4)
    put(1 | SUBTRACT_GREEN << 1, 3)  # transforms: green is added to red and blue after the palette gave it
    put(1 | PALETTE << 1, 3)
    put(colours - 1, 8)
    # The palette: no cache; a code of 256 symbols of 8 bits for green, lone zeros for the rest.
    put(0, 1)
    put(0, 1)
    put(12 - 4, 4)
    for k in CODE_LENGTH_ORDER[:12]:
        put(int(k == 8), 3)
    put(1, 1)
    put(3, 3)
    put(254, 8)
    put(0x1111, 16)
    row, value = np.nonzero(present)
    step = np.where(np.concatenate(([True], row[1:] != row[:-1])), value, value - np.concatenate(([0], value[:-1])))
    fields.append((row, reversal(8)[step], np.full(len(row), 8, np.int64)))
    put(0, 3)  # no further transform, no cache, one group of codes
    put_code_head()
    plain, coded = np.flatnonzero(~copies), np.flatnonzero(copies)
    put(1, 1, plain)
    put(3, 3, plain)
    put(colours[plain] - 2, 8, plain)
    put(0, 1, coded)
    put_lengths(plain, green_length, 0, colours[plain])
    gap = 256 - colours
    put_lengths(coded, green_length, 0, colours[coded])
    once = coded[gap[coded] >= 11]
    run = np.minimum(gap[once], 138)
    put_run(once, run)
    rest = gap.copy()
    rest[once] -= run
    twice = once[rest[once] >= 11]
    put_run(twice, rest[twice])
    rest[twice] = 0
    put_lengths(coded, green_length, 256 - rest[coded], 256)
    put_lengths(coded, green_length, 256, 280)
    put(0x111, 12)  # red, blue, alpha: lone zeros
    put(1, 4, plain)
    put_code_head(coded)
    put(0, 1, coded)
    put_lengths(coded, far_length, 0, _DISTANCES)
    # Pixels: a literal is one code, a copy four numbers side by side.
    bits = green_length[token_strip, symbol]
    value = green_code[token_strip, symbol]
    if len(at):
        far_bits_of = far_length[strip[at], far_symbol]
        shift = bits[is_copy]
        v = value[is_copy] | (len_bits << shift)
        shift = shift + len_extra
        v = v | (far_code[strip[at], far_symbol] << shift)
        shift = shift + far_bits_of
        value[is_copy] = v | (far_bits << shift)
        bits[is_copy] = shift + far_extra
    fields.append((token_strip, value, bits))

    # Where each field starts: after the same picture's fields of earlier parts, and its earlier ones of this part.
    used = np.zeros(n, np.int64)
    places = []
    for which, _, bits in fields:
        if len(which) == n and which is every:
            places.append(used.copy())
            used += bits
            continue
        ends = np.cumsum(bits)
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
        places.append(ends - bits - np.repeat((ends - bits)[first], np.diff(np.concatenate((first, [len(which)])))) + used[which])
        used += np.bincount(which, bits, n).astype(np.int64)
    n_bytes = (used + 7) // 8
    base = np.concatenate(([0], np.cumsum((n_bytes + 3) // 4 * 4 + 4)))
    # Fields don't overlap, so adding them up is exact; one of up to 56 bits meets three words of 32.
    bit = np.concatenate([8 * base[which] + place for (which, _, _), place in zip(fields, places, strict=True)])
    wide = np.concatenate([value for _, value, _ in fields]).astype(np.uint64)
    word, shift = bit >> 5, (bit & 31).astype(np.uint64)
    low = wide << shift
    size = base[-1] // 4 + 3
    out = np.bincount(word, low & np.uint64(0xFFFFFFFF), size)
    high = np.flatnonzero(low >> np.uint64(32))
    out += np.bincount(word[high] + 1, low[high] >> np.uint64(32), size)
    long = np.flatnonzero(wide >> np.uint64(32))
    over = np.where(shift[long] > 0, wide[long] >> (np.uint64(64) - np.maximum(shift[long], np.uint64(1))), np.uint64(0))
    out += np.bincount(word[long] + 2, over, size)
    packed = out.astype(np.uint32).tobytes()
    files = []
    for k in range(n):
        body = packed[base[k] : base[k] + n_bytes[k]]
        pad = len(body) & 1
        files.append(b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad)
    return files
