"""Lossless WebP (VP8L): one picture at a time, all parts of the format. `webp_batch` does many at once."""

from __future__ import annotations

import heapq

import numpy as np

# Fixed values of the format: the order of code length codes, and the places near a pixel that the first 120 distance codes stand for.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_CACHE_HASH = 0x1E35A7BD
_MOST = 16384  # pixels a side


# --- bits ---------------------------------------------------------------------------------------------------------------


class Writer:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_codes(self, codes: np.ndarray, lens: np.ndarray) -> None:
        """Many codes of up to 15 bits at once: four at a time become one number, then rows of bits."""
        short = -len(codes) % 4
        c = np.concatenate([codes.astype(np.uint64), np.zeros(short, np.uint64)]).reshape(-1, 2)
        n = np.concatenate([lens.astype(np.uint64), np.zeros(short, np.uint64)]).reshape(-1, 2)
        for _ in range(2):
            c, n = c[:, 0] | c[:, 1] << n[:, 0], n.sum(1, dtype=np.uint64)
            if len(c) > 1 and _ == 0:
                c, n = c.reshape(-1, 2), n.reshape(-1, 2)
        bits = np.unpackbits(c.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.put_bits(bits[np.arange(64) < n.astype(np.int64)[:, None]])

    def put_bits(self, bits: np.ndarray) -> None:
        head = np.array([self.value >> k & 1 for k in range(self.n)], np.uint8)
        self.parts.append(np.concatenate([head, bits]))
        self.value = self.n = 0

    def bytes(self) -> bytes:
        self.put_bits(np.zeros(0, np.uint8))
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 16, 0
        self.end = 8 * len(data)

    def get(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the image ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)


# --- prefix codes -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code, `most` bits at the longest: rare symbols count more until it fits."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), s) for s in used]
        heapq.heapify(heap)
        kids: list[tuple[int, int]] = []
        base = len(counts)
        while len(heap) > 1:
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (n + m, base + len(kids)))
            kids.append((a, b))
        depth = [0] * len(kids)
        for k in range(len(kids) - 1, -1, -1):
            for kid in kids[k]:
                if kid >= base:
                    depth[kid - base] = depth[k] + 1
                else:
                    out[kid] = depth[k] + 1
        if out.max() <= most:
            return out
        least *= 2


def canonical(lens: np.ndarray) -> np.ndarray:
    """Codes of the lengths, first bit lowest."""
    codes = np.zeros(len(lens), np.int64)
    used = np.flatnonzero(lens)
    order = used[np.argsort(lens[used], kind="stable")].tolist()
    code = last = 0
    for s in order:
        n = int(lens[s])
        code <<= n - last
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return codes


class Table:
    """Symbol and length by the next bits; a code of one symbol takes no bits."""

    def __init__(self, lens: np.ndarray | None, only: int = 0):
        """From code lengths, or for the code of `only` one symbol."""
        used = np.flatnonzero(lens) if lens is not None else ()
        if len(used) < 2:
            self.bits, self.symbols, self.lens = 0, np.array([used[0] if len(used) else only], np.uint16), np.zeros(1, np.uint8)
        else:
            self.bits = int(lens.max())
            if sum(1 << (self.bits - int(n)) for n in lens[used]) != 1 << self.bits:
                raise ValueError("a prefix code isn't complete")
            self.symbols, self.lens = np.zeros(1 << self.bits, np.uint16), np.zeros(1 << self.bits, np.uint8)
            codes = canonical(lens)
            for s in used.tolist():
                step = 1 << int(lens[s])
                self.symbols[codes[s] :: step] = s
                self.lens[codes[s] :: step] = lens[s]
        self._lists = None

    def lists(self) -> tuple[list[int], list[int]]:
        if self._lists is None:
            self._lists = self.symbols.tolist(), self.lens.tolist()
        return self._lists

    def read(self, r: Reader) -> int:
        if not self.bits:
            return int(self.symbols[0])
        peek = r.get(self.bits)
        r.at -= self.bits - int(self.lens[peek])
        return int(self.symbols[peek])


def write_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the prefix code for these counts; its codes and lengths."""
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        first = int(used[0]) if len(used) else 0
        w.put(1 | int(first > 1) << 2, 3)
        w.put(first, 8 if first > 1 else 1)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lens = code_lengths(counts, 15)
    if len(used) == 2 and used[1] < 256:
        w.put(3 | int(used[0] > 1) << 2, 3)
        w.put(int(used[0]), 8 if used[0] > 1 else 1)
        w.put(int(used[1]), 8)
        return canonical(lens), lens
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    flat, k, last = lens.tolist(), 0, 8
    end = len(flat)
    while k < end:
        n = 1
        while k + n < end and flat[k + n] == flat[k]:
            n += 1
        k += n
        value = flat[k - 1]
        if value and value != last:
            tokens.append((value, 0, 0))
            n -= 1
            last = value
        while n:
            if not value and n >= 11:
                part = min(n, 138)
                tokens.append((18, part - 11, 7))
            elif not value and n >= 3:
                part = min(n, 10)
                tokens.append((17, part - 3, 3))
            elif value and n >= 3:
                part = min(n, 6)
                tokens.append((16, part - 3, 2))
            else:
                part = 1
                tokens.append((value, 0, 0))
            n -= part
    own = np.bincount([t[0] for t in tokens], minlength=19)
    small = code_lengths(own, 7)
    codes = canonical(small)
    w.put(0, 1)
    shown = max(4, 1 + max(k for k, s in enumerate(_LENGTH_ORDER) if small[s]))
    w.put(shown - 4, 4)
    for s in _LENGTH_ORDER[:shown]:
        w.put(int(small[s]), 3)
    w.put(0, 1)
    single = np.count_nonzero(small) == 1
    for s, extra, bits in tokens:
        if not single:
            w.put(int(codes[s]), int(small[s]))
        w.put(extra, bits)
    if len(used) == 1:  # a code of one symbol takes no bits
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    return canonical(lens), lens


def read_code(r: Reader, size: int) -> Table:
    lens = np.zeros(size, np.int64)
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbols = [r.get(8 if wide else 1)] + ([r.get(8)] if two else [])
        if max(symbols) >= size:
            raise ValueError("a symbol is outside its alphabet")
        if not two:
            return Table(None, symbols[0])
        lens[symbols] = 1
        return Table(lens)
    small = np.zeros(19, np.int64)
    for s in _LENGTH_ORDER[: 4 + r.get(4)]:
        small[s] = r.get(3)
    table = Table(small)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = table.read(r)
        if s < 16:
            lens[at] = s
            last, at = s or last, at + 1
        else:
            n = 3 + r.get(2) if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
            if at + n > size:
                raise ValueError("code lengths exceed their alphabet")
            lens[at : at + n] = last if s == 16 else 0
            at += n
    return Table(lens)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and its bits, of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    extra = high - 1
    second = (value - 1) >> extra & 1
    return 2 * high + second, (value - 1) - ((2 + second) << extra), extra


# --- entropy-coded images -------------------------------------------------------------------------------------------------


def _references(pixels: np.ndarray, least: int = 3, most: int = 4096) -> list[tuple[int, int, int]]:
    """Greedy matches (position, length, distance) of repeated pixel runs, by a table of the last place of each triple."""
    data, found, last, at = pixels.tolist(), [], {}, 0
    while at < len(data):
        key = tuple(data[at : at + least])
        before, n = last.get(key), 0
        if before is not None and len(key) == least:
            while n < most and at + n < len(data) and data[before + n] == data[at + n]:
                n += 1
            found.append((at, n, at - before))
        for k in range(at, at + max(1, n)):
            last[tuple(data[k : k + least])] = k
        at += max(1, n)
    return found


def write_image(w: Writer, pixels: np.ndarray, main: bool, width: int, refs: bool = False, cache_bits: int = 0, meta_bits: int = 0) -> None:
    """Write ARGB pixels (unsigned 32-bit, in rows) as one entropy-coded image.

    refs: use back-references; cache_bits: use a colour cache; meta_bits: with
    `main`, give every second block of that size a group of codes of its own.
    """
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    n, height = len(pixels), -(-len(pixels) // width)
    groups, group_of = 1, None
    if main:
        w.put(1 if meta_bits else 0, 1)
        if meta_bits:
            w.put(meta_bits - 2, 3)
            wide, high = -(-width >> meta_bits) * -1, -(-height >> meta_bits) * -1
            wide, high = -(-width // (1 << meta_bits)), -(-height // (1 << meta_bits))
            which = (np.arange(wide * high) % 2).astype(np.uint32)
            write_image(w, 0xFF000000 | which << 8, False, wide)
            y, x = np.divmod(np.arange(n), width)
            group_of, groups = which[(y >> meta_bits) * wide + (x >> meta_bits)], int(which.max()) + 1
    g, r, b, a = (pixels >> 8 & 255).astype(np.int64), (pixels >> 16 & 255).astype(np.int64), (pixels & 255).astype(np.int64), (pixels >> 24).astype(np.int64)
    if not refs and not cache_bits and group_of is None:  # literals only, all at once
        pairs = [write_code(w, np.bincount(c, minlength=size)) for c, size in ((g, 280), (r, 256), (b, 256), (a, 256))]
        write_code(w, np.zeros(40, np.int64))
        coded = [(codes[c], lens[c]) for (codes, lens), c in zip(pairs, (g, r, b, a), strict=True) if lens.any()]
        if coded:
            w.put_codes(np.stack([c for c, _ in coded], 1).ravel(), np.stack([x for _, x in coded], 1).ravel())
        return
    # tokens: (group, "l", pixel) or (group, "c", index) or (group, "r", length, distance)
    cache, tokens, at = {}, [], 0
    matches = {at: (m, d) for at, m, d in _references(pixels)} if refs else {}
    data = pixels.tolist()
    while at < n:
        group = int(group_of[at]) if group_of is not None else 0
        if at in matches:
            m, d = matches[at]
            tokens.append((group, "r", m, d))
        else:
            m, key = 1, (_CACHE_HASH * data[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append((group, "c", key) if cache_bits and cache.get(key) == data[at] else (group, "l", data[at]))
        if cache_bits:
            for p in data[at : at + m]:
                cache[(_CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += m
    green = 280 + (1 << cache_bits if cache_bits else 0)
    counts = [[np.zeros(s, np.int64) for s in (green, 256, 256, 256, 40)] for _ in range(groups)]
    for t in tokens:
        own = counts[t[0]]
        if t[1] == "l":
            for which, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                own[which][t[2] >> shift & 255] += 1
        elif t[1] == "c":
            own[0][280 + t[2]] += 1
        else:
            own[0][256 + _prefix(t[2])[0]] += 1
            own[4][_prefix(t[3] + 120)[0]] += 1
    codes = [[write_code(w, c) for c in own] for own in counts]
    for t in tokens:
        own = codes[t[0]]
        if t[1] == "l":
            for which, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                s = t[2] >> shift & 255
                w.put(int(own[which][0][s]), int(own[which][1][s]))
        elif t[1] == "c":
            w.put(int(own[0][0][280 + t[2]]), int(own[0][1][280 + t[2]]))
        else:
            for which, base, value in ((0, 256, t[2]), (4, 0, t[3] + 120)):
                s, extra, bits = _prefix(value)
                w.put(int(own[which][0][base + s]), int(own[which][1][base + s]))
                w.put(extra, bits)


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels of one entropy-coded image."""
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of, groups, meta_bits, wide = None, 1, 0, 0
    if main and r.get(1):
        meta_bits = r.get(3) + 2
        wide = -(-width // (1 << meta_bits))
        which = read_image(r, wide, -(-height // (1 << meta_bits)), False) >> 8 & 0xFFFF
        group_of, groups = which.tolist(), int(which.max()) + 1
    green = 280 + (1 << cache_bits if cache_bits else 0)
    codes = [[read_code(r, s) for s in (green, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    out, cache = [], [0] * (1 << cache_bits)
    mask, tables, at = (1 << 15) - 1, [[(*t.lists(), (1 << t.bits) - 1) for t in own] for own in codes], 0
    data, bit = r.data, r.at
    end = r.end + 64

    def symbol(table) -> int:
        nonlocal bit
        symbols, lens, low = table
        peek = int.from_bytes(data[bit >> 3 : (bit >> 3) + 4], "little") >> (bit & 7) & mask & low
        bit += lens[peek]
        return symbols[peek]

    def value(code: int) -> int:
        nonlocal bit
        if code < 4:
            return code + 1
        extra = (code - 2) >> 1
        got = int.from_bytes(data[bit >> 3 : (bit >> 3) + 5], "little") >> (bit & 7) & ((1 << extra) - 1)
        bit += extra
        return ((2 + (code & 1)) << extra) + got + 1

    while at < n:
        if bit > end:
            raise ValueError("the image ends early")
        own = tables[group_of[(at // width >> meta_bits) * wide + (at % width >> meta_bits)]] if group_of is not None else tables[0]
        s = symbol(own[0])
        if s < 256:
            red = symbol(own[1])
            blue = symbol(own[2])
            new = [symbol(own[3]) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = value(s - 256)
            code = value(symbol(own[4]))
            if code > 120:
                back = code - 120
            else:
                dx, dy = _NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
            new = None
        else:
            new = [cache[s - 280]]
        if new:
            out += new
        if cache_bits:
            for p in out[at:]:
                cache[(_CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at = len(out)
    r.at = bit
    return np.array(out, np.uint32)


# --- transforms -----------------------------------------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) alpha, red, green, blue of ARGB pixels."""
    return np.stack([pixels >> 24, pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], -1).astype(np.int64)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The value that a predictor mode gives from the neighbours (left, top, top right, top left)."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (inverse) or subtract the predictions of a picture; `modes` holds a mode for each block."""
    height, wide = len(pixels) // width, -(-width // (1 << bits))
    given = _channels(pixels).tolist()
    full, out = (out := []) if inverse else given, out if inverse else []
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if not at:
                p = [255, 0, 0, 0]
            elif not y:
                p = full[at - 1]
            elif not x:
                p = full[at - width]
            else:
                p = _predict(int(modes[(y >> bits) * wide + (x >> bits)]), full[at - 1], full[at - width], full[at - width + 1], full[at - width - 1])
            out.append([(v + q if inverse else v - q) & 255 for v, q in zip(given[at], p, strict=True)])
    return _argb(np.array(out))


def _cross_color(pixels: np.ndarray, width: int, codes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (inverse) or take away what red and blue owe to green, and blue to red, by block."""
    height, wide = len(pixels) // width, -(-width // (1 << bits))
    y, x = np.divmod(np.arange(height * width), width)
    own = codes[(y >> bits) * wide + (x >> bits)]
    signed = lambda v: ((v.astype(np.int64) & 255) ^ 128) - 128
    c = _channels(pixels)
    green, sign = signed(c[:, 2]), 1 if inverse else -1
    red = c[:, 1] + sign * (signed(own) * green >> 5)
    full_red = red if inverse else c[:, 1]
    blue = c[:, 3] + sign * ((signed(own >> 8) * green >> 5) + (signed(own >> 16) * signed(full_red) >> 5))
    return _argb(np.stack([c[:, 0], red, c[:, 2], blue], -1))


def _bundle(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


# --- files ----------------------------------------------------------------------------------------------------------------


def encode(pixels: np.ndarray, transforms: tuple[str, ...] = ("palette",), refs: bool = False, cache_bits: int = 0, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of pixels: (height, width, 4) red, green, blue, alpha, or (height, width) samples, which become the green channel.

    transforms, in order: any of predictor, cross_color, subtract_green and
    palette (last, where at most 256 colours occur).
    """
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    height, width = pixels.shape[:2]
    if not (0 < height <= _MOST and 0 < width <= _MOST):
        raise ValueError("a side has no pixel or more than the format allows")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    grey = pixels.ndim == 2
    if grey:
        argb = None if transforms == ("palette",) else 0xFF000000 | pixels.ravel().astype(np.uint32) << np.uint32(8)
    else:
        flat = pixels.reshape(-1, 4)
        argb = _argb(flat[:, [3, 0, 1, 2]].astype(np.int64))
    w.put(int(not grey), 1)
    w.put(0, 3)
    at = width
    for kind in transforms:
        w.put(1, 1)
        if kind == "predictor":
            bits = 3
            blocks = -(-width // 8) * -(-height // 8)
            modes = np.arange(blocks) % 14
            w.put(0, 2)
            w.put(bits - 2, 3)
            write_image(w, 0xFF000000 | modes.astype(np.uint32) << 8, False, -(-width // 8))
            argb = _predictor(argb, width, modes, bits, False)
        elif kind == "cross_color":
            blocks = -(-width // 8) * -(-height // 8)
            codes = (np.arange(blocks, dtype=np.uint32) * 0x0B0D11 + 0x102030) & 0xFFFFFF
            w.put(1, 2)
            w.put(1, 3)
            write_image(w, 0xFF000000 | codes, False, -(-width // 8))
            argb = _cross_color(argb, width, codes, 3, False)
        elif kind == "subtract_green":
            w.put(2, 2)
            c = _channels(argb)
            argb = _argb(c - c[:, 2:3] * np.array([0, 1, 0, 1]))
        else:
            if argb is None:
                used = np.flatnonzero(np.bincount(pixels.ravel(), minlength=256))
                place = np.zeros(256, np.uint8)
                place[used] = np.arange(len(used))
                index, colours = place[pixels.ravel()], 0xFF000000 | used.astype(np.uint32) << np.uint32(8)
            else:
                colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette holds 256 colours at most")
            w.put(3, 2)
            w.put(len(colours) - 1, 8)
            write_image(w, _argb(np.diff(_channels(colours), axis=0, prepend=0)), False, len(colours))
            bundle = _bundle(len(colours))
            each = 1 << bundle
            at = -(-width // each)
            rows = np.zeros((height, at * each), np.uint32)
            rows[:, :width] = index.reshape(height, width)
            packed = (rows.reshape(height, at, each) << (np.arange(each, dtype=np.uint32) * np.uint32(8 >> bundle))).sum(2, dtype=np.uint32)
            argb = 0xFF000000 | packed.ravel() << 8
    w.put(0, 1)
    write_image(w, argb.astype(np.uint32), True, at, refs, cache_bits, meta_bits)
    body = w.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def decode(media: bytes) -> np.ndarray:
    """(height, width, 4) red, green, blue, alpha of a lossless WebP file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("this is no WebP file")
    at, body = 12, None
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"VP8L":
            body = media[at + 8 : at + 8 + size]
            break
        at += 8 + size + size % 2
    if not body or body[0] != 0x2F:
        raise ValueError("the file has no lossless image")
    r = Reader(body)
    r.get(8)
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("the version isn't known")
    undo, wide = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform occurs twice")
        if kind in (0, 1):
            bits = r.get(3) + 2
            data = read_image(r, -(-wide // (1 << bits)), -(-height // (1 << bits)), False)
            undo.append((kind, bits, data, wide))
        elif kind == 2:
            undo.append((kind,))
        else:
            size = r.get(8) + 1
            colours = _argb(np.cumsum(_channels(read_image(r, size, 1, False)), axis=0))
            undo.append((kind, colours, _bundle(size), wide))
            wide = -(-wide // (1 << _bundle(size)))
    argb = read_image(r, wide, height, True)
    for step in reversed(undo):
        if step[0] == 0:
            argb = _predictor(argb, step[3], step[2] >> 8 & 15, step[1], True)
        elif step[0] == 1:
            argb = _cross_color(argb, step[3], step[2], step[1], True)
        elif step[0] == 2:
            c = _channels(argb)
            argb = _argb(c + c[:, 2:3] * np.array([0, 1, 0, 1]))
        else:
            _, colours, bundle, wide = step
            index = argb >> 8 & 255
            if bundle:
                low = np.uint32((1 << (8 >> bundle)) - 1)
                index = (index[:, None] >> (np.arange(1 << bundle, dtype=np.uint32) * np.uint32(8 >> bundle)) & low).reshape(height, -1)[:, :wide].ravel()
            table = np.zeros(256, np.uint32)
            table[: len(colours)] = colours
            argb = table[index]
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], -1).astype(np.uint8).reshape(height, width, 4)
