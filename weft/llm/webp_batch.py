"""Many lossless WebP pictures at once: every step of the writer and the reader works on all of them side by side.

Prefix codes, back-references and colour caches force a reader to go pixel by
pixel. Here step t handles pixel t of every picture, with one array operation
for all, so the price of Python is shared by the batch. Pictures with parts
that the batch doesn't hold (groups of codes, other predictor modes, palettes)
go through the plain codec of `lossless_webp`.
"""

from __future__ import annotations

import numpy as np

from weft.llm.lossless_webp import _CACHE_HASH, _LENGTH_ORDER, _NEAR, Reader, decode, read_image

_U = np.uint64
_LONGEST = 12  # bits of a code that this writer makes
_REVERSED = np.array([int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)], np.int64)
#: Ways to take a picture: as it is, less its green, less its left or its upper neighbours.
PLAIN, GREEN, LEFT, TOP = range(4)


# --- prefix codes -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for each row of counts, `most` bits at the longest: two queues, all rows in step."""
    n, size = counts.shape
    used = (counts > 0).sum(1)
    out = np.zeros((n, size), np.int64)
    one = used == 1
    out[one, counts[one].argmax(1)] = 1
    todo, least = np.flatnonzero(used > 1), 1
    while len(todo):
        c = counts[todo]
        c = np.where(c > 0, np.maximum(c, least), np.iinfo(np.int64).max >> 8)
        u, rows = used[todo], np.arange(len(todo))
        wide = int(u.max())
        order = np.argsort(c, axis=1, kind="stable")[:, :wide]
        none = np.iinfo(np.int64).max >> 4
        leaf = np.concatenate([np.take_along_axis(c, order, 1), np.full((len(todo), 1), none)], 1)
        leaf[np.arange(wide + 1) >= u[:, None]] = none
        node = np.full((len(todo), wide + 1), none)
        leaf_parent, node_parent = np.zeros((len(todo), wide + 1), np.int64), np.zeros((len(todo), wide + 1), np.int64)
        i, j = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        for step in range(wide - 1):
            rows = rows[step < u[rows] - 1]
            total = 0
            for _ in range(2):
                a, b = leaf[rows, i[rows]], node[rows, j[rows]]
                by_leaf = a <= b
                total = total + np.where(by_leaf, a, b)
                x, y = rows[by_leaf], rows[~by_leaf]
                leaf_parent[x, i[x]] = step
                node_parent[y, j[y]] = step
                i[x] += 1
                j[y] += 1
            node[rows, step] = total
        depth, rows = np.zeros((len(todo), wide + 1), np.int64), np.arange(len(todo))
        for step in range(wide - 3, -1, -1):
            own = rows[step < u - 2]
            depth[own, step] = depth[own, node_parent[own, step]] + 1
        lens = np.take_along_axis(depth, leaf_parent[:, :wide], 1) + 1
        lens[np.arange(wide) >= u[:, None]] = 0
        found = np.zeros_like(c)
        np.put_along_axis(found, order, lens, 1)
        fits = found.max(1) <= most
        out[todo[fits]] = found[fits]
        todo, least = todo[~fits], least * 2
    return out


def _sorted_symbols(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, symbol, length) of all used symbols, in the order of canonical codes."""
    row, symbol = np.nonzero(lens)
    size = lens[row, symbol]
    order = np.argsort(row * 16 + size, kind="stable")
    return row[order], symbol[order], size[order]


def canonical(lens: np.ndarray) -> np.ndarray:
    """Codes of each row of lengths, first bit lowest."""
    row, symbol, size = _sorted_symbols(lens)
    # a code is what the codes before it take of the 15-bit space
    span = 1 << (15 - size)
    before = np.cumsum(span) - span
    first = np.searchsorted(row, np.arange(len(lens)))
    before = before - before[np.minimum(first, len(before) - 1)][row] if len(row) else before
    codes = np.zeros(lens.shape, np.int64)
    codes[row, symbol] = _REVERSED[before & 0x7FFF]
    return codes


class Tables:
    """Symbol and length by the next bits, for a code of each picture; a code of one symbol takes no bits."""

    def __init__(self, lens: np.ndarray):
        used = (lens > 0).sum(1)
        row, symbol, size = _sorted_symbols(lens)
        single = used[row] == 1
        self.bits = bits = int(size[~single].max()) if (~single).any() else 0
        span = np.where(single, 1 << bits, 1 << np.maximum(bits - size, 0))
        whole = np.bincount(row, span, len(lens))
        if (whole != 1 << bits).any():
            raise ValueError("a prefix code isn't complete")
        self.table = np.repeat((symbol << 4 | np.where(single, 0, size)).astype(np.uint16), span)
        self.reversed = _REVERSED[: 1 << bits] >> (15 - bits)
        self.low = np.uint64((1 << bits) - 1)

    def look(self, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, bits taken) of the codes at the low end of words."""
        if not self.bits:
            found = self.table[rows].astype(np.int64)
        else:
            found = self.table[(rows << self.bits) + self.reversed[(words & self.low).astype(np.int64)]].astype(np.int64)
        return found >> 4, found & 15


# --- writing ------------------------------------------------------------------------------------------------------------


def _steps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, extra value and its bits, of lengths or distances from 1."""
    x = values - 1
    high = np.maximum(np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1, 1)
    extra = high - 1
    second = x >> extra & 1
    small = values <= 4
    return np.where(small, x, 2 * high + second), np.where(small, 0, x - ((2 + second) << extra)), np.where(small, 0, extra)


class Emission:
    """Bits of many pictures: pieces of up to 32 bits each, by segments that follow one another in every picture."""

    def __init__(self, n: int):
        self.n, self.segments = n, []
        self.size = np.zeros(n, np.int64)

    def put(self, owner: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """A segment: pieces of pictures, in the order of the pictures."""
        end = np.cumsum(bits)
        own = np.bincount(owner, bits, self.n).astype(np.int64)
        start = np.cumsum(own) - own
        self.segments.append((owner, value.astype(np.uint64), bits, end - bits - start[owner] + self.size[owner]))
        self.size += own

    def every(self, value: int | np.ndarray, bits: int | np.ndarray) -> None:
        """One piece for each picture."""
        self.put(np.arange(self.n), np.broadcast_to(np.asarray(value, np.int64), self.n), np.broadcast_to(np.asarray(bits, np.int64), self.n))

    def bodies(self) -> list[bytes]:
        whole = -(-self.size // 32)  # 32-bit words
        base = np.cumsum(whole) - whole
        words = np.zeros(int(whole.sum()) + 2, np.uint64)
        for owner, value, _, at in self.segments:
            at = at + 32 * base[owner]
            moved, word = value << (at & 31).astype(np.uint64), at >> 5
            np.add.at(words, word, moved & _U(0xFFFFFFFF))
            np.add.at(words, word + 1, moved >> _U(32))
        raw = words.astype("<u4").tobytes()
        return [raw[4 * b : 4 * b + -(-s // 8)] for b, s in zip(base.tolist(), self.size.tolist(), strict=True)]


def _put_codes(out: Emission, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the prefix code of each row of counts; codes and lengths (0 where a symbol stands alone)."""
    n, size = counts.shape
    lens = code_lengths(counts, _LONGEST)
    used, top = (counts > 0).sum(1), np.where(counts > 0, np.arange(size), -1).max(1)
    simple = (used <= 1) & (top < 256)
    first = np.maximum(top, 0)
    out.every(np.where(simple, 1 | (first > 1) << 2, 0), np.where(simple, 3, 1))
    out.every(np.where(simple, first, 0), np.where(simple, np.where(first > 1, 8, 1), 0))
    full = np.flatnonzero(~simple)
    if len(full):
        # tokens: a length, or a stretch of zeros (17: 3 to 10, 18: 11 to 138)
        flat = lens[full].ravel()
        zero = flat == 0
        begin = ~zero
        begin[1:] |= ~zero[:-1]
        begin[::size] = True
        at = np.flatnonzero(begin)
        run = np.diff(np.append(at, len(flat)))
        value, owner = flat[at], full[at // size]
        whole, rest = np.where(value == 0, run // 138, 0), np.where(value == 0, run % 138, 1)
        tail = np.where(value > 0, 1, np.where(rest >= 3, 1, rest))
        times = whole + tail
        which = np.repeat(np.arange(len(at)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        v, r = value[which], rest[which]
        long = nth < whole[which]
        token = np.where(v > 0, v, np.where(long | (r >= 11), 18, np.where(r >= 3, 17, 0)))
        extra = np.where(token == 18, np.where(long, 138, r) - 11, np.where(token == 17, r - 3, 0))
        extra_bits = np.where(token == 18, 7, np.where(token == 17, 3, 0))
        whose = owner[which]
        own = np.bincount(whose * 19 + token, minlength=n * 19).reshape(n, 19)
        small = code_lengths(own, 7)
        codes, alone = canonical(small), (own > 0).sum(1) == 1
        order = np.array(_LENGTH_ORDER)
        shown = np.maximum(4, np.where(small[:, order] > 0, np.arange(1, 20), 0).max(1))
        out.every(np.where(simple, 0, shown - 4), np.where(simple, 0, 4))
        k, place = np.nonzero((np.arange(19) < shown[:, None]) & ~simple[:, None])
        out.put(k, small[k, order[place]], np.full(len(k), 3))
        out.every(0, np.where(simple, 0, 1))
        bits = np.where(alone[whose], 0, small[whose, token])
        out.put(whose, np.where(alone[whose], 0, codes[whose, token]) | extra << bits, bits + extra_bits)
    lens = np.where((used == 1)[:, None], 0, lens)
    return canonical(lens), lens


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """Bits that the symbols of each row take at their entropy, and about 4 for each used one in the header."""
    total = np.maximum(counts.sum(-1, keepdims=True), 1)
    return -(counts * np.log2(np.maximum(counts, 1) / total)).sum(-1) + 4.0 * (counts > 0).sum(-1)


def _histogram(owner: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(owner * size + values, minlength=n * size).reshape(n, size)


def _split(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Green, red and blue."""
    return (pixels >> 8 & 255).astype(np.int64), (pixels >> 16 & 255).astype(np.int64), (pixels & 255).astype(np.int64)


def _join(red: np.ndarray, green: np.ndarray, blue: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return alpha << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue


def _less(channels: list[np.ndarray], way: int, width: int, place: np.ndarray) -> list[np.ndarray]:
    """What a way leaves of 8-bit channels (green, red, blue); `place` is the place of each pixel in its picture."""
    g, r, b = channels
    if way == PLAIN:
        return channels
    if way == GREEN:
        return [g, r - g, b - g]
    if way == LEFT:
        back = np.where(place % width > 0, 1, np.where(place > 0, width, 0))
    else:
        back = np.where(place >= width, width, np.where(place > 0, 1, 0))
    at = np.flatnonzero(back)
    from_, out = at - back[at], []
    for c in channels:
        left = c.copy()
        left[at] -= c[from_]
        out.append(left)
    return out


def encode_many(pictures: list[np.ndarray], cache_bits: int = 8) -> list[bytes]:
    """Lossless WebP files of opaque pictures (height, width, 3) of one width, rows of red, green and blue.

    For each picture the writer takes the cheapest by entropy: as it is, less
    green, or predicted from the left or the upper neighbour; and with or
    without a colour cache. Runs of three pixels that stood before become
    back-references.
    """
    if not pictures:
        return []
    n, width = len(pictures), pictures[0].shape[1]
    size = np.array([p.shape[0] * width for p in pictures])
    owner = np.repeat(np.arange(n, dtype=np.int32), size)  # 32 bits: the arrays of a batch are what its time goes into
    offset = (np.cumsum(size) - size).astype(np.int32)
    place = np.arange(len(owner), dtype=np.int32) - offset[owner]
    flat = np.concatenate([p.reshape(-1, 3) for p in pictures])
    channels = [np.ascontiguousarray(flat[:, k]) for k in (1, 0, 2)]
    del flat

    # the way of each picture
    cost, ways, rows = np.empty((4, n)), [], owner * 256
    for way in (PLAIN, GREEN, LEFT, TOP):
        ways.append(_less(channels, way, width, place))
        cost[way] = sum(_bits_of(np.bincount(rows + c, minlength=n * 256).reshape(n, 256)) for c in ways[way]) + (way != PLAIN) * 40
    chosen = cost.argmin(0)
    for way in (GREEN, LEFT, TOP):
        if (chosen == way).any():
            mine = chosen[owner] == way
            channels = [np.where(mine, c, own) for c, own in zip(ways[way], channels, strict=True)]
    del ways, rows
    pixels = _join(*(channels[k].astype(np.uint32) for k in (1, 0, 2)), np.where(np.isin(chosen, (LEFT, TOP)), 0, 255).astype(np.uint32)[owner])

    # where the run of three pixels at each place stood before, and how far the run goes on
    triple = pixels[:-2].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + pixels[1:-1] * _U(0xC2B2AE3D27D4EB4F) + pixels[2:] * _U(0x165667B19E3779F9)
    before = _earlier(triple ^ triple >> _U(29), owner[:-2], place[:-2])
    before = np.append(before, np.zeros(2, np.int32)) if len(pixels) > 2 else np.zeros(len(pixels), np.int32)
    before[size[owner] - place < 3] = 0
    at = np.flatnonzero(before)
    same = np.ones(len(at), bool)
    for k in range(3):
        same &= pixels[at + k] == pixels[at + k - before[at]]
    before[at[~same]] = 0
    turn = np.ones(len(before), bool)  # the distance changes after this place
    turn[:-1] = (before[1:] != before[:-1]) | (owner[1:] != owner[:-1])
    ends = np.flatnonzero(turn).astype(np.int32)
    run = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(before), dtype=np.int32) + 3
    run[before == 0] = 0
    # greedy, all pictures in step: 0 inside a copy, 1 a pixel, 2 a copy
    kind, left, order = np.zeros(len(pixels), np.int8), np.zeros(n, np.int32), np.argsort(-size, kind="stable")
    sizes, offsets = size[order], offset[order]
    for t in range(int(size.max())):
        m = int(np.searchsorted(-sizes, -t, "left"))
        here, open_ = offsets[:m] + t, left[:m]
        long = run[here]
        free = open_ == 0
        start = free & (long > 0)
        kind[here] = free.astype(np.int8) + start
        left[:m] = np.where(start, long - 1, np.maximum(open_ - 1, 0))

    single, copied = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    # a pixel that its place in the cache holds
    key = (pixels.astype(np.uint64) * _U(_CACHE_HASH) & _U(0xFFFFFFFF)) >> _U(32 - cache_bits)
    last = _earlier(key, owner, place)
    held = np.flatnonzero(last)
    held = held[pixels[held - last[held]] == pixels[held]]
    held = np.bincount(held, minlength=len(pixels)).astype(bool)
    codes = _split(pixels[single])
    alone = [_histogram(owner[single], c, n, 256) for c in codes]
    miss = single[~held[single]]
    rest = [_histogram(owner[miss], c, n, 256) for c in _split(pixels[miss])]
    hit = single[held[single]]
    by_key = _histogram(owner[hit], key[hit].astype(np.int64), n, 1 << cache_bits)
    cached = _bits_of(np.concatenate([rest[0], by_key], 1)) + _bits_of(rest[1]) + _bits_of(rest[2]) < sum(map(_bits_of, alone))

    length, more, more_bits = _steps(run[copied])
    distance = np.arange(int(before.max(initial=0)) + 1) + 120
    for k, (dx, dy) in reversed(list(enumerate(_NEAR, 1))):
        if 0 < dx + dy * width < len(distance):
            distance[dx + dy * width] = k
    far, further, further_bits = _steps(distance[before[copied]])
    mine = owner[copied]
    green = np.zeros((n, 280 + (1 << cache_bits)), np.int64)
    green[:, :256] = np.where(cached[:, None], rest[0], alone[0])
    green[:, 256:280] = _histogram(mine, length, n, 24)
    green[:, 280:] = np.where(cached[:, None], by_key, 0)

    out = Emission(n)
    out.every(0x2F, 8)
    out.every(width - 1, 14)
    out.every(size // width - 1, 14)
    out.every(0, 4)  # opaque, version 0
    predicted = np.isin(chosen, (LEFT, TOP))
    # a transform; of a predictor the size of its blocks and a picture of one pixel for one mode
    out.every(np.where(chosen == GREEN, 0b101, np.where(predicted, 0b001 | 7 << 3, 0)), np.where(chosen == GREEN, 3, np.where(predicted, 6, 0)))
    mode = np.where(chosen == TOP, 2 << 3 | 0b101, 1 << 3 | 0b001)  # one simple code for green
    out.every(np.where(predicted, mode << 1, 0), np.where(chosen == TOP, 1 + 11, np.where(predicted, 1 + 4, 0)))
    out.every(np.where(predicted, 0b0001 | 0b0001 << 4, 0), np.where(predicted, 8, 0))  # red, blue: 0
    out.every(np.where(predicted, 255 << 3 | 0b101, 0), np.where(predicted, 11, 0))  # alpha: 255
    out.every(np.where(predicted, 0b0001, 0), np.where(predicted, 4, 0))  # distances: none
    out.every(0, 1)
    out.every(np.where(cached, 1 | cache_bits << 1, 0), np.where(cached, 5, 1))
    out.every(0, 1)
    # the alphabet of green ends where the cache does: without one its codes have no further zeros
    written = [_put_green(out, green, cached), _put_codes(out, np.where(cached[:, None], rest[1], alone[1])), _put_codes(out, np.where(cached[:, None], rest[2], alone[2]))]
    opaque = np.zeros((n, 256), np.int64)
    opaque[np.arange(n), np.where(predicted, 0, 255)] = 1
    _put_codes(out, opaque)
    written.append(_put_codes(out, _histogram(mine, far, n, 40)))

    tokens = np.flatnonzero(kind > 0)
    whose, is_copy = owner[tokens], kind[tokens] == 2
    from_cache = held[tokens] & cached[whose] & ~is_copy
    g, r, b = _split(pixels[tokens])
    copy = np.maximum(np.cumsum(is_copy) - 1, 0)
    symbol = np.where(is_copy, 256 + (length[copy] if len(copied) else 0), np.where(from_cache, 280 + key[tokens].astype(np.int64), g))
    pick = lambda which, s: (written[which][0][whose, s], written[which][1][whose, s])
    (v0, n0), (v1, n1), (v2, n2) = pick(0, symbol), pick(1, r), pick(2, b)
    if len(copied):
        v3, n3 = pick(3, far[copy])
        v1, n1 = np.where(is_copy, more[copy], v1), np.where(is_copy, more_bits[copy], n1)
        v2, n2 = np.where(is_copy, v3 | further[copy] << n3, v2), np.where(is_copy, n3 + further_bits[copy], n2)
    v1, n1, v2, n2 = (np.where(from_cache, 0, c) for c in (v1, n1, v2, n2))
    out.put(np.repeat(whose, 2), np.stack([v0 | v1 << n0, v2], 1).ravel(), np.stack([n0 + n1, n2], 1).ravel())
    files = []
    for body in out.bodies():
        chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
        files.append(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
    return files


def _put_green(out: Emission, counts: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_put_codes`, over 280 symbols for pictures without a cache: the zeros beyond aren't theirs."""
    codes, lens = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
    for own, size in ((np.flatnonzero(~cached), 280), (np.flatnonzero(cached), counts.shape[1])):
        if len(own):
            part = Emission(len(own))
            codes[own, :size], lens[own, :size] = _put_codes(part, counts[own, :size])
            for owner, value, bits, at in part.segments:
                out.segments.append((own[owner], value, bits, at + out.size[own[owner]]))
            out.size[own] += part.size
    return codes, lens


def _earlier(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How far back in its picture each place's key last stood; 0 where it didn't."""
    found = np.zeros(len(key), np.int32)
    if not len(key):
        return found
    wide = int(place.max()).bit_length()
    high = int(owner.max()).bit_length()
    low = 64 - wide - high
    mixed = (key.astype(np.uint64) & _U((1 << min(low, 63)) - 1)) << _U(wide) | place.astype(np.uint64)
    mixed |= owner.astype(np.uint64) << _U(min(63, wide + low)) if high else _U(0)
    mixed.sort()
    at = (mixed & _U((1 << wide) - 1)).astype(np.int64)
    alike = np.zeros(len(mixed), bool)
    alike[1:] = mixed[1:] >> _U(wide) == mixed[:-1] >> _U(wide)
    second = np.flatnonzero(alike)
    first_of = np.searchsorted(owner, np.arange(int(owner[-1]) + 1))
    who = (mixed[second] >> _U(min(63, wide + low))).astype(np.int64) if high else np.zeros(len(second), np.int64)
    found[first_of[who] + at[second]] = at[second] - at[second - 1]
    return found


# --- reading ------------------------------------------------------------------------------------------------------------


class Words:
    """Bits of many files behind one another, read 57 at a time at any place."""

    def __init__(self, files: list[bytes]):
        data = np.frombuffer(b"".join(files) + b"\0" * 16, np.uint8)
        self.words = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))

    def at(self, bit: np.ndarray) -> np.ndarray:
        return self.words[bit >> 3] >> (bit & 7).astype(np.uint64)


def _low(words: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
    return (words & ((_U(1) << np.asarray(bits).astype(np.uint64)) - _U(1))).astype(np.int64)


def _read_codes(words: Words, bit: np.ndarray, sizes: np.ndarray) -> Tables:
    """One prefix code of each picture, of alphabets of `sizes`; `bit` moves on."""
    n, lens = len(bit), np.zeros((len(bit), int(sizes.max())), np.int64)
    w = words.at(bit)
    simple = _low(w, 1) == 1
    two, wide = _low(w >> _U(1), 1), _low(w >> _U(2), 1)
    first_bits = np.where(wide == 1, 8, 1)
    first = _low(w >> _U(3), first_bits)
    second = _low(w >> (3 + first_bits).astype(np.uint64), 8)
    own = np.flatnonzero(simple)
    pair = own[two[own] == 1]
    if (first[own] >= sizes[own]).any() or (second[pair] >= sizes[pair]).any():
        raise ValueError("a symbol is outside its alphabet")
    lens[own, first[own]] = 1
    lens[pair, second[pair]] = 1
    bit += np.where(simple, 3 + first_bits + 8 * two, 1)
    full = np.flatnonzero(~simple)
    if len(full):
        at = bit[full]
        shown = 4 + _low(words.at(at), 4)
        at += 4
        small = np.zeros((len(full), 19), np.int64)
        w, w2 = words.at(at), words.at(at + 30)
        for k, symbol in enumerate(_LENGTH_ORDER):
            small[:, symbol] = np.where(k < shown, _low((w >> _U(3 * k)) if k < 10 else (w2 >> _U(3 * k - 30)), 3), 0)
        at += 3 * shown
        table = Tables(small)
        w = words.at(at)
        limited = _low(w, 1) == 1
        count_bits = 2 + 2 * _low(w >> _U(1), 3)
        left = np.where(limited, 2 + _low(w >> _U(4), count_bits), sizes[full])
        at += np.where(limited, 4 + count_bits, 1)
        place, last, most = np.zeros(len(full), np.int64), np.full(len(full), 8), sizes[full]
        rows = np.arange(len(full))
        while True:
            rows = rows[(place[rows] < most[rows]) & (left[rows] > 0)]
            if not len(rows):
                break
            left[rows] -= 1
            w = words.at(at[rows])
            s, used = table.look(rows, w)
            w = w >> used.astype(np.uint64)
            own = rows[s < 16]
            value = s[s < 16]
            lens[full[own], place[own]] = value
            last[own] = np.where(value > 0, value, last[own])
            extra = np.where(s == 16, 2, np.where(s == 17, 3, np.where(s == 18, 7, 0)))
            times = np.where(s < 16, 1, np.where(s == 18, 11, 3) + _low(w, extra))
            if (place[rows] + times > most[rows]).any():
                raise ValueError("code lengths exceed their alphabet")
            again = s == 16
            for k in range(int(times[again].max(initial=0))):
                own = rows[again & (k < times)]
                lens[full[own], place[own] + k] = last[own]
            place[rows] += times
            at[rows] += used + extra
        bit[full] = at
    empty = (lens > 0).sum(1) == 0  # a code without symbols stands for its first
    lens[empty, 0] = 1
    return Tables(lens)


def _values(words: Words, bit: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix codes, whose extra bits are at `bit`; the bits they take."""
    extra = np.maximum((codes - 2) >> 1, 0)
    got = _low(words.at(bit), extra)
    return np.where(codes < 4, codes + 1, ((2 + (codes & 1)) << extra) + got + 1), np.where(codes < 4, 0, extra)


def _read_pixels(words: Words, bit: np.ndarray, end: np.ndarray, size: np.ndarray, width: int, cache_bits: np.ndarray) -> np.ndarray:
    """(pixels, pictures) of entropy-coded pictures, the largest first."""
    n, most = len(size), int(size.max())
    green, red, blue, alpha, far = (_read_codes(words, bit, sizes) for sizes in (280 + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(n, 256)] * 3, np.full(n, 40)))
    out = np.zeros((most, n), np.uint32)
    left, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    deep = int(cache_bits.max())
    cache = np.zeros(n << deep, np.uint32)
    shift, every = (32 - cache_bits).astype(np.uint64), np.arange(n)
    near = np.array([max(1, dx + dy * width) for dx, dy in _NEAR])
    active = np.searchsorted(-size, -np.arange(most), "left").tolist()
    for t in range(most):
        m = active[t]
        row, open_ = out[t], left[:m]
        rows = np.flatnonzero(open_ == 0)
        if len(rows) < m:
            copying = np.flatnonzero(open_)
            row[copying] = out[t - back[copying], copying]
            left[copying] -= 1
        if len(rows):
            at = bit[rows]
            w = words.at(at)
            s, used = green.look(rows, w)
            literal = s < 256
            if literal.all():
                k, ws, g, some = rows, w, s, None
            else:
                some = np.flatnonzero(literal)
                k, ws, g = rows[some], w[some], s[some]
            ws = ws >> (used if some is None else used[some]).astype(np.uint64)
            r, n1 = red.look(k, ws)
            ws = ws >> n1.astype(np.uint64)
            b, n2 = blue.look(k, ws)
            taken = n1 + n2
            if alpha.bits:  # the four codes may exceed what was read at once
                a, n3 = alpha.look(k, words.at(at[some if some is not None else slice(None)] + (used if some is None else used[some]) + taken))
                taken = taken + n3
            else:
                a, _ = alpha.look(k, ws)
            row[k] = (a << 24 | r << 16 | g << 8 | b).astype(np.uint32)
            if some is None:
                used = used + taken
            else:
                used[some] += taken
                held = np.flatnonzero(s >= 280)
                k = rows[held]
                row[k] = cache[(k << deep) + s[held] - 280]
                held = np.flatnonzero(~literal & (s < 280))
                if len(held):
                    k, here = rows[held], at[held] + used[held]
                    length, extra = _values(words, here, s[held] - 256)
                    here = here + extra
                    code, n1 = far.look(k, words.at(here))
                    here = here + n1
                    distance, extra = _values(words, here, code)
                    used[held] = here + extra - at[held]
                    distance = np.where(distance > 120, distance - 120, near[np.minimum(distance, 120) - 1])
                    if (distance > t).any() or (t + length > size[k]).any():
                        raise ValueError("a back-reference leaves the image")
                    row[k] = out[t - distance, k]
                    left[k], back[k] = length - 1, distance
            bit[rows] = at + used
        if deep:
            p = row[:m]
            key = (p.astype(np.uint64) * _U(_CACHE_HASH) & _U(0xFFFFFFFF)) >> shift[:m]
            cache[(every[:m] << deep) + key.astype(np.int64) % (1 << deep)] = p
    if (bit > end).any():
        raise ValueError("the image ends early")
    return out


def _more(left: np.ndarray, way: int) -> np.ndarray:
    """(height, width, pictures) channels behind what a predictor of one mode left, as `_less` made it."""
    if way == LEFT:
        left[:, 0] = np.cumsum(left[:, 0], axis=0)
        return np.cumsum(left, axis=1)
    left[0] = np.cumsum(left[0], axis=0)
    return np.cumsum(left, axis=0)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """(height, width, 4) red, green, blue, alpha of lossless WebP files."""
    found: list[np.ndarray | None] = [None] * len(files)
    groups: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for k, media in enumerate(files):
        plain = _head(media)
        if plain is None:
            found[k] = decode(media)
        else:
            width, size, way, bits, at = plain
            groups.setdefault((width, way), []).append((k, size, bits, at))
    for (width, way), own in groups.items():
        own.sort(key=lambda x: -x[1])
        raw = [files[k] for k, *_ in own]
        lens = np.array([len(x) for x in raw])
        base = 8 * (np.cumsum(lens) - lens)
        size = np.array([x[1] for x in own])
        pixels = _read_pixels(Words(raw), base + np.array([x[3] for x in own]), base + 8 * lens, size, width, np.array([x[2] for x in own]))
        c = np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255, pixels >> 24], -1).astype(np.uint8)
        c = c.reshape(-1, width, len(own), 4)
        if way == GREEN:
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
        elif way in (LEFT, TOP):
            c = _more(c.astype(np.int64), way)
            c[..., 3] += 255
            c = (c & 255).astype(np.uint8)
        for column, (k, n, _, _) in enumerate(own):
            found[k] = np.ascontiguousarray(c[: n // width, :, column])
    return found


def _head(media: bytes) -> tuple[int, int, int, int, int] | None:
    """(width, pixels, way, cache bits, bit where the codes begin) of a file that the batch can read, else None."""
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L" or media[20:21] != b"\x2f":
        return None
    r = Reader(media[20:])
    r.get(8)
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        return None
    way = PLAIN
    if r.get(1):
        kind = r.get(2)
        if kind == 2:
            way = GREEN
        elif kind == 0:
            bits = r.get(3) + 2
            modes = read_image(r, -(-width // (1 << bits)), -(-height // (1 << bits)), False) >> 8 & 15
            if (modes != modes[0]).any() or modes[0] not in (1, 2):
                return None
            way = LEFT if modes[0] == 1 else TOP
        if way == PLAIN or r.get(1):
            return None
    bits = r.get(4) if r.get(1) else 0
    if bits > 11 or r.get(1):
        return None
    return width, width * height, way, bits, 160 + r.at
