"""Hashes of words, shingles and byte windows, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)  # a random odd number for each byte
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        m = max(n, 2 * len(_POWERS[0]))
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for k, b in ((0, _BASE), (1, inverse)):
            full = np.full(m, b, np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s so that (s[b] - s[a]) * inverse(base)**a depends on the bytes from a to b alone."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings from begin to end."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


class Words:
    """The words of a batch of texts (runs of bytes other than ASCII blanks), cut into eight bytes at a time.

    A word's hash adds up its pieces, each mixed with its place, so no pattern
    within a word cancels out as it does in a polynomial modulo 2**64.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n" + b"\0" * 8
        data = np.frombuffer(self.raw, np.uint8)[:-8]
        at = np.flatnonzero(np.diff(~_BLANK[data], prepend=False))
        self.begin, self.end = at[::2], at[1::2]
        self.owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.begin, "right")
        size = self.end - self.begin
        self.pieces = (size + 7) // 8
        self.start = np.cumsum(self.pieces) - self.pieces
        word = np.repeat(np.arange(len(size)), self.pieces)
        place = np.arange(len(word)) - self.start[word]
        left = size[word] - 8 * place
        self.values = np.lib.stride_tricks.as_strided(np.frombuffer(self.raw, np.uint64, 1), (len(data) + 1,), (1,))[self.begin[word] + 8 * place]
        short = left < 8
        self.values[short] &= (_U(1) << (left[short] * 8).astype(np.uint64)) - _U(1)
        salts = mix(np.arange(1, (int(place.max()) if len(place) else 0) + 2, dtype=np.uint64) * _BASE)
        sums = np.add.reduceat(mix(self.values ^ salts[place]), self.start) if len(size) else np.zeros(0, np.uint64)
        self.hashes = mix(sums + size.astype(np.uint64) * _BASE)

    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal bytes and for no others."""
        found, repeated, model = _numbered(self.hashes)
        same = (self.end - self.begin)[repeated] == (self.end - self.begin)[model]
        if same.all():
            word = np.repeat(np.arange(len(repeated)), self.pieces[repeated])
            place = np.arange(len(word)) - np.repeat(np.cumsum(self.pieces[repeated]) - self.pieces[repeated], self.pieces[repeated])
            same = self.values[self.start[repeated][word] + place] == self.values[self.start[model][word] + place]
        if same.all():
            return found
        seen: dict[bytes, int] = {}  # one hash for unlike words
        return np.array([seen.setdefault(self.raw[a:b], len(seen)) for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)], np.int64)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each hash; the items whose hash came before, and for each of these the first that has it."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    group = np.cumsum(new) - 1
    numbers = np.empty(len(order), np.int64)
    numbers[order] = group
    return numbers, order[~new], order[np.flatnonzero(new)[group[~new]]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII blanks) and the text of each."""
    words = Words(texts)
    return words.hashes, words.owner


def _distinct(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (id, value) sorted by both."""
    order = np.lexsort((values, ids))
    ids, values = ids[order], values[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
    return ids[new], values[new]


def shingles(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (text, hash) sorted by both.

    A shingle is `words` words in a row; a text of fewer words, but one at
    least, has one shingle of all of them.
    """
    hashes, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    rolled = np.zeros(len(hashes), np.uint64)
    for j in range(min(words, len(hashes))):
        part = hashes * _U(2 * j + 3) ^ _U(0xD1B54A32D192ED03 * (j + 1) & (1 << 64) - 1)
        rolled[: len(hashes) - j] += mix(part[j:]) if j else mix(part)
    place = np.arange(len(hashes)) - first[owner]
    whole = place + words <= count[owner]
    ids, values = [owner[whole]], [mix(rolled[whole])]
    for t in np.flatnonzero((count > 0) & (count < words)):
        own = hashes[first[t] : first[t] + count[t]]
        ids.append(np.array([t]))
        values.append(mix(np.array([np.bitwise_xor.reduce(mix(own + np.arange(1, len(own) + 1).astype(np.uint64) * _U(0xA0761D6478BD642F)))], np.uint64)))
    return _distinct(np.concatenate(ids), np.concatenate(values))


def exact_shingles(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As `shingles`, but with numbers that are equal within the call if, and only if, the words are: hashes find equal ones, words decide."""
    found = Words(texts)
    numbers, owner = found.numbers(), found.owner
    count = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    at = np.flatnonzero((place + words <= count[owner]) | (place == 0))
    rows = np.full((words, len(at)), -1, np.int64)  # -1: the text ends before
    for j in range(words):
        there = place[at] + j < count[owner[at]]
        rows[j, there] = numbers[at[there] + j]
    hashes = np.zeros(len(at), np.uint64)
    for j in range(words):
        hashes = mix(hashes + mix(rows[j].view(np.uint64) + _U((j + 1) * int(_BASE) & (1 << 64) - 1)))
    shingle, repeated, model = _numbered(hashes)
    if not all((row[repeated] == row[model]).all() for row in rows):  # one hash for unlike shingles
        shingle = np.unique(rows, axis=1, return_inverse=True)[1].reshape(-1)
    return _distinct(owner[at], shingle)


def slices(texts: list[bytes], most: int = 2 << 20):
    """Consecutive (start, stop) ranges of texts of about `most` bytes together."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start = k
            size = 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
