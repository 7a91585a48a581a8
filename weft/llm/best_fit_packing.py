"""Packing documents into sequences: dominance reduction, then best fit decreasing, on counts by length."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.texts import append, give_back, portions, strings
from weft.session import materialise

_SALTS = 64  # a hot length is ranked in so many groups
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = regex.compile(_PATTERN)
#: The same for lower-case text as `re`, which is faster, knows the classes: all of ASCII; elsewhere numbers that aren't decimal count as letters.
_ASCII_WORD = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-z0-9]+")
_ANY_WORD = re.compile(r"[a-zß-öø-ÿ]++(?!\w)|[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\w\s]|_)+")
#: Text with these goes through the tokenizer whole: characters on whose class, lower case or being white space libraries differ.
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


class WordTokenizer:
    """Ids of whole texts through a cache of words.

    A vocabulary that drops white space, takes lower case and cuts words by the
    pattern above gives each word the same ids wherever it stands, so a text is
    cut into words and every distinct word is merged once while it is held
    (`by_runs`). Whether a vocabulary is of that kind is read from its file;
    texts of any other one, texts with odd characters and texts with the
    vocabulary's special strings go through the tokenizer as they are.
    """

    def __init__(self, path: str, room: int = 96 << 20):
        """room: bytes of words and ids that are held; at half of it, those not met since the last time go."""
        from tokenizers import Tokenizer

        self.whole, self.room, self.held, self.known, self.before = Tokenizer.from_file(path), room, 0, {}, {}
        self.merge = self.whole.model.tokenize
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.by_runs = _drops_blanks(said)
        self.special = [t["content"] for t in said.get("added_tokens") or []]
        # byte-level names: printable bytes stand for themselves, the others for what follows 255
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.names = {b: 256 + k for k, b in enumerate(rest)}

    def _words(self, text: str) -> list[str] | None:
        """What a text is cut into, to be looked up; None if it must go through the tokenizer whole."""
        if not self.by_runs or any(s in text for s in self.special):
            return None
        # what prints has neither odd characters, but for two, nor unassigned ones
        if text.replace("\n", " ").replace("\t", " ").replace("\r", " ").isprintable() and "\u0130" not in text and "\u03a3" not in text:
            return _ASCII_WORD.findall(text.lower()) if text.isascii() else _ANY_WORD.findall(unicodedata.normalize("NFC", text).lower())
        if _ODD.search(text):
            return None
        out = []
        for run in text.split():
            # Libraries of other Unicode versions may know unassigned characters: only the tokenizer's own classes count.
            unassigned = not run.isprintable() and any(unicodedata.category(c) == "Cn" for c in run)
            out += [run] if unassigned else _ANY_WORD.findall(unicodedata.normalize("NFC", run).lower())
        return out

    def _ids(self, word: str) -> bytes:
        """Ids of one of `_words`."""
        if word.isascii():
            return array("I", [t.id for t in self.merge(word)]).tobytes()
        if not word.isprintable() and any(unicodedata.category(c) == "Cn" for c in word):
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        parts = [word] if word.isalpha() else _WORD.findall(word)
        return array("I", [t.id for part in parts for t in self.merge(part.encode().decode("latin-1").translate(self.names))]).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, odd = [b""] * len(texts), []
        for k, text in enumerate(texts):
            words, known = self._words(text), self.known
            if words is None:
                odd.append(k)
                continue
            try:
                out[k] = b"".join(map(known.__getitem__, words))
            except KeyError:
                for word in set(words).difference(known):
                    known[word] = found = self.before.get(word) or self._ids(word)
                    self.held += 200 + len(word) + len(found)
                out[k] = b"".join(map(known.__getitem__, words))
            if self.held > self.room // 2:
                self.before, self.known, self.held = known, {}, 0
        for k, found in zip(odd, self.whole.encode_batch([texts[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(found.ids, "<u4").tobytes()
        return out


@lru_cache(1)
def coder(path: str) -> WordTokenizer:
    """One tokenizer a worker process: its tasks share what is read and cached."""
    return WordTokenizer(path)


def _drops_blanks(said: dict) -> bool:
    """Whether a vocabulary file takes NFC and lower case, drops white space and cuts words by `_WORD`, byte by byte, without further rules."""
    own = lambda steps, kind: [s for s in steps if s.get("type") == kind]
    norm, pre = (said.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    norms, pres = norm.get("normalizers", [norm]), pre.get("pretokenizers", [pre])
    splits, levels = own(pres, "Split"), own(pres, "ByteLevel")
    blanks = own(norms, "Replace")
    return (
        [s.get("type") for s in norms if s.get("type") != "Replace"] == ["NFC", "Lowercase"] and all(b["pattern"] == {"Regex": r"\s+"} and b["content"] == " " for b in blanks)
        and [s.get("type") for s in pres] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": _PATTERN} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not levels[0]["add_prefix_space"] and not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in said.get("added_tokens") or [])
    )


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Rows (id, piece, start, length, ids): every document's ids and `end_id`, cut after each `capacity` ids.

    A null text is empty, so it gives the one id `end_id`. `ids` holds
    little-endian unsigned 32-bit ids. `tokenizer` is a vocabulary file; left
    out, it is word_bpe_49k.json of the installed public vocabularies.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")

    def tokenize(batches):
        own, end = coder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in portions(batches):
            found = [x + end for x in own.ids(strings(batch, "text"))]
            cuts = [(k, n, at) for k, ids in enumerate(found) for n, at in enumerate(range(0, len(ids) // 4, capacity))]
            parts = [found[k][at * 4 : (at + capacity) * 4] for k, _, at in cuts]
            owner, nth, start = (np.array(x, np.int64) for x in (zip(*cuts, strict=True) if cuts else ((), (), ())))
            columns = [batch.column("id").take(pa.array(owner)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids"])
            del batch, found, parts, columns
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tokenize, f"id {kind}, piece int, start long, length long, ids binary")


class Plan:
    """Which piece goes where, for counts of pieces by length.

    `runs` holds (length, first rank, count, first sequence, offset): the piece
    of that length with rank r goes to sequence first + (r - rank) at the offset.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: int(v) for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self._best_fit()

    def _put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length], self.sizes[bisect_left(self.sizes, length)]

    def _fix(self, lengths: list[int], count: int) -> None:
        at = 0
        for length in lengths:
            self._put(length, count, self.sequences, at)
            at += length
        self.sequences += count
        self.fixed += count

    def _reduce(self) -> None:
        """Fix for good the sets of one or two pieces that dominate every other set with their largest piece.

        A set dominates another if the other's pieces can be shared out among
        its pieces without any share being the larger. For the largest piece:
        alone if nothing fits beside it; with the piece that fills the sequence;
        with the largest that fits, if only one fits, or if two fit but no two
        sum to more than it does.
        """
        changed = True
        while changed:
            changed = False
            for length in reversed(self.sizes.copy()):
                while length in self.left:
                    sizes = self.sizes
                    room, own = self.capacity - length, self.left[length]
                    few = [s for s in sizes[:3] for _ in range(min(3, self.left[s] - (s == length)))][:3]  # the three least besides one such piece
                    if not few or few[0] > room:
                        self._fix([length], own if not few or 2 * length > self.capacity else 1)
                        changed = True
                        continue
                    at = bisect_left(sizes, room + 1) - 1
                    if sizes[at] == length and own < 2:
                        at -= 1
                    best = sizes[at]
                    pairs = own // 2 if best == length else min(own, self.left[best])
                    if best < room and sum(few[:2]) <= room:
                        if len(few) < 3 or sum(few) > room:  # at most two fit: the largest sum of two
                            low = self._pair(sizes, length, room)
                            if low > best:
                                break
                            pairs = 1
                        else:
                            break
                    elif best < room:
                        pairs = min(pairs, 1 if best == length else pairs)
                    self._fix([length, best], pairs)
                    changed = True

    def _pair(self, sizes: list[int], length: int, room: int) -> int:
        """The largest sum up to `room` of two pieces besides one of `length`; 0 if there is none."""
        have = lambda s, n: self.left.get(s, 0) - (s == length) >= n
        i, j, best = 0, len(sizes) - 1, 0
        while i <= j:
            if not have(sizes[i], 1):
                i += 1
            elif not have(sizes[j], 1) or sizes[i] + sizes[j] > room:
                j -= 1
            else:
                if i != j or have(sizes[i], 2):
                    best = max(best, sizes[i] + sizes[j])
                i += 1
        return best

    def _best_fit(self) -> None:
        """Best fit decreasing: runs of alike sequences by what is free in them, the tightest first."""
        free: dict[int, list[tuple[int, int]]] = {}  # free ids: (first sequence, count)
        order: list[int] = []

        def keep(room: int, first: int, count: int) -> None:
            if room and count:
                if room not in free:
                    free[room] = []
                    insort(order, room)
                free[room].append((first, count))

        for length in reversed(self.sizes.copy()):
            while length in self.left:
                at = bisect_left(order, length)
                if at < len(order):
                    room = order[at]
                    first, count = free[room].pop()
                    if not free[room]:
                        del free[room]
                        order.pop(at)
                else:
                    each = self.capacity // length
                    room, first, count = self.capacity, self.sequences, -(-self.left[length] // each)
                    self.sequences += count
                each = room // length
                whole = min(count, self.left[length] // each)
                for k in range(each if whole else 0):
                    self._put(length, whole, first, self.capacity - room + k * length)
                keep(room - each * length, first, whole)
                if length in self.left and whole < count:
                    rest = self.left[length]  # fewer than one sequence takes
                    for k in range(rest):
                        self._put(length, 1, first + whole, self.capacity - room + k * length)
                    keep(room - rest * length, first + whole, 1)
                    whole += 1
                keep(room, first + whole, count - whole)

    def table(self) -> np.ndarray:
        """Runs as rows, sorted by length and rank."""
        return np.array(sorted(self.runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096, id_cols: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """`pieces` (with a `length` from 1 to capacity) with sequence_id and offset.

    The counts by length, at most `capacity` of them in 64 groups each, go to
    the driver, where the plan is made; every piece then finds its place from
    its rank among those of its length. Pieces of a hot length are ranked in
    groups. Sequences have no gaps. Repeated rows are pieces of their own. An
    empty table gives no rows. `pieces` should be a written table: it is read
    twice.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*id_cols), F.lit(_SALTS)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "__salt"])
    plan = Plan(counts.groupby("length")["n"].sum().to_dict(), capacity)
    before = np.zeros((capacity + 1, _SALTS), np.int64)
    before[counts["length"], counts["__salt"]] = counts["n"]
    before = np.cumsum(before, axis=1) - before
    # at most capacity * 64 counts, and runs by the capacity's harmonic sum, whatever the input
    sent = spark.sparkContext.broadcast((before, plan.table()))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*id_cols)).cast("long"))

    def make():
        first, runs = sent.value
        keys = runs[:, 0] << 40 | runs[:, 1]

        def place(batch):
            length, salt = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "__salt"))
            rank = batch.column("__rank").to_numpy() - 1 + first[length, salt]
            run = runs[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            return {"sequence_id": run[:, 3] + rank - run[:, 1], "offset": run[:, 4]}

        return place

    return append(ranked, pieces.columns, make, {"sequence_id": ("long", pa.int64()), "offset": ("long", pa.int64())})


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, with_ids: bool = True, **options) -> DataFrame:
    """Pieces of all documents with their places: (id, piece, start, length, ids_crc32, sequence_id, offset) and, on demand, the ids."""
    pieces = cut(docs, id_col, text_col, capacity=capacity, **options).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialise(pieces if with_ids else pieces.drop("ids")), capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 4096 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, with_ids=False).withColumnRenamed("id", "doc_id")
