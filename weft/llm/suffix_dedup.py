"""Removal of repeated 100-byte strings by a distributed, common-prefix-aware merge sort of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.grams import mix, prefix_sums, span_hashes
from weft.llm.texts import append, give_back
from weft.session import materialise

_U = np.uint64
_LOW = _U((1 << 24) - 1)
_BLOCK = 256  # suffixes that are packed, compressed and read at a time


class Suffixes:
    """Sampled suffixes of a slice of texts: those at the anchors that windows of `length` bytes choose by content.

    A window's anchor is its `gram`-byte string with the least hash, the first
    on a tie, so windows of equal bytes have it at the same place. A row stands
    for the consecutive windows (starts first to last) that share an anchor.
    """

    def __init__(self, texts: list[tuple[int, int, bytes]], length: int, gram: int):
        """texts: (document, place of the first byte in it, bytes)."""
        self.data = np.frombuffer(b"".join(t for _, _, t in texts) + b"\0" * (2 * length + 16), np.uint8)
        lens = np.array([len(t) for _, _, t in texts], np.int64)
        begin = np.cumsum(lens) - lens
        n = int(lens.sum())
        words = np.lib.stride_tricks.as_strided(self.data[:8].view(np.uint64), (n + length, ), (1,))
        hashes = np.empty(n, np.uint64)
        for low in range(0, n, 1 << 18):
            high = min(n, low + (1 << 18))
            hashes[low:high] = mix(words[low:high] ^ mix(words[low + gram - 8 : high + gram - 8]))
        least = hashes & ~_LOW | np.arange(n, dtype=np.uint64)
        width, want = 1, length - gram + 1
        while width * 2 <= want:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if want > width:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        inside = np.zeros(n + 1, np.int32)
        fits = lens >= length
        inside[begin[fits]] += 1
        inside[begin[fits] + lens[fits] - length + 1] -= 1
        # 32 bits for what a slice holds of every byte
        at = np.flatnonzero(np.cumsum(inside, out=inside)[: len(least)] > 0).astype(np.int32)
        anchor = (least[at] & _LOW).astype(np.int32)
        del least, inside
        owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.first, self.anchor = at[first].astype(np.int64), anchor[first].astype(np.int64)
        self.end = at[np.append(first[1:], len(at)) - 1].astype(np.int64) + length if len(at) else self.first
        own = owner[first]
        docs, base = np.array([d for d, _, _ in texts], np.int64), np.array([o for _, o, _ in texts], np.int64)
        self.doc, self.start = docs[own], self.first - begin[own] + base[own]
        self.part = hashes[self.anchor] >> _U(24)

    def __len__(self) -> int:
        return len(self.anchor)


def _sorted_order(s: Suffixes, part: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes by part, bytes, left context, document and start: the first 16 bytes as two numbers, the rest only where these are equal."""
    heads = [words[s.anchor + at].byteswap() for at in (8, 0)]
    order = np.lexsort((*heads, part))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = part[order[1:]] == part[order[:-1]]
    for head in heads:
        same[1:-1] &= head[order[1:]] == head[order[:-1]]
    tied = np.flatnonzero(same[1:] | same[:-1])
    if len(tied):
        group = np.cumsum(~same[:-1])[tied]
        who = order[tied]
        raw = s.data.tobytes()
        keys = [
            (g, raw[a:e], raw[f:a], d, t, k)
            for g, f, a, e, d, t, k in zip(group.tolist(), s.first[who].tolist(), s.anchor[who].tolist(), s.end[who].tolist(), s.doc[who].tolist(), s.start[who].tolist(), who.tolist(), strict=True)
        ]
        keys.sort()
        order[tied] = [k[-1] for k in keys]
    return order


def _shared(s: Suffixes, order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many bytes each suffix in order shares with the one before, compared in words as far as they agree; 0 for the first."""
    size, at = (s.end - s.anchor)[order], s.anchor[order]
    lcp = np.minimum(size[1:], size[:-1])
    live, done = np.arange(len(lcp)), 0
    while len(live):
        unlike = words[at[live + 1] + done] ^ words[at[live] + done]
        odd = unlike != 0
        x, bytes_ = unlike[odd], done
        for k in range(1, 8):
            bytes_ = bytes_ + (x & _U((1 << 8 * k) - 1) == 0)
        lcp[live[odd]] = np.minimum(lcp[live[odd]], bytes_)
        done += 8
        live = live[~odd]
        live = live[lcp[live] > done]
    return np.concatenate([[0], lcp])


def pack_runs(s: Suffixes, parts: int, gram: int):
    """(part, run, block): suffixes of each part in order, equal ones together, each without what it shares with the one before, by blocks of a run."""
    if not len(s):
        return
    words = np.lib.stride_tricks.as_strided(s.data[:8].view(np.uint64), (len(s.data) - 7,), (1,))
    part = (s.part % _U(parts)).astype(np.int64)
    order = _sorted_order(s, part, words)
    lcp = _shared(s, order, words)
    raw = s.data.tobytes()
    part, first, anchor, end = part[order], s.first[order], s.anchor[order], s.end[order]
    docs, starts = s.doc[order].astype("<i8"), s.start[order].astype("<i8")
    right, left = end - anchor, anchor - first
    turn = np.ones(len(order), bool)  # the first of a part
    turn[1:] = part[1:] != part[:-1]
    new = turn.copy()  # unlike the one before
    new[1:] |= (right[1:] != right[:-1]) | (left[1:] != left[:-1]) | (lcp[1:] < right[1:])
    maybe = np.flatnonzero(~new)
    new[maybe] = [raw[f:a] != raw[g:b] for f, a, g, b in zip(first[maybe].tolist(), anchor[maybe].tolist(), first[maybe - 1].tolist(), anchor[maybe - 1].tolist(), strict=True)]
    row = np.flatnonzero(new)
    cut = np.where(turn, 0, lcp)[row]
    heads = np.stack([cut, right[row], left[row], np.diff(row, append=len(order))], 1).astype("<u4")
    run = np.cumsum(turn)[row]
    begin = np.flatnonzero(turn[row])  # a block of a run: the reader goes on from the suffix before
    edges = [at for low, high in zip(begin.tolist(), [*begin[1:].tolist(), len(row)], strict=True) for at in range(low, high, _BLOCK)] + [len(row)]
    place = np.append(row, len(order))
    tail_at, tail_end, left_at = (anchor[row] + cut).tolist(), end[row].tolist(), first[row].tolist()
    left_end = anchor[row].tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        a, b = place[low], place[high]
        yield int(part[a]), int(run[low]), b"".join([
            (high - low).to_bytes(4, "little"), heads[low:high].tobytes(), docs[a:b].tobytes(), starts[a:b].tobytes(),
            *[raw[x:y] for x, y in zip(tail_at[low:high], tail_end[low:high], strict=True)],
            *[raw[x:y] for x, y in zip(left_at[low:high], left_end[low:high], strict=True)],
        ])


def read_run(blocks):
    """(prefix shared with the one before, suffix, left context, documents, starts) of each suffix of a run, given by its blocks."""
    last = b""
    for blob in blocks:
        n = int.from_bytes(blob[:4], "little")
        heads = np.frombuffer(blob, "<u4", 4 * n, 4).reshape(n, 4)
        total = int(heads[:, 3].sum())
        at = 4 + 16 * n
        docs, starts = np.frombuffer(blob, "<i8", total, at).tolist(), np.frombuffer(blob, "<i8", total, at + 8 * total).tolist()
        at += 16 * total
        left_at = at + int(heads[:, 1].sum(dtype=np.int64) - heads[:, 0].sum(dtype=np.int64))
        who = 0
        for lcp, right, left, m in heads.tolist():
            tail = right - lcp
            last = last[:lcp] + blob[at : at + tail]
            yield lcp, last, blob[left_at : left_at + left], docs[who : who + m], starts[who : who + m]
            at += tail
            left_at += left
            who += m


def merge(runs: list):
    """All suffixes of sorted runs in order, each with the prefix it shares with the one before.

    A loser tree: every contender knows how much it shares with the last
    output. Of two, the one that shares more comes first without a look at
    either; only on a tie are bytes compared, from the shared prefix on, and
    what is found out goes with the loser.
    """
    items = [next(r, None) for r in runs]
    n = 1
    while n < len(runs):
        n *= 2
    items += [None] * (n - len(runs))
    lcp = [0 if x is not None else -1 for x in items]

    def play(i: int, j: int) -> tuple[int, int]:
        a, b = lcp[i], lcp[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = items[i][1], items[j][1]
        most = min(len(x), len(y))
        while a + 16 <= most and x[a : a + 16] == y[a : a + 16]:
            a += 16
        while a < most and x[a] == y[a]:
            a += 1
        if a < most:
            first = x[a] < y[a]
        else:
            first = len(x) < len(y) or len(x) == len(y) and i < j
        lcp[j if first else i] = a
        return (i, j) if first else (j, i)

    losers, winners = [0] * n, [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if n > 1 else 0
    while items[best] is not None:
        item = items[best]
        yield lcp[best], item[1], item[2], item[3], item[4]
        items[best] = follow = next(runs[best], None)
        lcp[best] = follow[0] if follow is not None else -1
        node = (n + best) >> 1
        while node:
            rival = losers[node]
            a, b = lcp[best], lcp[rival]
            if a < b:
                best, losers[node] = rival, best
            elif a == b and a >= 0:
                won, lost = play(best, rival)
                best, losers[node] = won, lost
            node >>= 1


def _spans(item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each maximal run of consecutive places of one item."""
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first, len(item))[1:] - 1


def resolve(block: list[tuple[bytes, bytes, int, int]], length: int, open_: bool = False) -> list[tuple]:
    """Windows of suffix rows (suffix, left context, document, start) whose bytes occur in an earlier row.

    Returns (document, first start, last start, None, None). With `open_`, the
    first occurrences are listed too, each as (document, start, start, half,
    half) with the halves of its BLAKE2b digest of 128 bits, since other blocks
    may hold earlier ones. Equal hashes are compared byte by byte.
    """
    block = sorted(block, key=lambda x: (x[2], x[3]))
    block = [x for k, x in enumerate(block) if not k or x[2:] != block[k - 1][2:] or x[:2] != block[k - 1][:2]]  # repeated rows
    texts = [left + right for right, left, _, _ in block]
    data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lens) - lens
    count = lens - length + 1
    item = np.repeat(np.arange(len(block)), count)
    place = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[item] + place
    hashes = span_hashes(prefix_sums(data), at, at + length)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    repeated, model = order[~new], first[~new]
    words = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
    same = np.ones(len(repeated), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= words[at[repeated] + k] == words[at[model] + k]
    hit = np.zeros(len(item), bool)
    hit[repeated[same]] = True
    if not same.all():  # one hash for unlike strings: compare those by their bytes
        raw, seen = data.tobytes(), set()
        odd = np.flatnonzero(np.isin(hashes, hashes[repeated[~same]]))
        for k in odd.tolist():
            own = raw[at[k] : at[k] + length]
            hit[k] = own in seen
            seen.add(own)
    docs, starts = np.array([x[2] for x in block], np.int64), np.array([x[3] for x in block], np.int64)
    w = np.flatnonzero(hit)
    low, high = _spans(item[w], place[w])
    out = [(d, a, b, None, None) for d, a, b in zip(docs[item[w[low]]].tolist(), (starts[item[w[low]]] + place[w[low]]).tolist(), (starts[item[w[high]]] + place[w[high]]).tolist(), strict=True)]
    if open_:
        w, raw = np.flatnonzero(~hit), data.tobytes()
        where = starts[item[w]] + place[w]
        digests = np.frombuffer(b"".join(hashlib.blake2b(raw[k : k + length], digest_size=16).digest() for k in at[w].tolist()), np.int64).reshape(-1, 2)
        out += list(zip(docs[item[w]].tolist(), where.tolist(), where.tolist(), digests[:, 0].tolist(), digests[:, 1].tolist(), strict=True))
    return out


def repeated_windows(docs: DataFrame, length: int = 100, gram: int = 16, slice_bytes: int = 8 << 20, hot: int = 100_000, together: int = 20_000) -> DataFrame:
    """Rows (id, first, last): starts of windows of (id, text) whose bytes also start earlier.

    1. A task samples the suffixes of a slice of its texts, sorts them, joins
    equal ones, and front-codes one run per part of the anchors. 2. Runs are
    exchanged by part and combined by loser trees; neighbours that share an
    anchor form a block, in which windows are told apart. 3. A block of more
    than `hot` rows is passed on by windows: they are grouped by a digest,
    pre-aggregated, so no task holds such a block. `slice_bytes`, `hot` and
    `together` (suffixes told apart at a time) set what a worker holds; smaller ones
    cost time and change no result. The digest, 128 bits of BLAKE2b, takes the
    place of the comparison of bytes there; no two strings that share it are
    known, and of 10^12 unlike windows two do with odds of 1 to 10^14.
    """
    import zstandard  # noqa: F401  the runs are compressed by it

    if not 16 <= gram <= length <= slice_bytes or slice_bytes + length > 1 << 24:
        raise ValueError("16 <= gram <= length <= slice_bytes is needed, and places in a slice of at most 2**24 bytes")

    spark = docs.sparkSession
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exchange(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)

        def flush(pending):
            found: dict[tuple[int, int], list[bytes]] = {}
            for part, run, block in pack_runs(Suffixes(pending, length, gram), parts, gram):
                packed = squeeze.compress(block)
                found.setdefault((part, run), []).append(len(packed).to_bytes(4, "little") + packed)
            return pd.DataFrame({"part": [p for p, _ in found], "run": [b"".join(b) for b in found.values()]})

        pending, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                raw = text.encode()
                for at in range(0, max(1, len(raw) - length + 1), slice_bytes):
                    piece = raw[at : at + slice_bytes + length - 1]
                    if size and size + len(piece) > slice_bytes:
                        yield flush(pending)
                        pending, size = [], 0
                    pending.append((doc, at, piece))
                    size += len(piece)
        if pending:
            yield flush(pending)
            del pending
        give_back()

    def combine(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()

        def table(rows):
            return pd.DataFrame({
                "id": np.array([r[0] for r in rows], np.int64), "first": np.array([r[1] for r in rows], np.int64), "last": np.array([r[2] for r in rows], np.int64),
                "h": pd.array([r[3] for r in rows], dtype="Int64"), "g": pd.array([r[4] for r in rows], dtype="Int64"),
            })

        def blocks(blob):
            """The blocks of a run, expanded one at a time."""
            at = 0
            while at < len(blob):
                size = int.from_bytes(blob[at : at + 4], "little")
                yield expand.decompress(blob[at + 4 : at + 4 + size])
                at += 4 + size

        def one_part(blobs):
            out, waiting, size = [], [], 0  # waiting: rows of whole blocks
            block: list[tuple] = []
            opened = False

            def close():
                nonlocal block, opened, waiting, size
                if opened:
                    out.extend(resolve(block, length, True))
                elif len(block) > 1:
                    waiting += block
                    size += len(block)
                block, opened = [], False
                if size > together:
                    out.extend(resolve(waiting, length))
                    waiting, size = [], 0

            for lcp, right, left, docs, starts in merge([read_run(blocks(b)) for b in blobs]):
                if lcp < gram:
                    close()
                if len(block) >= hot:
                    out.extend(resolve(block, length, True))
                    block, opened = [], True
                # equal rows that a task joined: the later ones repeat the first as they are
                last = len(left) + len(right) - length
                seen = (docs[0], starts[0])
                for d, s in zip(docs[1:], starts[1:], strict=True):
                    if (d, s) != seen:
                        out.append((d, s, s + last, None, None))
                    seen = (d, s)
                block.append((right, left, docs[0], starts[0]))
                if len(out) > 200_000:
                    yield table(out)
                    out = []
            close()
            if waiting:
                out.extend(resolve(waiting, length))
            if out:
                yield table(out)

        now, blobs = None, []
        for batch in batches:
            for part, run in zip(batch["part"], batch["run"], strict=True):
                if part != now and blobs:
                    yield from one_part(blobs)
                    blobs = []
                now = part
                blobs.append(run)
        if blobs:
            yield from one_part(blobs)
            del blobs
        give_back()

    runs = docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= length)).select("id", "text").mapInPandas(exchange, "part int, run binary")
    found = materialise(runs.repartition("part").sortWithinPartitions("part").mapInPandas(combine, "id long, first long, last long, h long, g long"))
    closed = found.where("h is null").select("id", "first", "last")
    windows = found.where("h is not null")
    if windows.isEmpty():
        return closed
    least = windows.groupBy("h", "g").agg(F.min(F.struct("id", "first")).alias("least"), F.count("*").alias("n")).where("n > 1")
    late = windows.join(least, ["h", "g"]).where(F.struct("id", "first") > F.col("least")).select("id", "first", "last")
    return closed.union(late)


def covered(spans: list[tuple[int, int]], n: int, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows starting from first to last cover, within n bytes."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        end = min(n, last + length)
        if first >= n:
            continue
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _with_windows(docs: DataFrame, id_col: str, text_col: str, length: int, **options) -> DataFrame:
    """`docs` with __found, the repeated windows of each row's id."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spans = repeated_windows(texts, length, **options).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("__found")).withColumnRenamed("id", "__id")
    return docs.join(spans, docs[id_col].cast("long") == spans["__id"], "left").select(*[docs[c] for c in docs.columns], "__found")


def _cut(batch: pa.RecordBatch, text_col: str, length: int):
    """(text, removed runs, length in bytes, bytes that stay) of each row."""
    for text, found in zip(batch.column(text_col).to_pylist(), batch.column("__found").to_pylist(), strict=True):
        raw = (text or "").encode()
        own = covered([(s["first"], s["last"]) for s in found or []], len(raw), length)
        edges = [0, *(x for s in own for x in s), len(raw)]
        yield text, own, len(raw), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if own else raw


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, **options) -> DataFrame:
    """`docs` with __spans (start and end of the removed byte runs), __n_bytes and __kept, the bytes that stay.

    Texts are UTF-8 bytes, a null one is empty. A byte goes if a string of
    `length` bytes that covers it also starts earlier: in a document with a
    smaller id, or before in the same one; all on the texts as given. Rows that
    share an id are one document given several times: none of them removes the
    others, and each loses what the id loses. Rows with a null id lose nothing
    and remove nothing. Columns of `docs` come back as they are.
    """

    def cut(batch):
        rows = list(_cut(batch, text_col, length))
        return {"__spans": [[{"start": a, "end": b} for a, b in own] for _, own, _, _ in rows], "__n_bytes": [n for _, _, n, _ in rows], "__kept": [kept for *_, kept in rows]}

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    new = {"__spans": ("array<struct<start:long,end:long>>", span), "__n_bytes": ("long", pa.int64()), "__kept": ("binary", pa.binary())}
    return append(_with_windows(docs, id_col, text_col, length, **options), docs.columns, lambda: cut, new)


def apply_removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, **options) -> DataFrame:
    """`docs` without the bytes that `remove_repeats` removes; what is left of a character that lost bytes goes too. Null texts stay null."""

    def cut(batch):
        return {text_col: [kept.decode("utf-8", "ignore") if own else text for text, own, _, kept in _cut(batch, text_col, length)]}

    rest = [c for c in docs.columns if c != text_col]
    return append(_with_windows(docs, id_col, text_col, length, **options), rest, lambda: cut, {text_col: ("string", pa.string())}).select(docs.columns)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of all whole texts of `documents` without repeated 100-byte strings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = remove_repeats(docs)
    return cut.select(
        "doc_id", F.col("__n_bytes").alias("n_bytes"), (F.col("__n_bytes") - F.octet_length("__kept")).cast("long").alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"),
    )
