"""Near-duplicates by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.grams import exact_shingles, mix, shingles, slices
from weft.llm.texts import give_back
from weft.operators.components import connected_components
from weft.session import materialise

_U = np.uint64
_ONE_TASK = 1_000_000  # components of up to so many links, 16 MB, are found in one task: the rounds of joins give the same
_BASE_LEVEL = -5  # ranks below 2**-5 form the first cell, further cells double


def _poisson(mean: float) -> np.ndarray:
    """Cumulated probabilities of a Poisson count, scaled to 2**53."""
    n = int(mean + 12 * mean**0.5 + 20)
    logs = np.cumsum(np.concatenate([[-mean], np.log(mean) - np.log(np.arange(1, n))]))
    return np.minimum(np.cumsum(np.exp(logs)), 1.0) * (1 << 53)


class Darts:
    """Signatures of weighted sets: hashed darts in the plane of weight and rank, the earliest per coordinate.

    An element of weight w owns the weights from 0 to w at all ranks. Darts
    fall into each cell of unit weight and doubling rank by a Poisson law and at
    places that hashes of element and cell decide, so equal regions hold equal
    darts; a dart beyond an element's weight misses. Each dart belongs to one of
    k coordinates. Ranks are searched up to about (k ln k + 2k) / total weight,
    and further for sets that leave a coordinate empty, so the work is the number
    of elements plus k log k however large the set.
    """

    def __init__(self, k: int, seed: int = 41):
        self.k, self.seed = k, seed
        self.laws: dict[int, np.ndarray] = {}

    def _cell(self, level: int) -> tuple[float, float]:
        return (0.0, 2.0**level) if level == _BASE_LEVEL else (2.0 ** (level - 1), 2.0 ** (level - 1))

    def _throw(self, sig: np.ndarray, owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, level: int) -> None:
        low, width = self._cell(level)
        if level not in self.laws:
            self.laws[level] = _poisson(width)
        tall = np.maximum(1, np.ceil(weights)).astype(np.int64)
        row = np.repeat(np.arange(len(owner)), tall)
        unit = np.arange(len(row)) - np.repeat(np.cumsum(tall) - tall, tall)
        salt = mix(np.array([self.seed * 1_000_003 + (level - _BASE_LEVEL) * 2 + 1], np.uint64))
        cell = mix(elements[row] ^ salt ^ mix(unit.astype(np.uint64)))
        count = np.searchsorted(self.laws[level], (cell >> _U(11)).astype(np.float64), "right")
        at = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(cell[at] + (nth + 1).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        place = mix(dart ^ _U(0xA5A5A5A5A5A5A5A5))
        if (weights != tall).any():
            hit = unit[at] + (mix(place) >> _U(11)).astype(np.float64) / (1 << 53) < weights[row][at]
            at, dart, place = at[hit], dart[hit], place[hit]
        coordinate = ((dart >> _U(32)) * _U(self.k) >> _U(32)).astype(np.int64)
        # rank in the high 40 bits: its exponent by cell, then the place within the cell
        rank = _U((level - _BASE_LEVEL) << 34) | place >> _U(30)
        np.minimum.at(sig, owner[row][at] * self.k + coordinate, rank << _U(24) | dart & _U((1 << 24) - 1))

    def signatures(self, owner: np.ndarray, elements: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
        """(n, k) signatures of n sets, given as (set, element[, weight]) rows sorted by set; sets without elements keep the largest value."""
        none = np.iinfo(np.uint64).max
        sig = np.full(n * self.k, none, np.uint64)
        weights = np.ones(len(owner)) if weights is None else np.asarray(weights, float)
        some = weights > 0
        owner, elements, weights = owner[some], elements[some], weights[some]
        total = np.bincount(owner, weights, n)
        need = (self.k * np.log(self.k) + 2 * self.k) / np.maximum(total, 1e-12)
        level, active = _BASE_LEVEL, total > 0
        while active.any():
            own = active[owner]
            for part in np.array_split(np.flatnonzero(own), max(1, int(own.sum() * max(1.0, self._cell(level)[1]) // 2_000_000))):
                self._throw(sig, owner[part], elements[part], weights[part], level)
            low, width = self._cell(level)
            active &= (low + width < need) | (sig.reshape(n, self.k) == none).any(1)
            level += 1
        return sig.reshape(n, self.k)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of each signature; it also tells bands apart."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.zeros((len(signatures), bands), np.uint64)
    for r in range(rows):
        out = mix(out + mix(parts[:, :, r] + _U(r + 1)))
    return mix(out + (np.arange(bands, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


def _verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) with `j`, the exact Jaccard similarity of the shingles of their texts, told apart by their words."""

    def exact(batches):
        for batch in batches:
            left, right = [t.encode() for t in batch["ta"]], [t.encode() for t in batch["tb"]]
            found = np.zeros(len(batch))
            both = [x for pair in zip(left, right, strict=True) for x in pair]
            for low, high in slices(both):
                low, high = low + low % 2, high + high % 2  # whole pairs
                if low >= high:
                    continue
                owner, values = exact_shingles(both[low:high], words)
                size = np.bincount(owner, minlength=high - low)
                pair = owner // 2
                order = np.lexsort((values, pair))
                p, v = pair[order], values[order]
                common = np.bincount(p[1:][(p[1:] == p[:-1]) & (v[1:] == v[:-1])], minlength=(high - low) // 2)
                union = size[0::2] + size[1::2] - common
                found[low // 2 : high // 2] = common / np.maximum(union, 1)
            yield batch[["a", "b"]].assign(j=found)
            del batch, left, right, both
        give_back()

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInPandas(exact, "a long, b long, j double")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each member with the centre of its bucket: the member whose buckets hold the most, then the smallest id.

    A class amid many near copies shares more bands than those at the rim, so
    most buckets of a hot group have one centre and its star links most of it.
    """
    weight = buckets.groupBy("id").agg(F.sum("n").alias("w"))
    centre = buckets.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("m"))
    return buckets.join(centre, "key").where("id <> m").select(F.least("m", "id").alias("a"), F.greatest("m", "id").alias("b"))


def _blocks(members: DataFrame, queries: int, others: int) -> DataFrame:
    """Rows (key, band, i, j, query, id, c, own) that deal each bucket into blocks of bounded size.

    Strays of a bucket (members outside its largest component) fall into
    chunks i of about `queries`, all members into chunks j of about `others`;
    block (i, j) holds both. A member goes to as many blocks as there are chunks
    of the other kind, so a block, and so a task, has a bounded size.
    """
    parts = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("strays"))
    main = main.where("strays > 0").select("key", "main", F.ceil(F.col("strays") / queries).cast("int").alias("is"), F.ceil(F.col("all") / others).cast("int").alias("js"))
    placed = members.join(main, "key").withColumn("stray", F.col("c") != F.col("main"))
    chunk = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    asked = placed.where("stray").select("key", "band", chunk("is", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), F.lit(True).alias("query"), "id", "c")
    given = placed.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), chunk("js", 2).alias("j"), F.lit(False).alias("query"), "id", "c")
    return asked.union(given)


def _block_links(group: pd.DataFrame, threshold: float, bands: int, rows: int, spread: float | None) -> pd.DataFrame:
    """Links that unite components within a block: every query against every other, by signature, then by sets of shingles.

    Pairs of one component are passed over, and pairs whose signatures agree
    in so few coordinates that a link would be `spread` standard deviations off
    (None: no pair for that); a pair is looked at in the first open bucket that
    it shares. The rest is compared by whole sets of 64-bit hashes of shingles.
    Links that close a circle aren't listed.
    """
    k, band = bands * rows, int(group["band"].iloc[0])
    least = 0 if spread is None else int(np.ceil(k * (threshold - spread * (threshold * (1 - threshold) / k) ** 0.5)))
    asked = group["query"].to_numpy()
    ids, c = group["id"].to_numpy(), group["c"].to_numpy()
    x, y = np.flatnonzero(asked), np.flatnonzero(~asked)
    if not len(x) or not len(y):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "j": np.zeros(0)})
    digest = np.frombuffer(b"".join(group["digest"]), np.uint16).reshape(len(group), k)
    open_ = np.unpackbits(np.frombuffer(b"".join(group["open"]), np.uint8).reshape(len(group), -1), axis=1)[:, :bands].astype(bool)
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    sizes = np.array([len(s) for s in sets])
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    columns = np.ascontiguousarray(digest[y].T)
    for start in range(0, len(x), 128):
        own = x[start : start + 128]
        agree = np.zeros((len(own), len(y)), np.uint16)
        for coordinate in range(k):
            agree += digest[own, coordinate][:, None] == columns[coordinate][None, :]
        # sizes alone bound the similarity; a pair of two queries counts once
        ratio = np.minimum(sizes[own][:, None], sizes[y][None, :]) >= threshold * np.maximum(sizes[own][:, None], sizes[y][None, :]) - 1e-9
        near = (agree >= least) & ratio & (c[own][:, None] != c[y][None, :])
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            at, m = own[q], np.flatnonzero(near[q])
            same = (digest[at] == digest[y[m]]).reshape(len(m), bands, rows).all(axis=2) & open_[at]
            m = y[m[same.any(axis=1) & (same.argmax(axis=1) == band)]]
            if not len(m):
                continue
            every = np.concatenate([sets[t] for t in m])
            place = np.minimum(np.searchsorted(sets[at], every), sizes[at] - 1)
            begin = np.cumsum(sizes[m]) - sizes[m]
            common = np.add.reduceat((sets[at][place] == every).astype(np.int64), begin)
            j = common / (sizes[m] + sizes[at] - common)
            for t, found in zip(m.tolist(), j.tolist(), strict=True):
                if found >= threshold - 1e-12:
                    a, b = find(int(c[at])), find(int(c[t]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((ids[at], ids[t], found))
    return pd.DataFrame(out, columns=["a", "b", "j"]).astype({"a": "int64", "b": "int64", "j": "float64"})


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, words: int = 5,
    bands: int = 40, rows: int = 5, small: int = 16, block: tuple[int, int] = (512, 2048), spread: float | None = 5.5, seed: int = 41,
) -> DataFrame:
    """Rows (id, component_id, kept), one per input row.

    Two documents link if the sets of their shingles (`words` words in a row;
    words are runs of characters other than ASCII blanks) have a Jaccard
    similarity of `threshold` or more. component_id is the smallest id reachable
    by links, kept tells whether it is the row's own. Texts of equal words are
    one class, looked at once. 40 bands of 5 coordinates of a DartMinHash
    signature miss a pair at 0.8 once in eight million times. Every link is
    verified on the whole texts: by their words, or, in the blocks below, by
    hashes of 64 bits of all their shingles.

    Classes that share a bucket are candidates. In buckets of up to `small`
    classes all pairs are verified; a larger one is linked to its centre first,
    and where several components remain, the members outside the largest one are
    compared with all others in blocks of `block` (queries, others) on
    executors, which list verified links only. So a hot group of near copies
    makes a star and bounded blocks, no list of its pairs. Blocks pass over pairs
    whose signatures are `spread` standard deviations off a link (at 5.5 one
    link at 0.8 in fifty million); None compares them too, at more time.

    Null texts and texts without words link with nothing. Rows with a null id
    come back with a null component and kept false. Rows that share an id are
    one vertex. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    k = bands * rows

    def sign(batches):
        darts = Darts(k, seed)
        for batch in batches:
            raw = [t.encode() for t in batch["text"]]
            keys = [hashlib.md5(b" ".join(t.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split())).digest() for t in raw]
            found = []
            for low, high in slices(raw):
                owner, values = shingles(raw[low:high], words)
                found.append(band_hashes(darts.signatures(owner, values, high - low), bands, rows).view(np.int64))
            hashes = np.concatenate(found) if found else np.zeros((0, bands), np.int64)
            yield pd.DataFrame({"id": batch["id"], "key": keys, "bands": list(hashes)})
            del batch, raw, keys, hashes
        give_back()

    def describe(batches):
        darts = Darts(k, seed)
        for batch in batches:
            raw, digests, sets = [t.encode() for t in batch["text"]], [], []
            for low, high in slices(raw):
                owner, values = shingles(raw[low:high], words)
                digests += [d.tobytes() for d in (mix(darts.signatures(owner, values, high - low)) >> _U(48)).astype(np.uint16)]
                sets += [s.tobytes() for s in np.split(values, np.searchsorted(owner, np.arange(1, high - low)))]
            yield batch[["id"]].assign(digest=digests, shingles=sets)
            del batch, raw, digests, sets
        give_back()

    sound = texts.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signed = materialise(sound.mapInPandas(sign, "id long, key binary, bands array<long>"))
    classes = materialise(signed.groupBy("key").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands")))
    dealt = classes.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(dealt.join(sizes, "key"))
    few, many = buckets.where(F.col("n") <= small).select("key", "id"), buckets.where(F.col("n") > small)
    alike = F.col("j") >= threshold - 1e-12

    pairs = few.withColumnRenamed("key", "key1").join(few.withColumnRenamed("id", "id2"), (F.col("key1") == F.col("key")) & (F.col("id") < F.col("id2"))).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    tried = materialise(_verify(pairs.union(_stars(many)).distinct(), sound, words).where(alike))
    component = materialise(connected_components(tried, "a", "b", one_task=_ONE_TASK))

    # large buckets that still hold several components
    members = many.join(component.withColumnRenamed("vertex", "id"), "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("c"))
    blocks = materialise(_blocks(members, *block))
    mask = F.transform(F.sequence(F.lit(0), F.lit((bands + 7) // 8 * 8 - 1)), lambda b: F.array_contains("own", b).cast("int"))
    open_ = blocks.where("not query").groupBy("id").agg(F.collect_set("band").alias("own")).select("id", mask.alias("open"))  # at most one row a band
    about = materialise(sound.join(open_, "id", "left_semi").dropDuplicates(["id"]).mapInPandas(describe, "id long, digest binary, shingles binary"))
    dealt = blocks.join(about.join(open_, "id"), "id")
    found = dealt.groupBy("key", "i", "j").applyInPandas(lambda g: _block_links(g, threshold, bands, rows, spread), "a long, b long, j double")
    tried = tried.select("a", "b").union(materialise(found).select("a", "b"))
    component = connected_components(tried, "a", "b", one_task=_ONE_TASK)

    of_key = classes.select("key", "id").join(component.withColumnRenamed("vertex", "id"), "id", "left").select("key", F.coalesce("component", "id").alias("c"))
    members = signed.select("id", "key").join(of_key, "key").groupBy("id").agg(F.min("c").alias("c"))
    return texts.select("id").join(members, "id", "left").select("id", F.coalesce("c", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, one of each group: that with the smallest id. Rows with a null id stay."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias("__id")).distinct()
    one = docs.join(kept, docs[id_col] == kept["__id"], "left_semi").dropDuplicates([id_col])
    return one.union(docs.where(F.col(id_col).isNull()))


def op4_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate `documents` at a similarity of 0.8 on five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
