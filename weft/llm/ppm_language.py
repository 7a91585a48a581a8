"""Language identification by prediction by partial matching with frozen statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import append, held_out, labelled_sample, strings

_UNIT = 1 << 16  # code lengths are whole numbers of 1 / _UNIT bits: sums don't depend on their order
_OTHER = 0  # the symbol of bytes that were never learnt, and of the places before a text


class Tree:
    """The byte context tree of order 3 of one language, as a table of code lengths.

    A byte is predicted from the longest context that the tree holds, down to
    order 0, with method C escapes and exclusion; what no order has seen is
    uniform over the bytes left. The tree holds every context of the texts; of
    order 3 the `max_states` most used ones. `table[state, symbol]` is the code
    length of a symbol, `step[a, b, c]` the state after the last three symbols;
    bytes that the language never showed are one symbol, `_OTHER`.
    """

    def __init__(self, texts: list[bytes], max_states: int):
        seen = np.flatnonzero(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1)  # 256 bytes at most are seen, of which UTF-8 never uses some
        a = self.a = len(seen) + 1
        gap = np.full(3, 255, np.uint8)  # stands between texts
        s = np.concatenate([x for t in texts for x in (gap, self.symbol[np.frombuffer(t, np.uint8)])] + [gap])
        here = np.flatnonzero(s[3:] != 255) + 3
        prev = [np.where(s[here - k] == 255, _OTHER, s[here - k]).astype(np.int64) for k in (1, 2, 3)]
        grams, n = np.unique(((prev[2] * a + prev[1]) * a + prev[0]) * a + s[here], return_counts=True)
        threes, first = np.unique(grams // a, return_index=True)
        self.contexts = [np.unique(threes % a), np.unique(threes % (a * a)), threes]
        if len(threes) > max_states:
            used = np.add.reduceat(n, first)
            self.contexts[2] = np.sort(threes[np.argsort(-used, kind="stable")][:max_states])
        states = 1 + sum(map(len, self.contexts))
        # the contexts of order 0 to 3 of each state; -1 where the state is shorter
        chain = np.full((4, states), -1, np.int64)
        chain[0] = 0
        at = 1
        for order, own in enumerate(self.contexts, 1):
            for k in range(1, order + 1):
                chain[k, at : at + len(own)] = own % a**k
            at += len(own)
        weight = np.ones(a)
        weight[_OTHER] = 256 - len(seen)
        self.table = self._lengths(grams, n, chain, weight).ravel()
        self._step = None

    def __getstate__(self):
        return self.__dict__ | {"_step": None}

    @property
    def step(self) -> np.ndarray:
        """Made where it is used: it is sent nowhere."""
        if self._step is None:
            a, at, step = self.a, 1, np.zeros(1, np.int32)
            for own in self.contexts:
                step = np.tile(step, a)
                step[own] = at + np.arange(len(own))
                at += len(own)
            self._step = step
        return self._step

    def _lengths(self, grams: np.ndarray, n: np.ndarray, chain: np.ndarray, weight: np.ndarray) -> np.ndarray:
        a, states = self.a, chain.shape[1]
        p, escape, out = np.zeros((states, a)), np.ones((states, 1)), np.zeros((states, a), bool)
        for order in (3, 2, 1, 0):
            tail = grams % a ** (order + 1)
            keys, where = np.unique(tail, return_inverse=True)
            sums = np.bincount(where, n)
            ctx, row = np.unique(keys // a, return_inverse=True)
            dense = np.zeros((len(ctx) + 1, a))
            dense[row, keys % a] = sums
            at = np.searchsorted(ctx, chain[order])
            at = np.where((chain[order] >= 0) & (at < len(ctx)) & (ctx[np.minimum(at, len(ctx) - 1)] == chain[order]), at, len(ctx))
            own = np.where(out, 0, dense[at])
            t, q = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
            p += np.where(own > 0, escape * own / np.maximum(t + q, 1), 0)
            escape = np.where(t > 0, escape * q / np.maximum(t + q, 1), escape)
            out |= own > 0
        left = np.where(out, 0, weight)
        p += escape * left / np.maximum(left.sum(1, keepdims=True), 1)
        # a symbol that stands for several bytes costs the choice among them too
        return np.round(-np.log2(np.maximum(p / np.maximum(weight, 1), 1e-12)) * _UNIT).astype(np.int32)

    def costs(self, data: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Code length of every byte from the fourth on; at the places `gaps` nothing is known."""
        s = self.symbol[data].astype(np.int64)
        s[gaps] = _OTHER
        state = self.step[(s[:-3] * self.a + s[1:-2]) * self.a + s[2:-1]]
        return self.table[state.astype(np.int64) * self.a + s[3:]]


class ContextTrees:
    """A tree for each language; they share nothing, so no language's model depends on how many others there are."""

    def __init__(self, texts: dict[str, list[bytes]], max_states: int = 65_536):
        self.langs = sorted(texts)
        self.trees = [Tree(texts[lang], max_states) for lang in self.langs]

    def code_lengths(self, texts: list[bytes], block: int = 1 << 20) -> np.ndarray:
        """Bits (in 1 / _UNIT) of each whole text in each language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        lens = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(b"\0\0\0" + t for t in texts), np.uint8)
        starts = np.cumsum(lens + 3) - lens
        gaps = (starts[:, None] - np.array([3, 2, 1])).ravel()
        for low in range(3, len(data), block):
            high = min(len(data), low + block)
            own_gaps = gaps[np.searchsorted(gaps, low - 3) : np.searchsorted(gaps, high)] - (low - 3)
            # the parts of texts in this block; the gaps between them count nowhere
            first = max(0, int(np.searchsorted(starts, low, "right")) - 1)
            last = int(np.searchsorted(starts, high, "left"))
            begin, end = np.clip(starts[first:last], low, high), np.clip(starts[first:last] + lens[first:last], low, high)
            some = end > begin
            cuts = np.stack([begin[some], end[some]], 1).ravel() - low
            if len(cuts):
                for k, tree in enumerate(self.trees):
                    cost = np.append(tree.costs(data[low - 3 : high], own_gaps), 0)
                    out[first:last, k][some] += np.add.reduceat(cost, cuts, dtype=np.int64)[::2]
        return out


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_lang_bytes: int = 300_000, max_doc_chars: int = 65_536, max_states: int = 65_536, seed: int = 5,
) -> DataFrame:
    """Rows (id, held_out, lang_pred, score, bits), one per input row.

    Trees are learnt from rows outside fold 2 with a non-null language: a seeded
    sample of about `per_lang_bytes` of text per language; of a text over
    `max_doc_chars` code points a stretch of so many is learnt. A tree holds all
    contexts of its sample up to order 3, of those of order 3 the `max_states`
    most used ones; driver and executors hold one tree a language. Every whole text is then scored by its exact code
    length in each language; lang_pred is the shortest (the first by name on a
    tie), score its share 2^-length against the other languages, bits its
    length. Texts that are null or have no letter: `und`, score 0, bits null; so
    is everything where no language can be learnt. lang_col is read for
    learning only; other columns are ignored.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, lang_col, id_col, text_col, per_lang_bytes, max_doc_chars, seed)
    texts = {str(lang): [t.encode() for t in part["text"]] for lang, part in sample.groupby("label") if part["text"].str.len().sum()}
    trees = spark.sparkContext.broadcast(ContextTrees(texts, max_states) if texts else None)

    def make():
        own = trees.value

        def score(batch):
            n = batch.num_rows
            lang, share, bits = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
            at = np.flatnonzero(batch.column("letters").to_numpy(zero_copy_only=False))
            if len(at) and own is not None:
                texts = strings(batch, "text")
                lengths = own.code_lengths([texts[k].encode() for k in at])
                best = lengths.argmin(1)
                least = lengths[np.arange(len(at)), best]
                lang[at] = np.array(own.langs, object)[best]
                share[at] = 1 / np.exp2(-np.minimum((lengths - least[:, None]) / _UNIT, 1000.0)).sum(1)
                bits[at] = least / _UNIT
            return {"lang_pred": lang, "score": share, "bits": bits}

        return score

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return append(rows, ["id", "held_out"], make, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "bits": ("double", pa.float64())})


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all whole texts of `documents`."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")
