"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import append, give_back, held_out, portions, sample_of_labels, strings

_WORD = re.compile(r"\w+")
_HASHES = [(np.uint64(m), np.uint64(c)) for m, c in ((2654435, 97), (40503, 7919), (1597334, 104729), (69069, 1299709))]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """What the field sees of a token: the word, its beginnings and its end."""
    return ["w" + word, "a" + word[:4], "b" + word[:5], "c" + word[:6], "z" + word[-4:]]


class Field:
    """A two-state chain (clean, toxic): emissions by token features, transitions between neighbours."""

    def __init__(self, bias: float, weights: dict[str, float], trans: np.ndarray, start: float, platt: tuple[float, float]):
        self.bias, self.weights, self.trans, self.start, self.platt = bias, weights, trans, start, platt
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}

    def forget(self) -> None:
        """Empty the cache of words: a worker keeps a field as long as the driver's handle lives."""
        self._known.clear()

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > 100_000:
            known.clear()
        for word in set(tokens):
            if word not in known:
                known[word] = self.emission(word)
        return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of each token of each text, by forward-backward over the whole text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(group) < 512 and (len(group) + 1) * len(texts[order[at + len(group)]]) <= 500_000 and len(texts[order[at + len(group)]]) <= 32 + 2 * len(texts[group[0]]):
                group.append(order[at + len(group)])
            at += len(group)
            width = max(len(texts[k]) for k in group)
            e = np.full((width, len(group)), -30.0)
            for col, k in enumerate(group):
                e[: len(texts[k]), col] = self.emissions(texts[k])
            lens = np.array([len(texts[k]) for k in group])
            _, _, p = forward_backward(e, lens, self.trans, self.start)
            for col, k in enumerate(group):
                out[k] = p[: len(texts[k]), col]
        return out

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        """A document's probability from its most toxic token; without tokens, from 0."""
        top = np.array([m.max() if len(m) else 0.0 for m in marginals])
        z = np.log(np.clip(top, 1e-6, 1 - 1e-6) / (1 - np.clip(top, 1e-6, 1 - 1e-6)))
        return 1 / (1 + np.exp(-(self.platt[0] * z + self.platt[1])))


def forward_backward(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of alpha and beta and the marginals P(toxic), for columns padded to one length.

    In two states the messages need one number each: the odds of toxic to clean.
    """
    x = np.exp(np.clip(e, -30, 30))
    t = np.exp(trans)
    width, n = e.shape
    alpha, beta = np.empty((width, n)), np.ones((width, n))
    now = x[0] * np.exp(start)
    alpha[0] = now
    for k in range(1, width):
        now = x[k] * (t[0, 1] + now * t[1, 1]) / (t[0, 0] + now * t[1, 0])
        alpha[k] = now
    now = np.ones(n)
    for k in range(width - 2, -1, -1):
        ahead = now * x[k + 1]
        now = (t[1, 0] + ahead * t[1, 1]) / (t[0, 0] + ahead * t[0, 1])
        now = np.where(k + 1 < lens, now, 1.0)
        beta[k] = now
    odds = alpha * beta
    return alpha, beta, odds / (1 + odds)


def unlike(texts: list[list[str]]) -> list[int]:
    """Positions of texts that aren't near copies of earlier ones: two of four least hashes of word pairs tell them."""
    seen, kept = set(), []
    for k, tokens in enumerate(texts):
        pairs = np.array([crc32(f"{a} {b}".encode()) for a, b in zip(tokens, tokens[1:], strict=False)] or [crc32(" ".join(tokens).encode())], np.uint64)
        least = [int(((pairs * m + c) % np.uint64(4294967291)).min()) for m, c in _HASHES]
        keys = [(i, j, least[i], least[j]) for i in range(4) for j in range(i)]
        if not any(x in seen for x in keys):
            kept.append(k)
        seen.update(keys)
    return kept


def label_tokens(texts: list[list[str]], toxic: np.ndarray, least_odds: float = 3.0) -> set[str]:
    """Features that mark a token of a toxic document as toxic.

    They are those whose documents, near copies aside, are toxic more often than
    chance allows for any of the features looked at (the binomial tail against
    the number of features), with odds exp(least_odds) times those among clean
    documents.
    """
    own = [k for y in (0, 1) for k in (lambda at: [at[i] for i in unlike([texts[i] for i in at])])(np.flatnonzero(toxic == y).tolist())]
    index: dict[str, int] = {}
    known: dict[str, list[int]] = {}

    def numbers(word: str) -> list[int]:
        if word not in known:
            known[word] = [index.setdefault(f, len(index)) for f in features(word)]
        return known[word]

    seen = {k: np.unique(np.array([i for w in set(texts[k]) for i in numbers(w)], np.int32)) for k in own}
    count = lambda docs: sum((np.bincount(seen[k], minlength=len(index)) for k in docs), np.zeros(len(index), np.int64))
    left = [k for k in own if toxic[k]]
    clean, n0, marked = count([k for k in own if not toxic[k]]), max(1, len(own) - len(left)), np.zeros(len(index), bool)
    while left:
        hit = count(left)
        n, share = np.maximum(hit + clean, 1), len(left) / (len(left) + n0)
        p = hit / n
        odds = np.log((hit + 0.1) / (len(left) + 1)) - np.log((clean + 0.1) / (n0 + 1))
        gain = n * (p * np.log(np.maximum(p, 1e-12) / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)))
        new = (p > share) & (odds >= least_odds) & (gain >= np.log(20.0 * ((hit > 0).sum() + (clean > 0).sum())))
        if not new.any():
            break
        marked |= new
        left = [k for k in left if not marked[seen[k]].any()]
    names = list(index)
    return {names[k] for k in np.flatnonzero(marked)}


def train(texts: list[str], toxic: np.ndarray, window: int = 64, rounds: int = 40, block: int = 2048) -> Field | None:
    """A field fitted by gradient ascent on the likelihood of labelled token windows; None without both labels.

    Every window of every clean text and every window with a marked token of
    every toxic text is fitted. A token is kept as the number of its word, and
    features are summed once a word, so a window takes four bytes a token; a
    round goes over them `block` windows at a time.
    """
    toxic = np.asarray(toxic, dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    pool: dict[str, str] = {}  # one string a word
    tokens = [[pool.setdefault(w, w) for w in words(t)] for t in texts]
    marks = label_tokens(tokens, toxic)
    number = {w: k for k, w in enumerate(pool)}
    none = len(number)  # fills windows up
    marked = np.array([any(f in marks for f in features(w)) for w in number] + [False])
    parts, bad = [np.zeros((0, window), np.int32)], [np.zeros(0, bool)]
    for t, y in zip(tokens, toxic, strict=True):
        part = np.full((-(-len(t) // window), window), none, np.int32)
        part.ravel()[: len(t)] = np.fromiter(map(number.__getitem__, t), np.int32, len(t))
        if y:
            part = part[marked[part].any(axis=1)]
        parts.append(part)
        bad.append(np.full(len(part), bool(y)))
    grid, of_toxic = np.concatenate(parts), np.concatenate(bad)
    del parts, bad
    cuts = [slice(k, k + block) for k in range(0, len(grid), block)]
    # features that occur with toxic tokens or often elsewhere
    held = np.zeros(none + 1, np.int64)  # windows that hold a word
    for cut in cuts:
        own = np.sort(grid[cut], axis=1)
        held += np.bincount(own[np.diff(own, axis=1, prepend=-1) != 0], minlength=none + 1)
    seen: Counter[str] = Counter()
    for w, c in zip(number, held.tolist(), strict=False):
        if c:
            for f in features(w):
                seen[f] += c
    index = {f: k for k, f in enumerate(f for f, c in seen.items() if c >= 3)}
    del seen
    row, feat = array("i"), array("i")
    for k, w in enumerate(number):
        if held[k]:
            for f in features(w):
                if f in index:
                    row.append(k)
                    feat.append(index[f])
    row, feat = np.frombuffer(row, np.int32), np.frombuffer(feat, np.int32)

    def tagged(cut: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, places within the text, both of two neighbours within it, and tags of a block, by place and window."""
        part = np.ascontiguousarray(grid[cut].T)
        inside = part != none
        return part, inside, inside[1:], (marked[part] & of_toxic[cut]).astype(np.float64)

    weights, bias, start, trans = np.zeros(len(index)), -2.0, 0.0, np.zeros((2, 2))
    g2 = {"w": np.full(len(index), 1e-3), "o": np.full(6, 1e-3)}
    seen_pairs = np.zeros((2, 2))
    for cut in cuts:
        _, _, both, y = tagged(cut)
        one, two = y[:-1], y[1:]
        seen_pairs += [[((1 - one) * (1 - two) * both).sum(), ((1 - one) * two * both).sum()], [(one * (1 - two) * both).sum(), (one * two * both).sum()]]
    for _ in range(rounds):
        emission = np.append(bias + np.bincount(row, weights[feat], none), -30.0)
        by_word, gaps, want, t = np.zeros(none + 1), np.zeros(2), np.zeros((2, 2)), np.exp(trans)
        for cut in cuts:
            part, inside, both, y = tagged(cut)
            e = emission[part]
            alpha, beta, p = forward_backward(e, inside.sum(axis=0), trans, start)
            gap = np.where(inside, y - p, 0.0)
            one, ahead = alpha[:-1], np.exp(np.clip(e[1:], -30, 30)) * beta[1:]
            joint = [[t[0, 0], t[0, 1] * ahead], [one * t[1, 0], one * t[1, 1] * ahead]]
            whole = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
            want += [[(joint[a][b] / whole * both).sum() for b in (0, 1)] for a in (0, 1)]
            by_word += np.bincount(part.ravel(), gap.ravel(), none + 1)
            gaps += [gap.sum(), gap[0].sum()]
        gw = np.bincount(feat, by_word[row], len(index)) - 0.02 * weights
        other = np.concatenate([gaps, (seen_pairs - want - 0.02 * trans).ravel()])
        g2["w"] += gw**2
        g2["o"] += other**2
        weights += 0.6 * gw / np.sqrt(g2["w"])
        step = 0.3 * other / np.sqrt(g2["o"])
        bias, start, trans = bias + step[0], start + step[1], trans + step[2:].reshape(2, 2)
    del grid
    kept = {f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 1e-3}
    field = Field(float(bias), kept, trans, float(start), (1.0, 0.0))
    # calibration of the document score on the same labelled documents
    tops = np.array([m.max() if len(m) else 0.0 for m in field.marginals(tokens)])
    z = np.log(np.clip(tops, 1e-6, 1 - 1e-6) / (1 - np.clip(tops, 1e-6, 1 - 1e-6)))
    x, at = np.stack([z, np.ones_like(z)], 1), np.array([0.5, 0.0])
    share = np.where(toxic == 1, 0.25 / max(1, toxic.sum()), 0.75 / max(1, (1 - toxic).sum()))  # clean documents weigh more: most are
    for _ in range(50):  # Newton steps of a logistic fit, kept finite by a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        slope = x.T @ ((toxic - p) * share) - 1e-4 * at
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        at = at + np.clip(np.linalg.solve(bend, slope), -2.0, 2.0)
    a, b = at
    field.platt = (float(a), float(b))
    return field


def tag(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.3, span_threshold: float = 0.5, per_label: int = 1_500, max_doc_chars: int = 65_536, seed: int = 7,
) -> DataFrame:
    """Rows (id, held_out, score, predicted, spans), one per input row.

    The field is learnt from a seeded sample of labelled rows outside fold 2:
    about `per_label` documents of each label, and of a text over
    `max_doc_chars` code points a stretch of so many. Tokens are labelled from
    the documents' labels; all windows of clean documents and all windows of
    toxic ones that hold a token so marked are fitted (what else stands in a
    toxic document is neither toxic nor known to be clean). Then every whole text
    is tagged: score rises with the largest forward-backward marginal, spans
    lists (start, end, p) in code points of the runs of tokens with a marginal
    of `span_threshold` or more. Null and empty texts and texts without words
    score as a text without a toxic token; where the labels allow no field,
    every score is 0. Null labels are ignored, a document labelled twice is
    learnt twice. Other columns are ignored.
    """
    field = learn(docs, labels, id_col, text_col, label_col, per_label, max_doc_chars, seed)

    def score(batch):
        texts = strings(batch, "text")
        scores, marginals = own_scores(field.value, texts)
        spans = [runs(t, m, span_threshold) if len(m) and m.max() >= span_threshold else [] for t, m in zip(texts, marginals, strict=True)]
        return {"score": scores, "predicted": (scores >= threshold).astype(np.int32), "spans": spans}

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    new = {"score": ("double", pa.float64()), "predicted": ("int", pa.int32()), "spans": ("array<struct<start:int,end:int,p:double>>", span)}

    def make():
        if field.value is not None:
            field.value.forget()
        return score

    return append(rows, ["id", "held_out"], make, new)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, max_doc_chars: int, seed: int):
    """The field, sent to all executors; None inside where the labels allow none."""
    sample = sample_of_labels(docs, labels, label_col, id_col, text_col, per_label, max_doc_chars, seed)
    return docs.sparkSession.sparkContext.broadcast(train(list(sample["text"]), sample["label"].to_numpy(dtype=np.int64)))


def own_scores(field: Field | None, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Scores and marginals of whole texts."""
    if field is None or not texts:
        return np.zeros(len(texts)), [np.zeros(0)] * len(texts)
    marginals = field.marginals([words(t) for t in texts])
    return field.score(marginals), marginals


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.3, per_label: int = 1_500, max_doc_chars: int = 65_536, seed: int = 7,
) -> DataFrame:
    """The rows of `docs` that score below `threshold` under the field that `tag` would learn; all columns as they are."""
    field = learn(docs, labels, id_col, text_col, label_col, per_label, max_doc_chars, seed)

    def keep(batches):
        for batch in portions(batches):
            yield batch.filter(pa.array(own_scores(field.value, strings(batch, text_col))[0] < threshold))
            del batch
        if field.value is not None:
            field.value.forget()
        give_back()

    return docs.mapInArrow(keep, docs.schema)


def runs(text: str, marginals: np.ndarray, least: float) -> list[dict]:
    """Maximal runs of tokens at or above `least`, with their places in the text.

    Offsets come from the text as it is; where lower-casing changes the number
    of words, the words are matched on the lower-cased text.
    """
    places = [m.span() for m in _WORD.finditer(text)]
    if len(places) != len(marginals):
        places = [m.span() for m in _WORD.finditer(text.lower())]
    found: list[dict] = []
    last = -2
    for k in np.flatnonzero(marginals >= least).tolist():
        if k == last + 1:
            found[-1]["end"], found[-1]["p"] = places[k][1], max(found[-1]["p"], float(marginals[k]))
        else:
            found.append({"start": places[k][0], "end": places[k][1], "p": float(marginals[k])})
        last = k
    return found


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all whole texts of `documents`, learnt from `labels.toxic`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return tag(docs, labels).withColumnRenamed("id", "doc_id")
