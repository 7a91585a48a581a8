"""Quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import append, held_out, sample_of_labels, strings

# Classes of code points, chosen here: letters by case and script block, digits, blanks, line ends and marks of their own.
_MARKS = ".,!?|#$%&*:;-_@/()\"'<>="
_CLASSES = 8 + len(_MARKS)


def _class_table() -> np.ndarray:
    table = np.full(0x250, 7, np.uint8)
    for code in range(0x250):
        ch = chr(code)
        if ch in _MARKS:
            table[code] = 8 + _MARKS.index(ch)
        elif ch == "\n":
            table[code] = 0
        elif ch.isspace():
            table[code] = 1
        elif ch.isdigit():
            table[code] = 2
        elif ch.isupper():
            table[code] = 3 if code < 128 else 4
        elif ch.islower():
            table[code] = 5 if code < 128 else 6
    return table


_TABLE = _class_table()
_PAIRS = _CLASSES * _CLASSES
#: Besides pairs of classes: word count, mean word length, share of words and of long words that repeat, of lines that repeat, distinct letters, bias.
_MORE = 7
WIDTH = _PAIRS + _MORE


def _repeats(passage: str) -> list[float]:
    own = passage.split()
    if not own:
        return [0.0] * 6
    longer = [w for w in own if len(w) > 5]
    lines = [x for x in passage.split("\n") if x]
    return [
        len(own) / 100, sum(map(len, own)) / len(own) / 10, 1 - len(set(own)) / len(own),
        1 - len(set(longer)) / len(longer) if longer else 0.0, 1 - len(set(lines)) / max(1, len(lines)), len(set(passage)) / 60,
    ]


def passages(text: str, size: int = 500) -> list[str]:
    """The whole text cut into passages of `size` code points; an empty text is one empty passage."""
    return [text[k : k + size] for k in range(0, len(text), size)] or [""]


def encode(parts: list[str]) -> np.ndarray:
    """A feature row of each passage: square roots of its shares of class pairs, and what repeats in it."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 7).astype(np.int64)
    lens = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), lens)
    code = owner[1:] * _PAIRS + kinds[:-1] * _CLASSES + kinds[1:]
    code = code[owner[1:] == owner[:-1]]
    counts = np.bincount(code, minlength=len(parts) * _PAIRS).reshape(len(parts), _PAIRS).astype(np.float32)
    shares = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    rest = np.array([_repeats(p) for p in parts], np.float32).reshape(len(parts), _MORE - 1)
    return np.concatenate([shares, rest, np.ones((len(parts), 1), np.float32)], axis=1)


class Attention:
    """Passage vectors h = tanh(xW), gated attention over them, and a linear score of their weighted sum."""

    def __init__(self, hidden: int, gate: int, seed: int):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.p = {"W": draw(WIDTH, hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "o": np.zeros(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.exp(np.clip((v * u) @ p["w"], -30, 30))
        a = e / np.repeat(np.add.reduceat(e, starts), lens)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ p["o"] + p["b"][0]}

    def slope(self, x: np.ndarray, starts: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """The gradient of the weighted log loss of some documents by every parameter."""
        p, f = self.p, self.forward(x, starts, lens)
        gap = (1 / (1 + np.exp(-f["logit"])) - y) * weight
        spread = np.repeat(gap[:, None] * p["o"], lens, axis=0)
        da = (spread * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), lens))
        dvu = de[:, None] * p["w"]
        dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * spread + dv @ p["V"].T + du @ p["U"].T
        return {"W": x.T @ (dh * (1 - f["h"] ** 2)), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "o": f["z"].T @ gap, "b": np.array([gap.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int, rate: float, seed: int, batch: int = 128, steps: int = 400) -> None:
        """Adam over batches of documents: `rounds` times all of them, and at least `steps` batches."""
        rng, p = np.random.default_rng(seed), self.p
        m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        rounds = max(rounds, -(-steps // -(-len(bags) // batch)))
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(rounds):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                lens = np.array([len(bags[k]) for k in own])
                x = np.concatenate([bags[k] for k in own]).astype(np.float64)
                g = self.slope(x, np.cumsum(lens) - lens, lens, y[own], weight[own] / len(own))
                g["W"] += 1e-5 * p["W"]
                g["o"] += 1e-4 * p["o"]
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, texts: list[str], size: int) -> np.ndarray:
        """Scores of whole texts; passages go through in slices, so a long text needs little memory."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            parts, lens = [], []
            while at + len(lens) < len(texts) and len(parts) < 4000:
                own = passages(texts[at + len(lens)], size)
                parts += own
                lens.append(len(own))
            # unnormalised sums over slices, added up per text
            owner = np.repeat(np.arange(len(lens)), lens)
            top, mass = np.zeros((len(lens), self.p["W"].shape[1])), np.zeros(len(lens))
            for k in range(0, len(parts), 4000):
                h = np.tanh(encode(parts[k : k + 4000]).astype(np.float64) @ self.p["W"])
                gated = np.tanh(h @ self.p["V"]) / (1 + np.exp(-(h @ self.p["U"])))
                e = np.exp(np.clip(gated @ self.p["w"], -30, 30))
                o = owner[k : k + 4000]
                first = np.flatnonzero(np.diff(o, prepend=-1))
                mass[o[first]] += np.add.reduceat(e, first)
                top[o[first]] += np.add.reduceat(e[:, None] * h, first, axis=0)
            logit = (top / mass[:, None]) @ self.p["o"] + self.p["b"][0]
            out[at : at + len(lens)] = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
            at += len(lens)
        return out


def train(texts: list[str], y: np.ndarray, size: int = 500, hidden: int = 24, gate: int = 12, rounds: int = 12, steps: int = 400, rate: float = 0.01, seed: int = 11) -> Attention | None:
    """A model fitted on whole labelled texts; None without both labels."""
    y = np.asarray(y, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    model = Attention(hidden, gate, seed)
    model.fit([encode(passages(t, size)) for t in texts], y, rounds, rate, seed, steps=steps)
    return model


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, per_label: int = 1_500, max_doc_chars: int = 65_536, passage: int = 500, rounds: int = 12, steps: int = 400, seed: int = 23,
) -> DataFrame:
    """Rows (id, held_out, score, predicted), one per input row.

    The model is learnt from a seeded sample of labelled rows outside fold 2:
    about `per_label` documents of each label, and of a text over
    `max_doc_chars` code points a stretch of so many. It is fitted in `rounds`
    rounds over the sample, or as many as make `steps` batches of 128. Every whole text is then cut into passages of `passage` code points,
    each passage encoded, and the attention-weighted sum scored. A null text
    counts as empty: one empty passage. Where the labels allow no model every
    score is 0.5. Null labels are ignored; other columns are ignored.
    """
    spark = docs.sparkSession
    sample = sample_of_labels(docs, labels, label_col, id_col, text_col, per_label, max_doc_chars, seed)
    model = spark.sparkContext.broadcast(train(list(sample["text"]), sample["label"].to_numpy(dtype=np.int64), passage, rounds=rounds, steps=steps))

    def score(batch):
        texts = strings(batch, "text")
        scores = model.value.scores(texts, passage) if model.value is not None else np.full(len(texts), 0.5)
        return {"score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return append(rows, ["id", "held_out"], lambda: score, {"score": ("double", pa.float64()), "predicted": ("int", pa.int32())})


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all whole texts of `documents`, learnt from `labels.quality`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).withColumnRenamed("id", "doc_id")
