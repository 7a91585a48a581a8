"""The languages for components too large for one task: bit sets by blocks of source vertices.

A fact (source, vertex, state) is found by walking from the source along atoms:
steps of one edge, and blocks, an opening and its closing around a fact. Walks
from different sources never meet, so sources are dealt over tasks; each task
has the atoms of its component, whose number it grows with, and one bit a
source, vertex and state reached for the few hundred sources it walks at once.
Only blocks travel between tasks: a round finds the blocks around the facts of
all vertices behind an opening, and the rounds end when none is new, after as
many as blocks nest deep. Each block is kept with what it was made of, so edges
on accepted paths are found backwards: from the goals of a source to the atoms
on its ways there, from a block among them to the fact inside, a new goal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.labels import masked
from weft.plans.languages import Language
from weft.session import grown, materialise, release

State = tuple[int, int, int]
NONE: State = (0, 0, 0)
_STATE = ["mask", "first", "last"]
_ROW = "comp long, part long, what string, p long, q long, name string, mask long, first int, last int"


def compose(a: State, b: State) -> State:
    return a[0] ^ b[0], a[1] or b[1], b[2] or a[2]


def _grouped(at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in the order of `by`, for reduceat."""
    order = np.argsort(by, kind="stable")
    return at[order], by[order]


class Walks:
    """What a chunk of sources reaches in one component; bits[state][vertex] holds one bit a source."""

    def __init__(self, n: int, atoms: dict[State, tuple[np.ndarray, np.ndarray]], sources: np.ndarray):
        self.n, self.atoms, self.sources = n, atoms, sources
        self.words = -(-len(sources) // 64)
        self.word, self.bit = np.divmod(np.arange(len(sources)), 64)
        self.bit = self.bit.astype(np.uint64)
        self.bits = {NONE: np.zeros((n, self.words), np.uint64)}
        np.bitwise_or.at(self.bits[NONE], (sources, self.word), np.uint64(1) << self.bit)
        ahead = {t: _grouped(x, w) for t, (x, w) in atoms.items()}
        self._spread(self.bits, ahead, lambda s, t: [compose(s, t)], None)

    def _spread(self, bits: dict[State, np.ndarray], moves: dict, leads, within: dict[State, np.ndarray] | None) -> None:
        """Close `bits` under moves (from, to), where a move t takes state s to those that leads(s, t) names; never beyond `within`."""
        changed = {s: b.any(axis=1) for s, b in bits.items()}
        while changed:
            then: dict[State, np.ndarray] = {}
            for s, now in changed.items():
                for t, (here, there) in moves.items():
                    on = now[here]
                    if not on.any():
                        continue
                    here_, there_ = here[on], there[on]
                    starts = np.flatnonzero(np.r_[True, there_[1:] != there_[:-1]])
                    found, at = np.bitwise_or.reduceat(bits[s][here_], starts, axis=0), there_[starts]
                    for to in leads(s, t):
                        more = found if within is None else found & within[to][at]
                        if to not in bits:
                            bits[to] = np.zeros((self.n, self.words), np.uint64)
                        old = bits[to][at]
                        fresh = (more & ~old).any(axis=1)
                        if fresh.any():
                            bits[to][at] = old | more
                            then.setdefault(to, np.zeros(self.n, bool))[at[fresh]] = True
            changed = then

    def of(self, bits: np.ndarray, k: int) -> np.ndarray:
        """Whether source k has each row's bit."""
        return (bits[..., self.word[k]] >> self.bit[k]) & np.uint64(1) != 0

    def used(self, goals: dict[State, np.ndarray]) -> dict[State, np.ndarray]:
        """For each kind of atom which lie on a source's way to a goal of its own."""
        goals = {s: g & self.bits[s] for s, g in goals.items() if s in self.bits}
        back = {t: _grouped(w, x) for t, (x, w) in self.atoms.items()}
        before: dict[tuple[State, State], list[State]] = {}
        for s in self.bits:
            for t in self.atoms:
                before.setdefault((compose(s, t), t), []).append(s)
        self._spread(goals, back, lambda s, t: before.get((s, t), []), self.bits)
        out = {}
        for t, (x, w) in self.atoms.items():
            hit = np.zeros(len(x), bool)
            for s, b in self.bits.items():
                if (to := compose(s, t)) in goals:
                    hit |= (b[x] & goals[to][w]).any(axis=1)
            out[t] = hit
        return out


def _walk(part: pd.DataFrame, mode: str, endpoints: bool, chunk_mb: int) -> pd.DataFrame:
    """One task: facts behind openings ("blocks"), accepted pairs ("pairs") or atoms on ways to goals ("used") of its sources."""
    of = {k: v for k, v in part.groupby("what")}
    comp, empty = int(part["comp"].iloc[0]), part.iloc[:0]
    names = np.unique(np.concatenate([part["p"].to_numpy(), part["q"].to_numpy()]))
    place = lambda c: np.searchsorted(names, c.to_numpy())
    atoms = {tuple(map(int, t)): (place(g["p"]), place(g["q"])) for t, g in of.get("atom", empty).groupby(_STATE)}
    sources = np.unique(place(of["source"]["p"]))
    goals = of.get("goal")
    opens, closes = (of.get(k, empty) for k in ("open", "close"))
    closes = {name: (place(g["p"]), place(g["q"])) for name, g in closes.groupby("name")}
    opens = pd.DataFrame({"x": place(opens["p"]), "a": place(opens["q"]), "name": opens["name"].to_numpy()})
    accepted = lambda s: s[0] == 0 and (not endpoints or s[1] == 0 or (s[1], s[2]) == (1, 2))
    chunk = 64 * max(1, min(16, (chunk_mb << 20) // (8 * len(names) * 2 * max(4, 2 * len(atoms)))))
    found: list[tuple] = []
    hit = {t: np.zeros(len(x), bool) for t, (x, _) in atoms.items()}
    for at in range(0, len(sources), chunk):
        own = sources[at : at + chunk]
        walks = Walks(len(names), atoms, own)
        number = {int(v): k for k, v in enumerate(own)}
        if mode == "blocks":
            for x, a, name in opens[opens["a"].isin(own)].itertuples(index=False):
                for s, bits in walks.bits.items() if name in closes else ():
                    b, y = closes[name]
                    on = walks.of(bits[b], number[a])
                    found += [(comp, names[x], names[a], names[i], names[j], name, *s) for i, j in zip(b[on], y[on], strict=True)]
        elif mode == "pairs":
            good = [b for s, b in walks.bits.items() if accepted(s)]
            all_ = np.bitwise_or.reduce(good)
            for k, u in enumerate(own):
                ends = np.flatnonzero(walks.of(all_, k))
                found.append((np.full(len(ends), names[u]), names[ends]))
        else:
            if goals is None:
                want = {s: b.copy() for s, b in walks.bits.items() if accepted(s)}
                for b in want.values():
                    b[own, walks.word] &= ~(np.uint64(1) << walks.bit)
            else:
                mine = goals[np.isin(place(goals["p"]), own)]
                want = {}
                for s, g in mine.groupby(_STATE):
                    k = np.array([number[int(u)] for u in place(g["p"])])
                    bits = want.setdefault(tuple(map(int, s)), np.zeros((len(names), walks.words), np.uint64))
                    np.bitwise_or.at(bits, (place(g["q"]), walks.word[k]), np.uint64(1) << walks.bit[k])
            for t, on in walks.used(want).items():
                hit[t] |= on
    if mode == "blocks":
        return pd.DataFrame(found, columns=["comp", "x", "a", "b", "y", "name", *_STATE])
    if mode == "pairs":
        u, v = (np.concatenate([f[k] for f in found] or [names[:0]]) for k in (0, 1))
        return pd.DataFrame({"src": u, "dst": v})
    rows = [pd.DataFrame({"comp": comp, "p": names[x[hit[t]]], "q": names[w[hit[t]]], "mask": t[0], "first": t[1], "last": t[2]}) for t, (x, w) in atoms.items()]
    return pd.concat(rows) if rows else pd.DataFrame(columns=["comp", "p", "q", *_STATE])


class Blocks:
    """The least fixpoint of a language over edges with a `comp` column; the interface is that of `fixpoint.Facts`.

    A task walks `per_task` sources and holds the atoms of one component and
    about `chunk_mb` MB of bits. Nothing but a test for new rows goes through
    the driver. States are those that walks reach, so k may be large.
    """

    def __init__(self, edges: DataFrame, language: Language, per_task: int = 2048, chunk_mb: int = 256):
        self.language, self.per_task, self.chunk_mb = language, per_task, chunk_mb
        edges = materialise(masked(edges, language, "comp").withColumn("mask", F.col("mask").cast("long")))
        side = F.when(F.col("side") == "o", 1).when(F.col("side") == "c", 2).otherwise(0) if language.endpoints else F.lit(0)
        counted = (F.col("family") == "n") | (F.col("family") == F.lit(language.counted))
        self.steps = edges.where(counted).select("*", side.alias("first"), side.alias("last"))
        name = F.lit("x") if language.balanced == "erased" else F.concat_ws(" ", "family", "label")
        nested = edges.where(~counted | F.lit(language.counted).isNull() & (F.col("family") != "n"))
        self.edges, self.nested = edges, nested.select("*", name.alias("name"))
        self.vertices = materialise(edges.select("comp", F.col("src").alias("p")).union(edges.select("comp", "dst")).distinct())
        atoms = materialise(self.steps.select("comp", F.col("src").alias("p"), F.col("dst").alias("q"), *_STATE).distinct())
        behind = materialise(self.nested.where("side = 'o'").select("comp", F.col("dst").alias("p")).distinct())
        while True:
            made = materialise(self._run(atoms, behind, "blocks", "comp long, x long, a long, b long, y long, name string, mask long, first int, last int"))
            new = made.select("comp", F.col("x").alias("p"), F.col("y").alias("q"), *_STATE).distinct()
            new = materialise(new.join(atoms, ["comp", "p", "q", *_STATE], "left_anti"))
            if new.isEmpty():
                release(new, behind)
                break
            atoms = grown(atoms, new)
            release(made)
        self.atoms, self.made = atoms, made

    def _run(self, atoms: DataFrame, sources: DataFrame, mode: str, schema: str, goals: DataFrame | None = None) -> DataFrame:
        none = {"q": F.col("p"), "name": F.lit(None).cast("string"), "mask": F.lit(0).cast("long"), "first": F.lit(0), "last": F.lit(0)}

        def rows(df: DataFrame, what: str) -> DataFrame:
            return df.select("comp", "part", F.lit(what).alias("what"), "p", *[F.col(c) if c in df.columns else none[c].alias(c) for c in ("q", "name", *_STATE)])

        parts = sources.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / self.per_task).alias("parts"))
        own = lambda df: df.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts"))).drop("parts")
        every = lambda df: df.join(parts, "comp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        given = rows(own(sources), "source").union(rows(every(atoms), "atom"))
        if mode == "blocks":
            for what, side in (("open", "o"), ("close", "c")):
                given = given.union(rows(every(self.nested.where(F.col("side") == side).select("comp", F.col("src").alias("p"), F.col("dst").alias("q"), "name")), what))
        if goals is not None:
            given = given.union(rows(own(goals), "goal"))
        assert [f.name for f in given.schema] == [c.split()[0] for c in _ROW.split(", ")]
        endpoints, chunk_mb = self.language.endpoints, self.chunk_mb

        def walk(part: pd.DataFrame) -> pd.DataFrame:
            if not (part["what"] == "source").any():  # a part that the hash gave no source
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return _walk(part, mode, endpoints, chunk_mb)

        return given.groupBy("comp", "part").applyInPandas(walk, schema)

    def accepted_pairs(self) -> DataFrame:
        """Pairs with an accepted path, a vertex and itself among them."""
        return self._run(self.atoms, self.vertices, "pairs", "src long, dst long")

    def reach(self) -> DataFrame:
        """Pairs of different vertices with an accepted path."""
        return self.accepted_pairs().where("src <> dst")

    def useful(self, targets: DataFrame | None = None) -> DataFrame:
        """Edges on accepted paths between different vertices, or of the target pairs (src, dst).

        A round walks only from the sources of new goals, so the work follows
        what is needed and every goal is walked once.
        """
        schema, fact = "comp long, p long, q long, mask long, first int, last int", ["comp", "a", "b", *_STATE]
        goal = lambda df: df.select("comp", F.col("a").alias("p"), F.col("b").alias("q"), *_STATE)
        if targets is None:
            used = materialise(self._run(self.atoms, self.vertices, "used", schema).distinct())
            seen = None
        else:
            ends = [(0, 0), (1, 2)] if self.language.endpoints else [(0, 0)]
            state = F.explode(F.array(*[F.struct(F.lit(0).cast("long").alias("mask"), F.lit(f).alias("first"), F.lit(e).alias("last")) for f, e in ends])).alias("s")
            wanted = targets.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(self.vertices.select("comp", F.col("p").alias("a")), "a").select("comp", "a", "b", state).select("comp", "a", "b", "s.*").distinct()
            seen = materialise(wanted)
            used = materialise(self._run(self.atoms, goal(seen).select("comp", "p").distinct(), "used", schema, goal(seen)).distinct())
        new = used
        while True:
            inner = self.made.join(new.select("comp", F.col("p").alias("x"), F.col("q").alias("y"), *_STATE), ["comp", "x", "y", *_STATE], "left_semi").select(fact).distinct()
            wanted = materialise(inner if seen is None else inner.join(seen, fact, "left_anti"))
            if wanted.isEmpty():
                release(wanted)
                break
            seen = wanted if seen is None else grown(seen, wanted)
            found = self._run(self.atoms, goal(wanted).select("comp", "p").distinct(), "used", schema, goal(wanted)).distinct()
            new = materialise(found.join(used, ["comp", "p", "q", *_STATE], "left_anti"))
            used = grown(used, new)
        columns = ["src", "dst", "family", "side", "label", "comp"]
        steps = self.steps.join(used.withColumnsRenamed({"p": "src", "q": "dst"}), ["comp", "src", "dst", *_STATE], "left_semi").select(columns)
        around = self.made.join(used.withColumnsRenamed({"p": "x", "q": "y"}), ["comp", "x", "y", *_STATE], "left_semi")
        half = lambda side, p, q: self.nested.where(F.col("side") == side).join(around.select("comp", F.col(p).alias("src"), F.col(q).alias("dst"), "name").distinct(), ["comp", "src", "dst", "name"], "left_semi").select(columns)
        return steps.union(half("o", "x", "a")).union(half("c", "b", "y")).distinct()
