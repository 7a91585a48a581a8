"""Cyclic, branching graphs on which the seven methods and both on-demand ways give nine different results, held against the definitions."""

import random
from itertools import combinations

import pytest

from weft.plans import analyses, kernel
from weft.plans.languages import ERASED, METHODS, excluding

#: Seeds of graphs that tell results apart, found by trying them in turn; every two results differ on one of them.
SEEDS = [48, 184, 273, 301, 579, 1278, 3386]
EDGE = "src long, dst long, family string, side string, label long"


def tangle(seed):
    rng = random.Random(seed)
    n, m, edges = rng.randrange(5, 8), rng.randrange(9, 15), set()
    while len(edges) < m:
        u, v = rng.randrange(n), rng.randrange(n)
        family = rng.choice("ppbbn" if seed % 2 else "pbbpbp")
        edges.add((u, v, family, "n" if family == "n" else rng.choice("oc"), 0 if family == "n" else rng.randrange(2 if seed % 3 else 3)))
    return paired(edges)


def paired(edges):
    halves = {e[2:5] for e in edges}
    return {e for e in edges if e[2] == "n" or {(e[2], "o", e[4]), (e[2], "c", e[4])} <= halves}


def derivations(edges, language):
    """Of each nested word, as (from, to, mask, first, last of the counted family), the edges of all its derivations."""
    ranks = {label: k for k, label in enumerate(sorted({e[4] for e in edges if e[2] == language.counted}))}
    name = lambda e: 0 if language.balanced == "erased" else (e[2], e[4])
    nested = [e for e in edges if e[2] not in ("n", language.counted)]
    wraps = [(a, b) for a in nested for b in nested if (a[3], b[3]) == ("o", "c") and name(a) == name(b)]
    found = {}
    changed = True

    def add(fact, used):
        nonlocal changed
        before = found.get(fact, frozenset())
        if fact not in found or not used <= before:
            found[fact], changed = before | used, True

    for e in edges:
        if e[2] == "n":
            add((e[0], e[1], 0, "", ""), {e})
        elif e[2] == language.counted:
            add((e[0], e[1], language.bit(ranks[e[4]]), e[3], e[3]), {e})
    for a, b in wraps:
        if a[1] == b[0]:
            add((a[0], b[1], 0, "", ""), {a, b})
    while changed:
        changed = False
        now = list(found.items())
        for (u, v, mask, first, last), used in now:
            for a, b in wraps:
                if a[1] == u and b[0] == v:
                    add((a[0], b[1], mask, first, last), used | {a, b})
            for (x, y, more, start, end), others in now:
                if x == v:
                    add((u, y, mask ^ more, first or start, end or last), used | others)
    return found


def accepted(edges, language):
    """Edges on paths of the language, for each pair of different vertices that it joins."""
    out = {}
    for (u, v, mask, first, last), used in derivations(edges, language).items():
        if u != v and not mask and (not language.endpoints or not first or (first, last) == ("o", "c")):
            out[u, v] = out.get((u, v), frozenset()) | used
    return out


def components(edges):
    parts = []
    for e in edges:
        near = [p for p in parts if any({e[0], e[1]} & {f[0], f[1]} for f in p)]
        parts = [p for p in parts if p not in near] + [{e}.union(*near)]
    return parts


def relevant(edges, pairs):
    reach = {(v, v) for e in edges for v in e[:2]} | {(e[0], e[1]) for e in edges}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    return {e for e in edges if any((s, e[0]) in reach and (e[1], t) in reach for s, t in pairs)}


def refined(edges, method, pair=None):
    """Pairs that stay when the languages of a method drop each other's useless edges until none goes."""
    plan, out = METHODS[method], set()
    for part in components(edges):
        now = part if pair is None else relevant(part, {pair})
        while now:
            before, sets = now, []

            def step(language):
                nonlocal now
                joined = accepted(now, language)
                if pair is not None:
                    joined = {pair: joined[pair]} if pair in joined else {}
                now = paired(set().union(*joined.values()))
                return set(joined)

            sets = [step(language) for language in [plan.alpha, plan.beta, *([ERASED] if plan.project else [])]]
            alive, rank = all(sets), 0
            while plan.exclude and rank < len({e[4] for e in now if e[2] == "b"}):
                alive &= bool(step(excluding(rank)))
                rank += 1
            if pair is not None and not alive:
                break
            if not now or len(now) == len(before):
                out |= set.intersection(*sets)
                break
            if pair is None:
                out |= refined(now, method)
                break
            now = relevant(now, {pair})
    return out


def demanded(edges, known, upper, methods):
    """Pairs between `known` and `upper` that stay when each is refined by itself, on clusters of vertices that `known` joins both ways."""
    for method in methods:
        own = relevant(edges, upper)
        vertices = {v for e in own for v in e[:2]} | {v for p in upper for v in p}
        near = {v: {v} | {u for u in vertices if (u, v) in known and (v, u) in known} for v in vertices}
        rep = {v: min(near[v]) for v in vertices}
        while any(rep[v] != min(rep[u] for u in near[v]) for v in vertices):
            rep = {v: min(rep[u] for u in near[v]) for v in vertices}
        small = paired({(rep[e[0]], rep[e[1]], *e[2:]) for e in own})
        stays = {p for p in {(rep[u], rep[v]) for u, v in upper - known} if p in refined(small, method, p)}
        upper = known | {(u, v) for u in vertices for v in vertices if (rep[u], rep[v]) in stays}
    return upper


def nine(edges):
    low = kernel.under(edges)
    out = {m: kernel.over(edges, m) for m in METHODS}
    return out | {"parityD": kernel.on_demand(edges, low, out["parity"], True), "on_demand": kernel.on_demand(edges, low, out["all"], False)}


def test_every_two_results_differ_somewhere():
    results = [nine(tangle(seed)) for seed in SEEDS]
    for a, b in combinations(results[0], 2):
        assert any(r[a] != r[b] for r in results), (a, b)


@pytest.mark.parametrize("seed", SEEDS)
def test_kernel_is_the_definition(seed):
    edges = tangle(seed)
    found = nine(edges)
    for method in METHODS:
        assert found[method] == refined(edges, method), method
    low = kernel.under(edges)
    assert found["parityD"] == demanded(edges, low, found["parity"], ["default"])
    assert found["on_demand"] == demanded(edges, low, found["all"], ["default", "all"])


def test_analyses_give_all_nine(spark):
    """All graphs at once, each with vertices and labels of its own, by component."""
    moved = [{(e[0] + 100 * k, e[1] + 100 * k, *e[2:4], e[4] + 100 * k * (e[2] != "n")) for e in tangle(seed)} for k, seed in enumerate(SEEDS)]
    edges = spark.createDataFrame(sorted(set().union(*moved)), EDGE)
    want = [nine(m) for m in moved]
    pairs = lambda df: {tuple(r) for r in df.select("src", "dst").collect()}
    table = lambda sets: spark.createDataFrame(sorted(set().union(*sets)), "src long, dst long")
    for name in METHODS:
        assert pairs(analyses.over_approximation(edges, name)) == set().union(*(w[name] for w in want)), name
    low = table(kernel.under(m) for m in moved)
    for name, upper in (("parityD", "parity"), ("on_demand", "all")):
        assert pairs(analyses.on_demand(edges, low, table(w[upper] for w in want), name == "parityD")) == set().union(*(w[name] for w in want)), name
