"""Reachability of one connected component in memory: rows of reachable vertices as bit sets.

The grouped strategy of the engine runs these functions once per component;
`weft.plans.fixpoint` holds the same languages as joins over DataFrames.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

from weft.plans.languages import ERASED, METHODS, UNION, Language, States, excluding

#: (src, dst, family, side, label); labels are numbers whose order ranks them.
Edge = tuple[int, int, str, str, int]


#: Tables of states are made once a language and worker, not once a component.
_states = lru_cache(maxsize=256)(States)


def bits(x: int):
    """Positions of the ones of x."""
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def paired(edges: set[Edge]) -> set[Edge]:
    """Edges without the labels that lack a half."""
    halves = defaultdict(set)
    for _, _, family, side, label in edges:
        halves[family, label].add(side)
    return {e for e in edges if e[2] == "n" or len(halves[e[2], e[4]]) == 2}


def ranks(edges: set[Edge], family: str) -> dict[int, int]:
    """Rank of each label of a family that the edges still hold."""
    return {label: k for k, label in enumerate(sorted({e[4] for e in edges if e[2] == family}))}


def components(edges: set[Edge]) -> list[set[Edge]]:
    """Edges of each weakly connected component of two or more vertices."""
    # most often there is one, and in order each edge meets those before
    rest = sorted(edges)
    seen = set(rest[0][:2]) if rest else set()
    for e in rest:
        if e[0] in seen:
            seen.add(e[1])
        elif e[1] in seen:
            seen.add(e[0])
        else:
            break
    else:
        return [set(edges)] if len(seen) > 1 else []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in edges:
        a, b = find(e[0]), find(e[1])
        if a != b:
            parent[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for e in edges:
        out[find(e[0])].add(e)
    return [part for root, part in sorted(out.items()) if any(e[0] != e[1] for e in part)]


class Solver:
    """All facts (u, v, state) of a language over some edges, and the edges of the paths behind chosen facts."""

    def __init__(self, edges: set[Edge], language: Language):
        self.language, self.states = language, _states(language)
        self.names = sorted({v for e in edges for v in e[:2]})
        self.number = {v: i for i, v in enumerate(self.names)}
        n, m = len(self.names), len(self.states.all)
        rank = ranks(edges, language.counted) if language.counted else {}
        #: atoms[x][s]: where one step or one matched block leads from x
        self.atoms = [defaultdict(int) for _ in range(n)]
        self.back = [defaultdict(int) for _ in range(n)]
        self.step_edges: dict[tuple[int, int, int], list[Edge]] = defaultdict(list)
        opens: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by the vertex that the opening leads to
        self.closes: list[dict[tuple, int]] = [defaultdict(int) for _ in range(n)]
        self.open_edges: dict[tuple[int, int, tuple], list[Edge]] = defaultdict(list)
        self.close_edges: dict[tuple[int, int, tuple], list[Edge]] = defaultdict(list)
        number, counted, erased = self.number, language.counted, language.balanced == "erased"
        steps = {(label, side): self.states.step(k, side) for label, k in rank.items() for side in "oc"}
        for e in edges:
            u, v = number[e[0]], number[e[1]]
            if e[2] == "n" or e[2] == counted:
                s = 0 if e[2] == "n" else steps[e[4], e[3]]
                self.atoms[u][s] |= 1 << v
                self.back[v][s] |= 1 << u
                self.step_edges[u, v, s].append(e)
            else:
                name = ("x", 0) if erased else (e[2], e[4])
                if e[3] == "o":
                    opens[v].append((u, name))
                    self.open_edges[u, v, name].append(e)
                else:
                    self.closes[u][name] |= 1 << v
                    self.close_edges[u, v, name].append(e)
        self.opens = opens
        self.out_of = defaultdict(list)  # by the vertex that an opening leaves
        for v, found in opens.items():
            for u, name in found:
                self.out_of[u].append((v, name))
        self.rows = [[0] * n for _ in range(m)]
        self.cols = [[0] * n for _ in range(m)]
        self._close(n)

    def _close(self, n: int) -> None:
        compose, rows, cols, atoms = self.states.compose, self.rows, self.cols, self.atoms
        todo = [(u, 0, 1 << u) for u in range(n)]
        closing = sum(1 << v for v in range(n) if self.closes[v])
        while todo:
            u, s, new = todo.pop()
            new &= ~rows[s][u]
            if not new:
                continue
            rows[s][u] |= new
            found: dict[int, int] = {}
            one, col, then, left = 1 << u, cols[s], compose[s], new
            while left:
                low = left & -left
                left ^= low
                v = low.bit_length() - 1
                col[v] |= one
                for t, to in atoms[v].items():
                    t = then[t]
                    found[t] = found.get(t, 0) | to
            for t, to in found.items():
                if to & ~rows[t][u]:
                    todo.append((u, t, to))
            if u in self.opens and new & closing:
                for b in bits(new & closing):
                    for x, name in self.opens[u]:
                        to = self.closes[b].get(name, 0) & ~atoms[x].get(s, 0)
                        if to:  # a new block from x
                            atoms[x][s] |= to
                            for w in bits(to):
                                self.back[w][s] |= 1 << x
                            for t in range(len(rows)):
                                for y in bits(cols[t][x]):
                                    todo.append((y, compose[t][s], to))

    def reach(self) -> set[tuple[int, int]]:
        """Pairs of different vertices with an accepted path."""
        return {(self.names[u], self.names[v]) for s in self.states.accepting for u, row in enumerate(self.rows[s]) for v in bits(row & ~(1 << u))}

    def has(self, pair: tuple[int, int]) -> bool:
        u, v = self.number.get(pair[0]), self.number.get(pair[1])
        return u is not None and v is not None and any(self.rows[s][u] >> v & 1 for s in self.states.accepting)

    def useful(self, pair: tuple[int, int] | None = None) -> set[Edge]:
        """Edges on accepted paths: between all different vertices, or of one pair (which may be one vertex twice)."""
        before, rows, back = self.states.before, self.rows, self.back
        todo: list[tuple[int, int, int]] = []
        if pair is None:
            todo = [(u, s, row & ~(1 << u)) for s in self.states.accepting for u, row in enumerate(rows[s]) if row & ~(1 << u)]
        elif pair[0] in self.number and pair[1] in self.number:
            u, v = self.number[pair[0]], self.number[pair[1]]
            todo = [(u, s, 1 << v) for s in self.states.accepting if rows[s][u] >> v & 1]
        marked = [[0] * len(self.names) for _ in rows]  # marked[s][u]: facts of u on paths that are needed
        used: dict[tuple[int, int], int] = defaultdict(int)  # (s, w): where needed atoms to w begin
        edges: set[Edge] = set()
        while todo:
            u, s, new = todo.pop()
            new &= ~marked[s][u]
            if not new:
                continue
            marked[s][u] |= new
            while new:
                low = new & -new
                new ^= low
                w = low.bit_length() - 1
                for t, sources in back[w].items():
                    for r in before[t][s]:
                        had = rows[r][u] & sources
                        if not had:
                            continue
                        if had & ~marked[r][u]:
                            todo.append((u, r, had))
                        fresh = had & ~used[t, w]
                        if fresh:
                            used[t, w] |= fresh
                            for x in bits(fresh):
                                self._unfold(x, w, t, edges, todo)
        return edges

    def _unfold(self, x: int, w: int, s: int, edges: set[Edge], todo: list) -> None:
        """The edges of an atom from x to w, and the facts inside its blocks."""
        edges.update(self.step_edges.get((x, w, s), ()))
        for a, name in self.out_of[x]:
            for b in bits(self.rows[s][a]):
                if self.closes[b].get(name, 0) >> w & 1:
                    edges.update(self.open_edges[x, a, name])
                    edges.update(self.close_edges[b, w, name])
                    todo.append((a, s, 1 << b))


class Reach:
    """Reflexive reachability that ignores labels, searched once per start."""

    def __init__(self, edges: set[Edge]):
        self.next: dict[int, set[int]] = defaultdict(set)
        for e in edges:
            self.next[e[0]].add(e[1])
        self.known: dict[int, set[int]] = {}

    def from_(self, start: int) -> set[int]:
        if start not in self.known:
            self.known[start] = self.of({start})
        return self.known[start]

    def of(self, starts: set[int]) -> set[int]:
        seen, todo = set(starts), list(starts)
        while todo:
            for v in self.next.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen


def reversed_(edges: set[Edge]) -> set[Edge]:
    return {(e[1], e[0], *e[2:]) for e in edges}


def relevant(edges: set[Edge], pairs: set[tuple[int, int]]) -> set[Edge]:
    """Edges (x, y) with a pair (s, t) so that s reaches x and y reaches t."""
    ahead, out = Reach(edges), set()
    ends: dict[int, set[int]] = defaultdict(set)
    for s, t in pairs:
        ends[s].add(t)
    behind = Reach(reversed_(edges))
    left = set(edges)
    for s, own in ends.items():
        front = ahead.from_(s)
        back = behind.of(own)
        found = {e for e in left if e[0] in front and e[1] in back}
        out |= found
        left -= found
        if not left:
            break
    return out


def value_flow_edges(edges: set[Edge]) -> set[Edge]:
    """Edges whose ends both lie on a way from an opening to a closing bracket."""
    front = Reach(edges).of({e[0] for e in edges if e[2] == "b" and e[3] == "o"})
    back = Reach(reversed_(edges)).of({e[1] for e in edges if e[2] == "b" and e[3] == "c"})
    keep = front & back
    return {e for e in edges if e[0] in keep and e[1] in keep}


def bracket_pairs(edges: set[Edge], pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Pairs with a way that opens a bracket first and closes one of the same label last."""
    reach, opens, closes = Reach(edges), defaultdict(set), defaultdict(set)
    for u, v, family, side, label in edges:
        if family == "b":
            (opens[u] if side == "o" else closes[v]).add((label, v if side == "o" else u))
    out = set()
    for u, v in pairs:
        if any(label == other and b in reach.from_(a) for label, a in opens.get(u, ()) for other, b in closes.get(v, ())):
            out.add((u, v))
    return out


# --- the analyses ---------------------------------------------------------------------------------------------------------


def under(edges: set[Edge], valueflow: bool = False) -> set[tuple[int, int]]:
    """The under-approximation: both families nest across each other."""
    out: set[tuple[int, int]] = set()
    for part in components(edges):
        solver = Solver(part, UNION)
        pairs = solver.reach()
        out |= bracket_pairs(solver.useful(), pairs) if valueflow else pairs
    return out


def over(edges: set[Edge], method: str, pair: tuple[int, int] | None = None, valueflow: bool = False) -> set[tuple[int, int]]:
    """The over-approximation by mutual refinement; with a pair, that pair alone or nothing.

    Every component is refined until a round leaves its number of edges; the
    pairs are those of the last round.
    """
    out: set[tuple[int, int]] = set()
    for part in components(edges):
        if pair is not None:
            inside = {v for e in part for v in e[:2]}
            if pair[0] not in inside or pair[1] not in inside:
                continue
            part = relevant(part, {pair})
        out |= _refine(part, method, pair, valueflow)
    return out


def _refine(edges: set[Edge], method: str, pair: tuple[int, int] | None, valueflow: bool) -> set[tuple[int, int]]:
    if not edges:
        return set()
    plan, now, reached = METHODS[method], edges, []
    if pair is None and not valueflow and all(e[2] == "n" for e in edges):  # every language takes every path
        return Solver(edges, plan.alpha).reach()

    def step(language: Language) -> bool:
        nonlocal now
        solver = Solver(now, language)
        if pair is None:
            reached.append(solver.reach())
        else:
            if not solver.has(pair):
                return False
            reached.append({pair})
        now = paired(solver.useful(pair))
        return True

    for language in (plan.alpha, plan.beta, *([ERASED] if plan.project else [])):
        if not now or not step(language):  # without edges no pair is left
            return set()
    kept = list(reached)
    if plan.exclude:
        j = 0
        while j < len(ranks(now, "b")):
            if not step(excluding(j)):
                return set()
            j += 1
    if valueflow:
        kept[1] = bracket_pairs(now, kept[1])
        now = value_flow_edges(now)
    if not now or len(now) == len(edges):
        return kept[0] if pair is not None else set.intersection(*kept)
    return over(now, method, pair, valueflow)


def representatives(pairs: set[tuple[int, int]]) -> dict[int, int]:
    """Least member of each cluster of vertices that reach each other both ways by `pairs`."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in pairs:
        if u != v and (v, u) in pairs:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def contracted(edges: set[Edge], rep: dict[int, int]) -> set[Edge]:
    """Edges between clusters; those inside a cluster stay as self-loops."""
    return {(rep.get(e[0], e[0]), rep.get(e[1], e[1]), *e[2:]) for e in edges}


def condense(edges: set[Edge], rep: dict[int, int]) -> set[Edge]:
    """`contracted`, without the labels that lack a half."""
    return paired(contracted(edges, rep))


def expand(pairs: set[tuple[int, int]], rep: dict[int, int]) -> set[tuple[int, int]]:
    """Pairs of members for pairs of clusters."""
    members = defaultdict(list)
    for v, r in rep.items():
        members[r].append(v)
    return {(u, v) for a, b in pairs for u in members.get(a, [a]) for v in members.get(b, [b])}


def over_condensed(edges: set[Edge], method: str, known: set[tuple[int, int]], valueflow: bool = False, whole: bool = True) -> set[tuple[int, int]]:
    """The over-approximation on clusters of known pairs: members of a cluster reach each other.

    Of edges that aren't the `whole` graph, labels that lack a half here stay: they may have it elsewhere.
    """
    rep = representatives(known)
    out = expand(over((condense if whole else contracted)(edges, rep), method, None, valueflow), rep)
    members = defaultdict(list)
    for v, r in rep.items():
        members[r].append(v)
    return out | {(u, v) for own in members.values() for u in own for v in own if u != v}


def on_demand(edges: set[Edge], known: set[tuple[int, int]], upper: set[tuple[int, int]], parity_d: bool, valueflow: bool = False) -> set[tuple[int, int]]:
    """Pair by pair refinement of what lies between `known` and `upper`."""
    edges = relevant(edges, upper)
    found = _refine_pairs(edges, known, upper, "default", valueflow)
    if parity_d:
        return found
    return _refine_pairs(relevant(edges, found), known, found, "all", valueflow)


def _refine_pairs(edges: set[Edge], known: set, upper: set, method: str, valueflow: bool) -> set[tuple[int, int]]:
    rep = representatives(known)
    small = condense(edges, rep)
    candidates = {(rep.get(u, u), rep.get(v, v)) for u, v in upper - known}
    confirmed = {pair for pair in sorted(candidates) if over(small, method, pair, valueflow)}
    return known | expand(confirmed, rep)
