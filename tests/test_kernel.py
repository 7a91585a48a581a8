"""The kernel: small cases by hand, random graphs by enumeration of paths, containment of the approximations."""

import itertools
import random

import pytest

from weft.plans import kernel
from weft.plans.languages import ERASED, METHODS, UNION, Language, States, excluding

LANGUAGES = [UNION, ERASED, Language("p"), Language("p", 1), Language("p", 2), Language("p", 2, True), excluding(0), excluding(1), Language("b"), Language("b", 1), Language("b", 2, True)]


def accepts(word, language, ranks):
    """Whether a list of (family, side, label) is in a language, by definition."""
    stack, mask, counted = [], 0, []
    for family, side, label in word:
        if family == "n":
            continue
        if family == language.counted:
            mask ^= language.bit(ranks[label])
            counted.append(side)
            continue
        name = 0 if language.balanced == "erased" else (family, label)
        if side == "o":
            stack.append(name)
        elif not stack or stack.pop() != name:
            return False
    ends = not language.endpoints or not counted or (counted[0], counted[-1]) == ("o", "c")
    return not stack and not mask and ends


def random_graph(rng, n, m):
    edges = set()
    while len(edges) < m:
        u, v = rng.randrange(n), rng.randrange(n)
        family = rng.choice("ppbbn")
        edges.add((u, v, family, "n" if family == "n" else rng.choice("oc"), 0 if family == "n" else rng.randrange(2)))
    return edges


def random_dag(rng, n, m):
    return {(min(e[:2]), max(e[:2]), *e[2:]) for e in random_graph(rng, n, m) if e[0] != e[1]}


def paths(edges):
    """All paths of an acyclic graph, as lists of edges."""
    out = [[e] for e in edges]
    done = []
    while out:
        done += out
        out = [[*p, e] for p in out for e in edges if e[0] == p[-1][1]]
    return done


@pytest.mark.parametrize("language", LANGUAGES, ids=str)
def test_facts_and_useful_edges_match_enumeration(language):
    rng = random.Random(7)
    for _ in range(40):
        edges = random_dag(rng, 6, 9)
        ranks = kernel.ranks(edges, language.counted) if language.counted else {}
        good = [p for p in paths(edges) if accepts([e[2:] for e in p], language, ranks)]
        solver = kernel.Solver(edges, language)
        assert solver.reach() == {(p[0][0], p[-1][1]) for p in good}
        assert solver.useful() == {e for p in good for e in p}
        for pair in list(solver.reach())[:3]:
            assert solver.has(pair) and solver.useful(pair) == {e for p in good for e in p if (p[0][0], p[-1][1]) == pair}


def test_states_compose_like_words():
    states = States(Language("p", 2, True))
    for word in itertools.product([(0, "o"), (1, "o"), (0, "c"), (1, "c")], repeat=3):
        s = 0
        for rank, side in word:
            s = states.compose[s][states.step(rank, side)]
        mask = (1 << word[0][0]) ^ (1 << word[1][0]) ^ (1 << word[2][0])
        assert states.all[s] == (mask, word[0][1], word[2][1])


def test_approximations_contain_each_other():
    rng = random.Random(11)
    for _ in range(25):
        edges = kernel.paired(random_graph(rng, 6, 12))
        low = kernel.under(edges)
        for method in METHODS:
            assert low <= kernel.over(edges, method)
        high = kernel.over(edges, "all")
        assert high <= kernel.over(edges, "se") <= kernel.over(edges, "parity2") <= kernel.over(edges, "parity") <= kernel.over(edges, "default")
        found = kernel.on_demand(edges, low, high, False)
        assert low <= found <= high
        assert found <= kernel.on_demand(edges, low, kernel.over(edges, "parity"), True)


CHAIN = [(0, 5, "p", "o", 1), (5, 6, "b", "o", 1), (6, 7, "b", "c", 1), (7, 8, "p", "c", 1)]


def test_small_cases():
    assert kernel.under(set(CHAIN)) == {(0, 8), (5, 7)}
    assert kernel.paired({*CHAIN, (8, 9, "p", "c", 2)}) == set(CHAIN)
    assert kernel.components({(1, 1, "n", "n", 0)}) == []
    cycle = {(0, 1, "n", "n", 0), (1, 2, "n", "n", 0), (2, 0, "n", "n", 0)}
    assert kernel.relevant(cycle, {(0, 2)}) == cycle
    assert len(kernel.relevant({(0, 1, "n", "n", 0), (1, 2, "n", "n", 0), (2, 2, "n", "n", 0)}, {(0, 1)})) == 1
    flow = {(0, 1, "b", "o", 0), (1, 2, "n", "n", 0), (2, 1, "n", "n", 0), (2, 3, "b", "c", 0)}
    assert kernel.value_flow_edges(flow | {(3, 4, "n", "n", 0)}) == flow
    assert kernel.bracket_pairs(flow, {(0, 3), (0, 2)}) == {(0, 3)}
    assert kernel.bracket_pairs({(0, 1, "b", "o", 0), (1, 2, "b", "c", 1)}, {(0, 2)}) == set()
    assert kernel.representatives({(0, 2), (2, 0), (1, 3)}) == {0: 0, 2: 0}
    assert kernel.condense({(2, 0, "n", "n", 0), (1, 2, "p", "o", 4)}, {0: 0, 2: 0}) == {(0, 0, "n", "n", 0)}
    assert kernel.over(set(), "all") == set() and kernel.under(set()) == set()


def test_parts_without_labels_are_solved_once(monkeypatch):
    """Refinement of a part without labels takes one solver, and none where the first language leaves no edge."""
    solved, solver = [], kernel.Solver
    monkeypatch.setattr(kernel, "Solver", lambda edges, language: solved.append(language) or solver(edges, language))
    plain = {(1, 2, "n", "n", 0), (2, 3, "n", "n", 0), (3, 2, "n", "n", 0), (3, 3, "n", "n", 0)}
    for method in kernel.METHODS:
        assert kernel.over(plain, method) == {(1, 2), (1, 3), (2, 3), (3, 2)} and len(solved) == 1
        solved.clear()
    assert kernel.over({(1, 2, "p", "c", 0), (2, 3, "p", "o", 0)}, "all") == set() and len(solved) == 1
    assert kernel.over(plain, "all", None, True) == set()
