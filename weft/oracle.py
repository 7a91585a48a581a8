"""DuckDB SQL for under-approximation and mutual refinement on graphs without cycles, where every walk can be listed.

`edges` is a table (eid, comp, src, dst, family, side, label). A step lists all walks of one language with the edges that
they use, and keeps the edges of the accepted ones; a round makes the steps of a method on each weak component; as many
rounds as asked are written one after another, and the statement fails if the last one still removes an edge.
"""

from __future__ import annotations

from weft.plans.languages import ERASED, METHODS, UNION, Language, excluding


def walks(tag: str, edges: str, language: Language) -> str:
    """CTEs hit_<tag>: accepted walks (comp, start, here, used), and pairs_<tag>: the pairs that they join."""
    counted = f"family = '{language.counted}'" if language.counted else "FALSE"
    token = "'x;'" if language.balanced == "erased" else "family || label || ';'"
    bit = f"CAST(1 << (rnk % {language.k}) AS INTEGER)" if language.k else "0"
    if language.exclude is not None:
        bit = f"CASE WHEN rnk = {language.exclude} THEN 0 ELSE {bit} END"
    ends = "AND (first = 'n' OR (first = 'o' AND last = 'c'))" if language.endpoints else ""
    return f"""
s_{tag} AS MATERIALIZED (
  SELECT eid, comp, src, dst, side, family = 'n' AS plain, {counted} AS counted, {token} AS token, {bit} AS bit
  FROM (SELECT *, dense_rank() OVER (PARTITION BY comp, family ORDER BY label) - 1 AS rnk FROM {edges})),
walk_{tag}(comp, start, here, stack, mask, first, last, used) AS (
  SELECT DISTINCT comp, src, src, '', 0, 'n', 'n', CAST([] AS BIGINT[]) FROM s_{tag}
  UNION ALL
  SELECT w.comp, w.start, s.dst,
         CASE WHEN plain OR counted THEN stack WHEN side = 'o' THEN stack || token ELSE left(stack, length(stack) - length(token)) END,
         CASE WHEN counted THEN xor(mask, bit) ELSE mask END,
         CASE WHEN counted AND first = 'n' THEN side ELSE first END,
         CASE WHEN counted THEN side ELSE last END,
         list_append(used, eid)
  FROM walk_{tag} w JOIN s_{tag} s ON s.comp = w.comp AND s.src = w.here
  WHERE plain OR counted OR side = 'o' OR ends_with(stack, token)),
hit_{tag} AS MATERIALIZED (SELECT comp, start, here, used FROM walk_{tag} WHERE start <> here AND stack = '' AND mask = 0 {ends}),
pairs_{tag} AS MATERIALIZED (SELECT DISTINCT comp, start AS src, here AS dst FROM hit_{tag})"""


def _step(tag: str, edges: str, language: Language) -> str:
    """Of each component the edges on accepted walks, without label ids that lost a half: e_<tag>.

    A component with too few bracket labels to exclude one of that rank passes as it is.
    """
    spared = "FALSE" if language.exclude is None else f"comp NOT IN (SELECT comp FROM {edges} WHERE family = 'b' GROUP BY comp HAVING count(DISTINCT label) > {language.exclude})"
    return f"""{walks(tag, edges, language)},
on_{tag} AS MATERIALIZED (SELECT * FROM {edges} WHERE eid IN (SELECT unnest(used) FROM hit_{tag})),
e_{tag} AS MATERIALIZED (
  SELECT * FROM on_{tag} WHERE NOT ({spared}) AND (family = 'n' OR (comp, family, label) IN (
    SELECT (comp, family, label) FROM on_{tag} GROUP BY comp, family, label HAVING bool_or(side = 'o') AND bool_or(side = 'c')))
  UNION ALL SELECT * FROM {edges} WHERE {spared})"""


def _reach(tag: str, edges: str) -> str:
    return f"""
reach_{tag}(a, b) AS (
  SELECT src, src FROM {edges} UNION SELECT dst, dst FROM {edges}
  UNION SELECT r.a, e.dst FROM reach_{tag} r JOIN {edges} e ON e.src = r.b)"""


def flow_edges(tag: str, edges: str) -> str:
    """CTE flow_<tag>: the edges whose ends both lie on a way from an opening to a closing bracket; needs reach_<tag>."""
    return f"""
kept_{tag} AS MATERIALIZED (
  SELECT r.b AS v FROM reach_{tag} r JOIN {edges} e ON r.a = e.src WHERE family = 'b' AND side = 'o'
  INTERSECT SELECT r.a FROM reach_{tag} r JOIN {edges} e ON r.b = e.dst WHERE family = 'b' AND side = 'c'),
flow_{tag} AS MATERIALIZED (SELECT * FROM {edges} WHERE src IN (SELECT v FROM kept_{tag}) AND dst IN (SELECT v FROM kept_{tag}))"""


def bracket_pairs(tag: str, edges: str, pairs: str) -> str:
    """CTE closed_<tag>: the pairs with a way that opens a bracket first and closes one of its label last; needs reach_<tag>."""
    return f"""
closed_{tag} AS MATERIALIZED (
  SELECT DISTINCT p.comp, p.src, p.dst
  FROM {pairs} p JOIN {edges} o ON o.src = p.src AND o.family = 'b' AND o.side = 'o'
  JOIN {edges} c ON c.dst = p.dst AND c.family = 'b' AND c.side = 'c' AND c.label = o.label
  JOIN reach_{tag} r ON r.a = o.dst AND r.b = c.src)"""


def under(edges: str, valueflow: bool = False) -> tuple[str, str]:
    """CTEs and the final SELECT (src, dst) of the under-approximation; with `valueflow` only of ways from a bracket to its like."""
    ctes = walks("u", edges, UNION)
    if not valueflow:
        return ctes, "SELECT src, dst FROM pairs_u"
    used = f"\nuseful AS MATERIALIZED (SELECT * FROM {edges} WHERE eid IN (SELECT unnest(used) FROM hit_u))"
    return ",".join([ctes, used, _reach("u", "useful"), bracket_pairs("u", "useful", "pairs_u")]), "SELECT src, dst FROM closed_u"


def over(edges: str, method: str, rounds: int, labels: int, valueflow: bool = False) -> tuple[str, str]:
    """CTEs and the final SELECT (src, dst) of the over-approximation; labels: the most bracket labels that a component has.

    With `valueflow` the edges are those of flow_edges before the first round and after each, and each round keeps bracket_pairs.
    """
    plan, ctes, results = METHODS[method], [], []
    if valueflow:
        ctes += [_reach("all", edges), flow_edges("all", edges)]
        edges = "flow_all"
    for r in range(rounds):
        # the components that the round before left
        ctes.append(f"""
near_{r}(v, other) AS (
  SELECT src, src FROM {edges} UNION SELECT dst, dst FROM {edges}
  UNION SELECT n.v, CASE WHEN e.src = n.other THEN e.dst ELSE e.src END FROM near_{r} n JOIN {edges} e ON n.other IN (e.src, e.dst)),
parts_{r} AS MATERIALIZED (SELECT v, min(other) AS comp FROM near_{r} GROUP BY v),
e_{r} AS MATERIALIZED (SELECT eid, p.comp, src, dst, family, side, label FROM {edges} JOIN parts_{r} p ON p.v = src)""")
        edges, asked = f"e_{r}", []
        for k, language in enumerate([plan.alpha, plan.beta, *([ERASED] if plan.project else [])]):
            ctes.append(_step(f"{r}_{k}", edges, language))
            edges = f"e_{r}_{k}"
            asked.append(f"SELECT * FROM pairs_{r}_{k}")
        for rank in range(labels if plan.exclude else 0):
            ctes.append(_step(f"{r}_x{rank}", edges, excluding(rank)))
            edges = f"e_{r}_x{rank}"
        if valueflow:
            ctes += [_reach(f"{r}", edges), bracket_pairs(f"{r}", edges, f"pairs_{r}_1"), flow_edges(f"{r}", edges)]
            edges, asked[1] = f"flow_{r}", f"SELECT * FROM closed_{r}"
        ctes.append(f"\nleft_{r} AS MATERIALIZED ({' INTERSECT '.join(asked)})")
        # components that vanish in a round keep what that round found
        results.append(f"SELECT src, dst FROM left_{r}" + (f" WHERE comp NOT IN (SELECT comp FROM {edges})" if r < rounds - 1 else ""))
    settled = f"CASE WHEN (SELECT count(*) FROM e_{rounds - 1}) = (SELECT count(*) FROM {edges}) THEN TRUE ELSE error('more rounds are needed') END"
    return ",".join(ctes), f"SELECT src, dst FROM ({' UNION '.join(results)}) WHERE {settled}"
