"""Queries of the reachability engine over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import oracle
from weft.functions.labels import classify, masked
from weft.operators import graph
from weft.plans import analyses, memo
from weft.plans.languages import ERASED, METHODS, UNION, Language, excluding
from weft.session import materialise
from weft.sources.tables import event_graph, event_rows, nation_graph, trade_graph, woven_graph

Query = Callable[[SparkSession, str], DataFrame]

LANGUAGES = {
    "under_pairs": UNION, "project_pairs": ERASED, "alpha_default": Language("p"), "alpha_parity": Language("p", 1), "alpha_parity2": Language("p", 2),
    "alpha_se": Language("p", 2, True), "alpha_exclude": excluding(0), "beta_default": Language("b"), "beta_parity": Language("b", 1),
    "beta_parity2": Language("b", 2), "beta_se": Language("b", 2, True),
}


def _events(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(materialise(event_graph(spark, sf_dir)))


def _woven(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(materialise(woven_graph(spark, sf_dir)))


def _short(run: Callable[[DataFrame], DataFrame]) -> Query:
    """On woven pieces of four events, many of which have one shape."""
    return lambda spark, sf_dir: run(materialise(woven_graph(spark, sf_dir, 4)))


def _shapes(edges: DataFrame) -> DataFrame:
    shaped = memo.shapes(graph.split(edges))
    return shaped.groupBy("digest", F.size(F.split("shape", ";")).cast("long").alias("n_edges")).agg(F.count("*").alias("n_components"))


def _nations(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(materialise(nation_graph(spark, sf_dir)))


def _on_demand(parity_d: bool) -> Query:
    def run(edges: DataFrame) -> DataFrame:
        under = materialise(analyses.under_approximation(edges, equal_once=True))
        upper = materialise(analyses.over_approximation(edges, "parity" if parity_d else "all", equal_once=True))
        return analyses.on_demand(edges, under, upper, parity_d, equal_once=True)

    return _events(run)


def _value_flow(edges: DataFrame) -> DataFrame:
    edges = materialise(analyses.value_flow_edges(edges))
    return analyses.over_approximation(edges, "parity2", None, True, equal_once=True)


def _clusters(edges: DataFrame) -> DataFrame:
    return materialise(graph.representatives(graph.closure(edges)))


def _expanded(edges: DataFrame) -> DataFrame:
    rep = _clusters(edges)
    return graph.expand(graph.adjacency(graph.condense(edges, rep)), rep)


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n"), "n_regionkey")
    pairs = nations.withColumnRenamed("n", "src").join(nations.withColumnRenamed("n", "dst"), "n_regionkey").where("src < dst").select("src", "dst")
    return graph.relevant(materialise(nation_graph(spark, sf_dir)), pairs)


def queries() -> dict[str, Query]:
    """Query name to a function of (spark, sf_dir)."""
    language = lambda name: lambda e: analyses.language_pairs(e, LANGUAGES[name])
    found: dict[str, Query] = {
        "edge_labels": lambda spark, sf_dir: classify(event_rows(spark, sf_dir)),
        "paired_labels": lambda spark, sf_dir: event_graph(spark, sf_dir).groupBy("family", "side", "label").agg(F.count("*").alias("n_edges")),
        "adjacency": _events(graph.adjacency),
        "edge_count": _events(lambda e: graph.edge_count(graph.split(e), "comp")),
        "label_masks": _events(lambda e: masked(graph.split(e), LANGUAGES["alpha_parity2"], "comp").select("comp", "family", "label", "rank", "mask").distinct()),
        "wcc": _events(graph.weak_components),
        "useful_edges_alpha": _events(lambda e: analyses.useful_edges(e, LANGUAGES["alpha_parity"])),
        "unknown_pairs": _events(lambda e: analyses.unknown_pairs(e, LANGUAGES["alpha_default"])),
        "intersected_pairs": _events(lambda e: analyses.common_pairs(e, [LANGUAGES[n] for n in ("alpha_default", "beta_default", "project_pairs")])),
        "valueflow_edges": _events(analyses.value_flow_edges),
        "bracket_paths": _events(lambda e: analyses.bracket_pairs(e, analyses.language_pairs(e, LANGUAGES["alpha_default"]))),
        "valueflow_under": _events(lambda e: analyses.under_approximation(e, True, equal_once=True)),
        "closure": _nations(graph.closure),
        "scc": _nations(lambda e: graph.strong_components(e)[0]),
        "scc_reach": _nations(lambda e: graph.strong_components(e)[1]),
        "scc_trade": lambda spark, sf_dir: graph.scc(materialise(trade_graph(spark, sf_dir))),
        "condensed_edges": _nations(lambda e: graph.condense(e, _clusters(e))),
        "expanded_pairs": _nations(_expanded),
        "relevant_edges": _relevant,
        "mr_valueflow": _events(_value_flow),
        "mr_condensed": _events(lambda e: analyses.over_condensed(e, "parity2", equal_once=True)),
        "on_demand_parityD": _on_demand(True),
        "on_demand": _on_demand(False),
    }
    found |= {name: _events(language(name)) for name in LANGUAGES}
    found |= {f"mr_{m}": _events(lambda e, m=m: analyses.over_approximation(e, m, equal_once=True)) for m in METHODS}
    found |= {f"woven_{m}": _woven(lambda e, m=m: analyses.over_approximation(e, m, equal_once=True)) for m in METHODS}
    found |= {"woven_under": _woven(lambda e: analyses.under_approximation(e, equal_once=True)), "woven_valueflow_under": _woven(lambda e: analyses.under_approximation(e, True, equal_once=True)), "woven_valueflow": _woven(_value_flow)}
    found |= {f"memo_{m}": _short(lambda e, m=m: analyses.over_approximation(e, m, equal_once=True)) for m in ("parity2", "all")}
    found |= {"memo_under": _short(lambda e: analyses.under_approximation(e, equal_once=True)), "memo_shapes": _short(_shapes)}
    return found


# --- SQL --------------------------------------------------------------------------------------------------------------------------

_RAW = """
raw AS (
  SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id, ts,
         CASE event_type WHEN 'signup' THEN 'p' WHEN 'purchase' THEN 'p' WHEN 'click' THEN 'b' WHEN 'view' THEN 'b' WHEN 'error' THEN 'n' END AS family,
         CASE event_type WHEN 'signup' THEN 'o' WHEN 'click' THEN 'o' WHEN 'purchase' THEN 'c' WHEN 'view' THEN 'c' ELSE 'n' END AS side,
         CASE event_type WHEN 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 END AS label
  FROM events)"""

_EDGES = (
    _RAW
    + """,
halves AS (SELECT family, label FROM raw WHERE dst IS NOT NULL AND family <> 'n' GROUP BY ALL HAVING bool_or(side = 'o') AND bool_or(side = 'c')),
kept AS (SELECT * FROM raw WHERE dst IS NOT NULL AND (family = 'n' OR (family, label) IN (SELECT (family, label) FROM halves))),
-- chains: a new one begins where the edge before doesn't lead here
marked AS (SELECT *, CASE WHEN lag(dst) OVER (PARTITION BY user_id ORDER BY ts, src) = src THEN 0 ELSE 1 END AS new FROM kept),
chained AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, src) AS part FROM marked),
e AS (
  SELECT src, dst, family, side, label, row_number() OVER (PARTITION BY user_id, part ORDER BY ts, src) AS pos,
         least(min(src) OVER (PARTITION BY user_id, part), min(dst) OVER (PARTITION BY user_id, part)) AS comp,
         dense_rank() OVER (PARTITION BY user_id, part, family ORDER BY label) - 1 AS rnk
  FROM chained)"""
)

_CHAINS = ",\nchains AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) AS eid, comp, src, dst, family, side, label FROM e)"

_WOVEN = """
placed AS (
  SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS k, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS piece, ts
  FROM events),
ahead AS (
  SELECT *, lead(event_id) OVER o AS id1, lead(event_id, 2) OVER o AS id2, lead(kind) OVER o AS kind1, lead(k) OVER o AS k1
  FROM placed WINDOW o AS (PARTITION BY user_id, piece ORDER BY ts, event_id)),
drawn AS (
  SELECT event_id AS src, id1 AS dst, kind, k FROM ahead UNION SELECT event_id, id1, kind1, k1 FROM ahead UNION SELECT event_id, id2, kind1, k1 FROM ahead),
named AS (
  SELECT DISTINCT src, dst, CASE kind WHEN 'signup' THEN 'p' WHEN 'purchase' THEN 'p' WHEN 'click' THEN 'b' WHEN 'view' THEN 'b' WHEN 'error' THEN 'n' END AS family,
         CASE kind WHEN 'signup' THEN 'o' WHEN 'click' THEN 'o' WHEN 'purchase' THEN 'c' WHEN 'view' THEN 'c' ELSE 'n' END AS side,
         CASE kind WHEN 'error' THEN 0 ELSE k END AS label
  FROM drawn WHERE dst IS NOT NULL),
woven AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY src, dst, family, side, label) AS eid, 0 AS comp, * FROM named
  WHERE family = 'n' OR (family, label) IN (SELECT (family, label) FROM named GROUP BY family, label HAVING bool_or(side = 'o') AND bool_or(side = 'c')))"""


def _language_sql(language: Language) -> str:
    """CTEs that walk every chain from every vertex with a stack and the state; `pairs` are those accepted."""
    counted = f"family = '{language.counted}'" if language.counted else "FALSE"
    token = "'x;'" if language.balanced == "erased" else "family || label || ';'"
    bit = "0" if not language.k else f"CAST(1 << (rnk % {language.k}) AS INTEGER)" if language.exclude is None else f"CASE WHEN rnk = {language.exclude} THEN 0 ELSE CAST(1 << (rnk % {language.k}) AS INTEGER) END"
    ends = "AND (first = 'n' OR (first = 'o' AND last = 'c'))" if language.endpoints else ""
    return f"""
s AS (SELECT src, dst, side, family = 'n' AS plain, {counted} AS counted, {token} AS token, {bit} AS bit FROM e),
walk(start, here, stack, mask, first, last) AS (
  SELECT src, src, '', 0, 'n', 'n' FROM s
  UNION ALL
  SELECT w.start, s.dst,
         CASE WHEN plain OR counted THEN stack WHEN side = 'o' THEN stack || token ELSE left(stack, length(stack) - length(token)) END,
         CASE WHEN counted THEN xor(mask, bit) ELSE mask END,
         CASE WHEN counted AND first = 'n' THEN side ELSE first END,
         CASE WHEN counted THEN side ELSE last END
  FROM walk w JOIN s ON s.src = w.here
  WHERE plain OR counted OR side = 'o' OR ends_with(stack, token)),
pairs AS (SELECT DISTINCT start AS src, here AS dst FROM walk WHERE start <> here AND stack = '' AND mask = 0 {ends})"""


_SHAPES = (
    """
near(v, w) AS (
  SELECT src, src FROM woven UNION SELECT dst, dst FROM woven
  UNION SELECT n.v, CASE WHEN e.src = n.w THEN e.dst ELSE e.src END FROM near n JOIN woven e ON n.w IN (e.src, e.dst)),
part AS MATERIALIZED (SELECT v, min(w) AS comp, dense_rank() OVER (PARTITION BY min(w) ORDER BY v) AS number FROM near GROUP BY v),
numbered AS (
  SELECT a.comp, a.number AS a, b.number AS b, family, side, dense_rank() OVER (PARTITION BY a.comp ORDER BY family, label) AS name
  FROM woven JOIN part a ON src = a.v JOIN part b ON dst = b.v),
shaped AS (SELECT comp, sha256(string_agg(concat_ws(',', a, b, family, side, name), ';' ORDER BY a, b, family, side, name)) AS digest, count(*) AS n_edges FROM numbered GROUP BY comp)""",
    "SELECT digest, n_edges, count(*) AS n_components FROM shaped GROUP BY ALL",
)

_NATIONS = """
sums AS (
  SELECT c_nationkey::BIGINT AS buyer, s_nationkey::BIGINT AS seller, sum(l_quantity) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
g AS (
  SELECT src, dst, 'b' AS family, side, (n_regionkey % 2)::BIGINT AS label FROM (
    SELECT buyer AS src, seller AS dst, 'o' AS side, row_number() OVER (PARTITION BY buyer ORDER BY amount DESC, seller) AS n FROM sums
    UNION ALL
    SELECT seller, buyer, 'c', row_number() OVER (PARTITION BY seller ORDER BY amount DESC, buyer) FROM sums) t
  JOIN nation ON n_nationkey = src WHERE n = 1),
reach(src, dst) AS (
  SELECT src, src FROM g UNION SELECT dst, dst FROM g
  UNION SELECT r.src, g.dst FROM reach r JOIN g ON r.dst = g.src),
scc AS (SELECT a.src AS vertex, min(a.dst) AS scc FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"""

_CONDENSED = (
    _NATIONS
    + """,
moved AS (SELECT DISTINCT a.scc AS src, b.scc AS dst, family, side, label FROM g JOIN scc a ON g.src = a.vertex JOIN scc b ON g.dst = b.vertex),
condensed AS (
  SELECT * FROM moved WHERE label IN (SELECT label FROM moved GROUP BY label HAVING bool_or(side = 'o') AND bool_or(side = 'c')))"""
)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that one statement can express."""
    on_events = lambda ctes, tail: f"WITH RECURSIVE {_EDGES}{ctes} {tail}"
    walks = lambda name: "," + _language_sql(LANGUAGES[name])

    def renamed(name: str, tag: str) -> str:
        sql = walks(name)
        for cte in ("walk", "pairs"):
            sql = sql.replace(f"{cte}(", f"{cte}_{tag}(").replace(f"{cte} ", f"{cte}_{tag} ")
        return sql.replace("\ns AS", f"\ns_{tag} AS").replace("FROM s\n", f"FROM s_{tag}\n").replace("JOIN s ON s.src", f"JOIN s_{tag} s ON s.src")

    # on chains and pieces with two labels six rounds settle everything; the statement fails where they don't
    chained = lambda ctes, result: f"WITH RECURSIVE {_EDGES}{_CHAINS},{ctes} {result}"
    woven = lambda ctes, result: f"WITH RECURSIVE {_WOVEN},{ctes} {result}"

    found = {name: on_events(walks(name), "SELECT src, dst FROM pairs") for name in LANGUAGES}
    found |= {f"mr_{m}": chained(*oracle.over("chains", m, 6, 2)) for m in METHODS}
    found |= {f"woven_{m}": woven(*oracle.over("woven", m, 6, 2)) for m in METHODS}
    found |= {"valueflow_under": chained(*oracle.under("chains", True)), "mr_valueflow": chained(*oracle.over("chains", "parity2", 6, 2, True))}
    found |= {"woven_under": woven(*oracle.under("woven")), "woven_valueflow_under": woven(*oracle.under("woven", True)), "woven_valueflow": woven(*oracle.over("woven", "parity2", 6, 2, True))}
    short = lambda ctes, result: f"WITH RECURSIVE {_WOVEN.replace('// 8', '// 4')},{ctes} {result}"
    found |= {"memo_under": short(*oracle.under("woven")), "memo_shapes": short(*_SHAPES)}
    found |= {f"memo_{m}": short(*oracle.over("woven", m, 6, 2)) for m in ("parity2", "all")}
    # where known pairs make no cycle there is nothing to condense
    found["mr_condensed"] = found["mr_parity2"]
    found |= {
        "edge_labels": f"WITH {_RAW} SELECT DISTINCT src, dst, family, side, label FROM raw WHERE dst IS NOT NULL",
        "paired_labels": f"WITH {_EDGES} SELECT family, side, label, count(*) AS n_edges FROM e GROUP BY ALL",
        "adjacency": f"WITH {_EDGES} SELECT DISTINCT src, dst FROM e",
        "edge_count": f"WITH {_EDGES} SELECT comp, count(*) AS n_edges FROM e GROUP BY comp",
        "label_masks": f"WITH {_EDGES} SELECT DISTINCT comp, family, label, CASE WHEN family = 'n' THEN 0 ELSE rnk END AS rank, CASE WHEN family = 'b' THEN CAST(1 << (rnk % 2) AS INTEGER) ELSE 0 END AS mask FROM e",
        "wcc": f"WITH {_EDGES} SELECT DISTINCT unnest([src, dst]) AS vertex, comp AS component FROM e",
        "useful_edges_alpha": on_events(
            walks("alpha_parity") + ", place AS (SELECT comp, src AS v, pos FROM e UNION SELECT comp, dst, pos + 1 FROM e), spans AS (SELECT a.comp, a.pos AS low, b.pos AS high FROM pairs JOIN place a ON a.v = pairs.src JOIN place b ON b.v = pairs.dst)",
            "SELECT src, dst, family, side, label FROM e WHERE EXISTS (SELECT 1 FROM spans WHERE spans.comp = e.comp AND low <= e.pos AND e.pos < high)",
        ),
        "unknown_pairs": on_events(renamed("alpha_default", "a") + renamed("under_pairs", "u"), "SELECT * FROM pairs_a EXCEPT SELECT * FROM pairs_u"),
        "intersected_pairs": on_events(renamed("alpha_default", "a") + renamed("beta_default", "b") + renamed("project_pairs", "c"), "SELECT * FROM pairs_a INTERSECT SELECT * FROM pairs_b INTERSECT SELECT * FROM pairs_c"),
        "valueflow_edges": on_events(
            ", bound AS (SELECT comp, min(CASE WHEN family = 'b' AND side = 'o' THEN pos END) AS low, max(CASE WHEN family = 'b' AND side = 'c' THEN pos + 1 END) AS high FROM e GROUP BY comp)",
            "SELECT src, dst, family, side, label FROM e JOIN bound USING (comp) WHERE pos >= low AND pos + 1 <= high",
        ),
        "bracket_paths": on_events(
            walks("alpha_default"),
            "SELECT pairs.src, pairs.dst FROM pairs JOIN e a ON a.src = pairs.src AND a.family = 'b' AND a.side = 'o' JOIN e b ON b.dst = pairs.dst AND b.family = 'b' AND b.side = 'c' WHERE a.label = b.label AND a.comp = b.comp AND a.pos < b.pos",
        ),
        "closure": f"WITH RECURSIVE {_NATIONS} SELECT src, dst FROM reach",
        "scc": f"WITH RECURSIVE {_NATIONS} SELECT vertex, scc FROM scc",
        "scc_reach": f"WITH RECURSIVE {_NATIONS} SELECT DISTINCT a.scc AS a, b.scc AS b FROM reach JOIN scc a ON reach.src = a.vertex JOIN scc b ON reach.dst = b.vertex",
        "scc_trade": """WITH RECURSIVE t AS (
              SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN o_custkey::BIGINT * 2 ELSE l_suppkey::BIGINT * 2 + 1 END AS src,
                     CASE l_returnflag WHEN 'A' THEN l_suppkey::BIGINT * 2 + 1 ELSE o_custkey::BIGINT * 2 END AS dst
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 7 AND l_returnflag IN ('A', 'R')),
            reach(src, dst) AS (SELECT src, src FROM t UNION SELECT dst, dst FROM t UNION SELECT r.src, t.dst FROM reach r JOIN t ON r.dst = t.src)
            SELECT a.src AS vertex, min(a.dst) AS scc FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""",
        "condensed_edges": f"WITH RECURSIVE {_CONDENSED} SELECT src, dst, family, side, label FROM condensed",
        "expanded_pairs": f"""WITH RECURSIVE {_CONDENSED}
            SELECT a.vertex AS src, b.vertex AS dst FROM (SELECT DISTINCT src, dst FROM condensed) c JOIN scc a ON a.scc = c.src JOIN scc b ON b.scc = c.dst
            UNION SELECT a.vertex, b.vertex FROM scc a JOIN scc b ON a.scc = b.scc AND a.vertex <> b.vertex""",
        "relevant_edges": f"""WITH RECURSIVE {_NATIONS}
            SELECT src, dst, family, side, label FROM g WHERE EXISTS (
              SELECT 1 FROM nation s JOIN nation t ON s.n_regionkey = t.n_regionkey AND s.n_nationkey < t.n_nationkey
              JOIN reach x ON x.src = s.n_nationkey AND x.dst = g.src JOIN reach y ON y.src = g.dst AND y.dst = t.n_nationkey)""",
    }
    return found
