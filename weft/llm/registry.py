"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm import asof_features, best_fit_packing, budget_mix, chat_events, crf_toxicity, dart_minhash, media, mil_quality, ppm_language, prefix_trie, rp_forest, suffix_dedup, weak_quality

ORACLES = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, x -> x <> 0)) > 0 AS sound
  FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.sound AND b.sound
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN comp ON comp.x = v.vec_id LEFT JOIN deg ON deg.x = v.vec_id""",
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_point_in_time": asof_features.ORACLE,
    "op13_weak_quality": weak_quality.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of (spark, sf_dir)."""
    return {
        "op1_embedding_near_dedup": rp_forest.op1_embedding_near_dedup,
        "op2_source_mix": budget_mix.op2_source_mix,
        "op3_quality": mil_quality.op3_quality,
        "op4_minhash_near_dedup": dart_minhash.op4_minhash_near_dedup,
        "op5_language_id": ppm_language.op5_language_id,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_toxicity": crf_toxicity.op7_toxicity,
        "op8_media": media.op8_media,
        "op9_chat_format": chat_events.op9_chat_format,
        "op10_packing": best_fit_packing.op10_packing,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_point_in_time": asof_features.op12_point_in_time,
        "op13_weak_quality": weak_quality.op13_weak_quality,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express on whole tables."""
    return dict(ORACLES)
