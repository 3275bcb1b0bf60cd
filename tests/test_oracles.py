"""Registered queries against their SQL at the smallest scale; the full list runs with tools/compare.py."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
SF = "/root/testdata/sf0.001"
NAMES = [
    "chunk_windows", "postings", "term_stats", "lexical_topk", "knn_exact", "rrf_fusion", "hybrid_search",
    "coordinated_search", "evaluate_retrieval", "exact_duplicates", "corpus_near_duplicates", "rollup_turn_metrics",
    "admit_evidence", "admit_evidence_strict", "trim_history", "route_queries", "decompose", "build_plans", "run_plans",
    "heading_paths", "section_documents", "page_contexts", "fold_state", "grade_answers", "rate_limit", "tool_loop",
    "tool_timeline", "fold_turn_events", "detect_other_library", "bm25_max_child", "stored_terms", "knn_recall",
    "coordinated_hybrid", "paged_blocks", "paged_block_chunks", "metric_windows", "extractor_statuses", "extracted_facts",
    "check_progression", "check_options", "answer_guidance", "evaluation_targets",
]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    import __spark_entry__ as entry
    from compare import compare, connect

    outcome = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    spark.catalog.clearCache()
    assert outcome.startswith("ok"), outcome


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
