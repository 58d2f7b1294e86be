"""Registered queries against their SQL text on the smallest tables, plus rules that hold over the sources."""
from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
FOLDER = "/root/testdata/sf0.001"
NAMES = ["p01_orient", "p06_latest_transactions", "ag02_amount_stats", "ag04_rolling_max", "ag08_mix_divergence", "ag10_transfer_edges", "d01_transaction_burst", "d08_structuring", "d10_impossible_travel",
         "d14_circular_flow", "gr01_projection_edges", "gr05_shortest_path", "gr11_customer_counterparties", "gr15_fan_patterns", "dq01_ingestion_gate", "dq07_audit_flags", "al08_triage_score", "al12_alert_quality",
         "r08_bm25", "r12_rank_fusion", "e03_roc_auc", "st02_unique_ids", "sc01_scores", "sc08_most_cited_transactions", "u01_fifo_dwell", "u02_mule_indicators", "gr07_candidate_cycles",
         "gr09_suspicious_cluster", "gr14_flagged_recipients", "al03_new_alert_rows", "al04_run_events", "al11_kpi_counts", "st05_structuring", "st06_pass_through", "e13_retrieval_benchmark", "r10_cosine_top_k"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry
    from tools.check import compare, connect
    ok, note = compare(spark, connect(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_query_name_is_in_the_survey_form():
    import re

    import __spark_entry__ as entry
    names = entry.queries()
    assert all(re.fullmatch(r"[a-z]+\d\d_[a-z0-9_]+", n) for n in names if n not in entry.LLM_QUERIES)
    assert set(entry.oracle_sql()) <= set(names)


def test_labels_are_read_by_evaluation_only():
    for path in (ROOT / "riskloom" / "operators").glob("*.py"):
        if path.name != "evaluation.py":
            text = path.read_text()
            assert "scenario" not in text and "is_suspicious" not in text, path.name


def test_no_local_checkpoint_and_no_fixed_temporary_folder():
    for path in (ROOT / "riskloom").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "/tmp" not in text, path
