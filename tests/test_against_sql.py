"""Queries against their SQL texts. REVGRAIN_ALL=1 runs every registered query."""

import os

import pytest

from checks.compare import compare, connect
from revgrain.plans import catalog

SF = "/root/testdata/sf0.01"
SOME = [
    "search_topk", "reference_search", "aggregate_findings", "traceability_problems", "parse_hunks", "changed_files", "bandit_reports",
    "build_plans", "ground_citations", "citations_strict", "plan_scores", "budget_flags", "follow_up_cost", "issue_metrics", "fill_slots",
    "slot_status", "minimum_contract_with_claims", "context_windows", "snippet_windows", "vector_topk", "python_calls", "resolve_symbols",
    "call_graph", "active_jobs", "versioned_upsert", "list_runs", "question_keywords", "recover_json", "job_event_log_stream",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES) if os.environ.get("REVGRAIN_ALL") else SOME)
def test_same_rows(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_every_text_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
