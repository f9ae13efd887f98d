"""Registered queries against their SQL twins on the smallest tables, one or two per family."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from segue.plans import registry  # noqa: E402

NAMES = ("adjacent_transitions", "redact_urls", "build_page_metadata", "top_quality_pairs", "explode_media_playlist",
         "lookup_cached", "tolerant_identity_join", "commit_ready_prefix", "voice_occupancy", "render_queue_lines",
         "onset_flux", "mix_quality_metrics", "energy_continuity", "read_restart_snapshot", "read_analysis_store",
         "filter_allowed_urls", "normalize_payloads", "dedupe_segments", "admit_requests", "trim_to_capacity", "validate_analyses",
         "energy_structure", "vocal_risk", "select_start_fold", "explain_rules", "rejected_records", "write_plan_report",
         "track_beats", "tempo_map", "phase_errors", "quality_report", "transition_score", "write_analysis_store", "replay_queue",
         "find_media_node", "analyze_tracks")


def test_every_twin_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, sf, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text, good = check.compare(spark, con, name, registry.queries()[name], registry.oracles()[name], sf)
    assert good, text
