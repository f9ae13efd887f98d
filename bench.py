"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segue.plans import registry  # noqa: E402
from segue.session import build_session  # noqa: E402

HEADLINE = (
    "adjacent_transitions", "filter_allowed_urls", "redact_urls", "build_page_metadata", "normalize_titles",
    "rank_transcodings", "top_quality_pairs", "plan_byte_ranges", "detect_stalled_playlists", "explode_media_playlist",
    "lookup_cached", "tolerant_identity_join", "validate_analyses", "commit_ready_prefix", "replay_queue",
    "voice_occupancy", "render_queue_lines", "onset_flux", "estimate_tempo", "vocal_bin_features", "mix_quality_metrics",
    "tempo_candidates", "energy_continuity", "transition_score", "plan_transitions",
    "dedupe_segments", "admit_requests", "analyze_tracks", "guard_plans", "explain_decisions", "select_start",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in only or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
