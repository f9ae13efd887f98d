"""Nothing is dropped for its size; folds take a fixed number of jobs; URL and reject rules."""

import json

import pytest
from pyspark.sql import functions as F

from segue.functions import urls as U
from segue.functions.fold import ordered_fold
from segue.operators import freshness, manifests, signals, transitions
from segue.sources import tables as S


def test_snapshot_keeps_the_whole_queue(spark):
    queue = spark.range(600).selectExpr("1L AS guild_id", "id AS pos", "concat('u', id) AS url")
    guilds = spark.createDataFrame([(1, 2, "now", 5, False, True, True)],
                                   "guild_id long, channel_id long, current_url string, position_ms long, looping boolean, automix boolean, active boolean")
    row = S.snapshot_connections(guilds, queue).first()
    assert row.playback.queued_source_urls == [f"u{k}" for k in range(600)]


def test_snapshot_written_and_read_back(spark, folder):
    queue = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "guild_id long, pos long, url string")
    guilds = spark.createDataFrame([(1, 2, "now", 5, True, False, True), (2, 0, "x", 1, False, False, True)],
                                   "guild_id long, channel_id long, current_url string, position_ms long, looping boolean, automix boolean, active boolean")
    S.write_restart_snapshot(S.snapshot_connections(guilds, queue), f"{folder}/snap")
    usable, rejected = S.read_restart_snapshot(spark, f"{folder}/snap")
    assert [r.guild_id for r in usable.collect()] == [1]
    assert [(r.guild_id, r.reject_reason) for r in rejected.collect()] == [(2, "no guild or channel")]
    none = spark.createDataFrame([], "url string")
    assert [r.url for r in S.restore_order(usable, none).orderBy("step").collect()] == ["now", "a", "b"]


def test_readers_return_rejects(spark, folder):
    rows = [{"type": "track_started", "guild_id": 1, "session_id": 2, "playback_id": 3}, {"type": "odd"}, {"type": "voice_disconnected", "guild_id": 1}]
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(f"{folder}/events")
    usable, rejected = S.read_runtime_events(spark, f"{folder}/events")
    assert usable.count() == 1 and {r.reject_reason for r in rejected.collect()} == {"unknown type", "missing field"}
    tracks = [{"canonical_key": "k", "prepared": {"kind": "http", "url": "u"}}, {"canonical_key": "f", "prepared": {"kind": "ftp"}}, {"canonical_key": "n"}]
    spark.createDataFrame([(json.dumps(r),) for r in tracks], "value string").write.text(f"{folder}/tracks")
    usable, rejected = S.read_track_requests(spark, f"{folder}/tracks")
    assert [r.canonical_key for r in usable.collect()] == ["k"]
    assert {(r.canonical_key, r.reject_reason) for r in rejected.collect()} == {("f", "unknown source kind"), ("n", "no source")}


def test_long_tracks_are_analysed(spark):
    n = 31 * 60 * 4
    quiet = f"CASE WHEN id < 80 OR id >= {n} - 80 THEN 0.01D ELSE 0.5D END"
    envelope = spark.range(n).selectExpr("1L AS track", "id AS idx", f"{quiet} AS rms")
    bounds = spark.createDataFrame([(1, 0.0, n / 4)], "track long, audible_start_s double, audible_end_s double")
    row = signals.energy_structure(envelope, bounds).first()
    assert abs(row.intro_end_s - 20) <= 1.5 and abs(row.outro_start_s - (n / 4 - 20)) <= 1.5
    features = spark.range(n + 200).selectExpr("1L AS track", "id AS bin", "0.5D AS full_rms", "0.5D AS vocal_ratio", "0.5D AS voicing",
                                               "0.5D AS modulation", "0.5D AS duty", "0.1D AS zcr", "2.0D AS crest")
    risk = signals.vocal_risk(features, True)
    assert risk.count() == n + 200
    plan = risk._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_decimation_keeps_long_tracks(spark):
    samples = spark.range(4000).selectExpr("1L AS track", "id AS idx", "CAST(id AS DOUBLE) AS value")
    assert signals.decimate_mean(samples, 2, 1).count() == 2000


def test_caches_without_a_cap_keep_all(spark):
    rows = [("known", k, k // 7) for k in range(50)] + [("unheard", k, 1) for k in range(20)] + [("zero", 1, 1)]
    entries = spark.createDataFrame(rows, "cache string, key long, at long")
    kept = freshness.trim_to_capacity(entries, "cache", "key", "at", F.lit(False), {"known": 10, "zero": 0}).collect()
    want = sorted(((c, k, t) for c, k, t in rows if c == "known"), key=lambda r: (-r[2], -r[1]))[:10]
    assert sorted((r.cache, r.key, r.at) for r in kept) == sorted(want + [r for r in rows if r[0] == "unheard"])


def test_pair_without_analysis_is_an_error_row(spark):
    tracks = spark.createDataFrame([(1, "a"), (2, "b")], "track long, t string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 1)], "outgoing long, incoming long")
    rows = {(r.outgoing, r.incoming): r.error for r in transitions.with_tracks(pairs, tracks).collect()}
    assert rows == {(1, 2): None, (2, 3): "incoming analysis unavailable", (4, 1): "outgoing analysis unavailable"}


@pytest.mark.parametrize("url,host", [
    ("https://evil.test\\@youtube.com/", "evil.test"), ("https://youtube.com:65535/x", "youtube.com"), ("https://youtube.com:65536/x", None),
    ("https://youtube.com:99999/", None), ("https://youtube.com:000080/", "youtube.com"), ("https://a@b@youtube.com/", "youtube.com"),
    ("https://youtube.com\\path", "youtube.com"), ("https://user:pw@YouTube.com", "youtube.com"), ("https:youtube.com", None)])
def test_url_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(U.host(F.col("u")).alias("h")).first().h == host


def count_jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group)), found


def test_fold_jobs_do_not_grow_with_chunks(spark):
    """URLs that cycle just beyond the memory never settle by guessing; the result is right and the jobs are as many."""
    jobs = []
    for chunks in (10, 40):
        lines = spark.range(chunks * 50).selectExpr("1L AS stream", "concat('u', id % 9) AS url", "id AS line_no", "id div 50 AS part")
        fold = lambda: ordered_fold(lines, ["stream"], "part", ["line_no"], manifests.recent_links_step(8), {"urls": []}, "_fresh", "boolean")  # noqa: E731,B023
        n, rows = count_jobs(spark, lambda: fold().orderBy("line_no").collect())  # noqa: B023
        state = {"urls": []}
        assert [r._fresh for r in rows] == manifests.recent_links_step(8)(state, {"url": [r.url for r in rows]})
        jobs.append(n)
    assert jobs[1] <= jobs[0] + 2
