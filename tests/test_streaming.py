"""Streaming results equal the batch results on the same log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from segue.operators import freshness, manifests, queues
from segue.plans import queue_queries as Q
from segue.plans.tables import table
from segue.streaming import jobs


def as_stream(spark, df, folder, key):
    """Write a log as several files in key order and read it back as a stream."""
    for part in range(3):
        bounds = df.selectExpr(f"min({key}) AS lo", f"max({key}) AS hi").first()
        step = (bounds.hi - bounds.lo) // 3 + 1
        low = bounds.lo + part * step
        df.where((F.col(key) >= low) & (F.col(key) < low + step)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return stream.sparkSession.table(name)


def same(a, b, cols):
    left = sorted(map(str, a.select(*cols).collect()))
    right = sorted(map(str, b.select(*cols).collect()))
    assert left == right and left


def test_replay_stream_equals_batch(spark, sf, folder):
    log = table(spark, sf, "events").selectExpr(f"{Q.GUILD} AS guild", "event_id", f"{Q.ACTION} AS action").coalesce(1)
    got = drain(jobs.replay_queue_stream(as_stream(spark, log, folder, "event_id")), "replayed")
    want = queues.replay_queue(log.withColumn("part", F.expr("event_id div 64")), "guild", ["part"], ["event_id"])
    same(got, want, ["guild", "event_id", "present", "looping", "automix", "outcome"])


def test_occupancy_stream_equals_batch(spark, sf, folder):
    log = table(spark, sf, "events").selectExpr(*Q._cols(Q.VOICE)).coalesce(1)
    got = drain(jobs.voice_occupancy_stream(as_stream(spark, log, folder, "event_id")), "occupied")
    want = queues.voice_occupancy(log.withColumn("part", F.expr("event_id div 100")), "guild", ["part"], ["event_id"])
    same(got, want, ["guild", "event_id", "people", "decision"])


def test_dedupe_stream_equals_batch(spark, sf, folder):
    lines = table(spark, sf, "events").selectExpr("user_id % 5 AS stream", "event_id AS line_no", f"{Q.SEGMENT} AS url").coalesce(1)
    got = drain(jobs.dedupe_segments_stream(as_stream(spark, lines, folder, "line_no"), capacity=4), "deduped")
    want = manifests.dedupe_segments(lines.withColumn("part", F.expr("line_no div 90")), "stream", "part", ["line_no"], 4)
    same(got, want, ["stream", "line_no", "url"])


def test_admission_stream_equals_batch(spark, sf, folder):
    log = Q.admit_requests(spark, sf)
    raw = log.drop("verdict").coalesce(1)
    got = drain(jobs.admit_requests_stream(as_stream(spark, raw, folder, "moment"), max_queue=Q.MAX_QUEUE, max_pending=Q.MAX_PENDING), "admitted")
    same(got, log, ["guild", "moment", "id", "kind", "verdict"])


def test_commit_stream_releases_in_sequence(spark, folder):
    rows = [(1, s, 100 - 7 * s, s != 2) for s in (3, 1, 0, 2, 5)]
    df = spark.createDataFrame(rows, "guild long, seq long, resolved_at long, ok boolean").coalesce(1)
    got = drain(jobs.commit_ready_prefix_stream(as_stream(spark, df, folder, "resolved_at")), "committed_rows")
    assert [(r.seq, r.commit_at, r.outcome) for r in got.orderBy("seq").collect()] == [
        (0, 100, "committed"), (1, 100, "committed"), (2, 100, "failed"), (3, 100, "committed")]


def test_stale_and_coalesced_streams(spark, folder):
    rows = [(1, 1, 5, "end", "2024-01-01 00:00:00"), (1, 1, 5, "end", "2024-01-01 00:00:05"), (1, 2, 6, "end", "2024-01-01 00:00:06")]
    df = spark.createDataFrame(rows, "guild int, session int, playback int, kind string, at string").selectExpr(
        "* EXCEPT (at)", "CAST(at AS TIMESTAMP) AS at").coalesce(1)
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    current = spark.createDataFrame([(1, 1, 5)], "guild int, session int, playback int")
    live = drain(jobs.drop_stale_events_stream(stream, current, ["guild", "session", "playback"], "kind", "at"), "live_events")
    assert live.count() == 1


def test_coalesced_stream_equals_batch(spark, folder):
    """The last row moves the watermark past all windows before it."""
    rows = [(g, k, f"2024-01-01 00:{m:02d}:00") for k, (g, m) in enumerate([(1, 1), (1, 2), (2, 3), (1, 11), (1, 19), (2, 21)])]
    df = spark.createDataFrame([*rows, (9, 99, "2024-01-01 09:00:00")], "guild int, id int, at string").selectExpr(
        "* EXCEPT (at)", "CAST(at AS TIMESTAMP) AS at").coalesce(1)
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    led = drain(jobs.coalesce_requests_stream(stream, "guild", "at", ["id"]), "led_requests")
    same(led, freshness.coalesce_requests(df.where("guild < 9"), "guild", "at", ["id"]), ["guild", "window_start", "id", "requests"])
