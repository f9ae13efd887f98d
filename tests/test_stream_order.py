"""Folds over shuffled streams equal the batch results; expired keys leave the store."""

import random

import pytest
from pyspark.sql import functions as F

from segue.operators import manifests, queues
from segue.plans import queue_queries as Q
from segue.plans.tables import table
from segue.streaming import ordered

LAST = "2031-01-01 00:00:00"


def shuffled_stream(spark, df, folder, at, files=4, reach=40):
    """The rows of ``df`` (in event-time order) written to several files, each row up to ``reach`` places from its own."""
    rng = random.Random(1)
    rows = df.orderBy(at).collect()
    order = sorted(range(len(rows)), key=lambda k: k + rng.uniform(0, reach))
    size = -(-len(rows) // files)
    for k in range(files):
        part = [rows[i] for i in order[k * size : (k + 1) * size]]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")


def drain(stream, name, folder):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp-{name}")
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    return stream.sparkSession.table(name), query


def timed(df, step="1 second"):
    """Event time by place in the log, and a closing row far ahead that moves the watermark past all others."""
    return df.withColumn("at", F.expr("timestamp_seconds(1700000000 + event_id)"))


def same(got, want, cols):
    left, right = (sorted(map(str, d.select(*cols).collect())) for d in (got, want))
    assert left == right and left


def closing(spark, df, **values):
    row = {f.name: None for f in df.schema.fields} | values
    return df.unionByName(spark.createDataFrame([tuple(row.values())], df.schema).withColumn("at", F.lit(LAST).cast("timestamp")))


def test_shuffled_replay_equals_batch(spark, sf, folder):
    log = table(spark, sf, "events").selectExpr(f"{Q.GUILD} AS guild", "event_id", f"{Q.ACTION} AS action").limit(400)
    log = timed(log)
    stream = shuffled_stream(spark, closing(spark, log, guild=-1, event_id=10**6, action="skip"), folder, "at")
    got, _ = drain(ordered.replay_queue_stream(stream, "guild", "at", ["event_id"], delay="2 minutes"), "shuffled_replay", folder)
    want = queues.replay_queue(log.withColumn("part", F.expr("event_id div 64")), "guild", ["part"], ["event_id"])
    same(got.where("guild >= 0"), want, ["guild", "event_id", "present", "looping", "automix", "outcome"])


def test_shuffled_occupancy_and_segments_equal_batch(spark, sf, folder):
    log = timed(table(spark, sf, "events").selectExpr(*Q._cols(Q.VOICE)).limit(400))
    stream = shuffled_stream(spark, closing(spark, log, guild=-1, event_id=10**6, kind="bot_move", user=1), f"{folder}/a", "at")
    got, _ = drain(ordered.voice_occupancy_stream(stream, "guild", "at", ["event_id"], delay="2 minutes"), "shuffled_voice", folder)
    want = queues.voice_occupancy(log.withColumn("part", F.expr("event_id div 100")), "guild", ["part"], ["event_id"])
    same(got.where("guild >= 0"), want, ["guild", "event_id", "people", "decision"])
    lines = table(spark, sf, "events").selectExpr("user_id % 5 AS stream", "event_id", f"{Q.SEGMENT} AS url").limit(400)
    lines = timed(lines)
    stream = shuffled_stream(spark, closing(spark, lines, stream=-1, event_id=10**6, url="x"), f"{folder}/b", "at")
    got, _ = drain(ordered.dedupe_segments_stream(stream, "stream", "at", ["event_id"], 4, delay="2 minutes"), "shuffled_segments", folder)
    want = manifests.dedupe_segments(lines.withColumn("part", F.expr("event_id div 90")), "stream", "part", ["event_id"], 4)
    same(got.where("stream >= 0"), want, ["stream", "event_id", "url"])


@pytest.mark.parametrize("ttl,outcome", [(None, "queued"), (600, "now_playing")])
def test_silent_keys_expire(spark, folder, ttl, outcome):
    """Guild 1 enqueues, is silent for hours while guild 2 moves the watermark, and enqueues again."""
    rows = [[(1, 1, "enqueue", 0), (2, 2, "enqueue", 10)], [(2, 3, "skip", 4000)], [(2, 4, "skip", 8000)], [(1, 5, "enqueue", 9000)],
            [(2, 6, "skip", 20000)], [(2, 7, "skip", 30000)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "guild int, event_id long, action string, s long").selectExpr(
            "guild", "event_id", "action", "timestamp_seconds(1700000000 + s) AS at").coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema("guild int, event_id long, action string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    name = f"expiring_{ttl}"
    got, query = drain(ordered.replay_queue_stream(stream, "guild", "at", ["event_id"], delay="1 minute", ttl_seconds=ttl), name, folder)
    verdicts = {r.event_id: r.outcome for r in got.collect()}
    assert verdicts[1] == "now_playing" and verdicts[5] == outcome
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert left


def test_late_resolutions_are_admitted_in_order(spark, sf, folder):
    log = Q.admit_requests(spark, sf).where("moment < 4000").withColumn("event_id", F.col("moment"))
    raw = timed(log.drop("verdict"))
    stream = shuffled_stream(spark, closing(spark, raw, guild=-1, id=1, moment=10**7, kind="advance", event_id=10**7), folder, "at")
    got, _ = drain(ordered.admit_requests_stream(stream, "guild", "at", ["moment", "id"], Q.MAX_QUEUE, Q.MAX_PENDING, delay="20 minutes"),
                   "shuffled_admission", folder)
    same(got.where("guild >= 0"), log, ["guild", "moment", "id", "kind", "verdict"])
