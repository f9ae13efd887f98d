"""Registered freshness, lookup and data-quality queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.operators import freshness as ops
from segue.plans.tables import (BROKEN_SQL, LISTENER_QUEUE_SQL, broken_catalog, listener_queue, table)

RECORD = {
    "asked_url": "concat('https://a.example.com/', user_id % 50)",
    "requested_url": "concat('https://r.example.com/', user_id % 20, event_type)",
    "canonical_url": "concat('https://c.example.com/', user_id)",
    "canonical_key": "concat('k', user_id, event_type)",
    "written": "event_id",
}


def _cols(exprs):
    return [f"{e} AS {n}" for n, e in exprs.items()]


def build_alias_index(spark, sf):
    return ops.build_alias_index(table(spark, sf, "events").selectExpr(*_cols(RECORD)), ["written"])


PROVIDER = "CASE event_type WHEN 'click' THEN 'soundcloud' WHEN 'view' THEN 'youtube' WHEN 'error' THEN 'x' ELSE 'vimeo' END"
MIDNIGHT = 1706659200


def lookup_cached(spark, sf):
    events = table(spark, sf, "events").withColumn("s", F.unix_timestamp("ts"))
    last = events.groupBy("user_id").agg(F.max("s").alias("s"))
    aliases = last.selectExpr("concat('https://c.example.com/', user_id) AS url", "concat('k', user_id) AS canonical_key", "s AS cached_at_s")
    metadata = last.selectExpr("concat('k', user_id) AS canonical_key", "s - 600 AS cached_at_s", "concat('m', user_id) AS record")
    prepared = (events.where("event_type <> 'view'").groupBy("user_id").agg(F.max(F.struct("event_id", "s", "event_type")).alias("w"))
                .selectExpr("concat('k', user_id) AS canonical_key", "w.s AS cached_at_s", "concat('p', user_id) AS record",
                            f"{PROVIDER.replace('event_type', 'w.event_type')} AS provider",
                            "CASE WHEN user_id % 3 = 0 THEN w.s + 120 END AS expires_at"))
    requests = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "concat('https://c.example.com/', o_custkey % 200) AS url",
        f"{MIDNIGHT} - (o_orderkey * 7) % 40000 AS as_of_s")
    return ops.lookup_cached(requests, aliases, metadata, prepared)


def filter_fresh(spark, sf):
    df = table(spark, sf, "events").withColumn("s", F.unix_timestamp("ts")).selectExpr(
        "event_id", f"{PROVIDER} AS provider", "s AS cached_at_s",
        "CASE WHEN event_id % 4 <> 0 THEN s + CAST(floor(value) AS BIGINT) END AS expires_at",
        "(s div 600 + 1) * 600 AS as_of_s")
    return ops.filter_fresh(df)


def trim_to_capacity(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_type IN ('view', 'click') THEN 'metadata' ELSE 'prepared' END AS cache",
        "event_id AS key", "ts AS cached_at", "value")
    return ops.trim_to_capacity(df, "cache", "key", "cached_at", F.col("value") > 400).drop("value")


def coalesce_requests(spark, sf):
    df = table(spark, sf, "events").selectExpr("concat('https://c.example.com/', user_id % 7) AS url", "ts", "event_id")
    return ops.coalesce_requests(df, "url", "ts", ["event_id"]).withColumn("window_start", F.unix_timestamp("window_start"))


STORED = {
    "schema_version": "CASE WHEN p_partkey % 20 = 0 THEN 7 ELSE 8 END",
    "analyzer_version": "CASE WHEN p_partkey % 15 = 0 THEN 'v1' ELSE 'v2' END",
    "provider": "CASE WHEN p_size % 2 = 0 THEN 'youtube' ELSE 'vimeo' END",
    "canonical_key": "concat('k', p_partkey)",
    "content_length": "CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 10 END",
    "duration_us": "CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 1000 END",
    "digest_source": "p_partkey",
}
WANTED = {
    "id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9)))",
    "schema_version": "8", "analyzer_version": "'v2'",
    "provider": "CASE WHEN l_linenumber % 2 = 0 THEN 'youtube' ELSE 'vimeo' END",
    "canonical_key": "concat('k', l_partkey)",
    "content_length": "CASE WHEN l_suppkey % 2 = 0 THEN l_partkey * 10 WHEN l_suppkey % 3 = 0 THEN l_partkey END",
    "duration_us": "CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey * 1000 + l_suppkey * 15000 END",
}
KEYS = ["schema_version", "analyzer_version", "provider", "canonical_key"]


def tolerant_identity_join(spark, sf):
    wanted = table(spark, sf, "lineitem").selectExpr(*_cols(WANTED))
    stored = table(spark, sf, "part").selectExpr(*_cols(STORED))
    return ops.tolerant_identity_join(wanted, stored, KEYS, how="left").selectExpr(
        "id", "canonical_key", "digest_source AS stored", "digest_source IS NOT NULL AS hit")


def stable_digest(spark, sf):
    return ops.stable_digest(table(spark, sf, "pages").selectExpr("page_id", "concat('p', page_id) AS provider", "url AS canonical_key"))


def validate_analyses(spark, sf):
    df = broken_catalog(spark, sf)
    df = df.withColumn("markers", F.when(F.col("swap_markers"), F.reverse("markers")).otherwise(F.col("markers")))
    df = df.withColumn("marker_conf", F.when(F.col("short_conf"), F.slice("marker_conf", 1, 1)).otherwise(F.col("marker_conf")))
    return ops.validate_analyses(df).select("track", "violation")


def missing_analysis_worklist(spark, sf):
    parts = table(spark, sf, "part")
    queue = listener_queue(spark, sf)
    in_flight = queue.where("pos % 6 = 1").select("listener", "track").distinct()
    return ops.missing_analysis_worklist(
        queue, parts.selectExpr("p_partkey AS track", "CASE WHEN p_size % 4 = 0 THEN 'hls' ELSE 'http' END AS kind"),
        parts.where("p_partkey % 3 = 0").selectExpr("p_partkey AS track"), in_flight)


OLD = {
    "canonical_key": "concat('k', p_partkey)", "requested_url": "concat('q', p_partkey)", "author": "p_brand",
    "uri": "concat('u', p_partkey)", "title": "p_name", "source_url": "concat('s', p_partkey)",
    "thumbnail": "CASE WHEN p_size % 2 = 0 THEN 'old.png' END", "duration_us": "CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) * 1000000 END",
}
NEW = {
    "canonical_key": "concat('k', p_partkey)", "title": "concat('new ', p_name)", "source_url": "concat('n', p_partkey)",
    "thumbnail": "CASE WHEN p_size % 5 = 0 THEN 'new.png' END", "duration_us": "CASE WHEN p_size % 7 = 0 THEN CAST(9 AS BIGINT) END",
}


def merge_refreshed_records(spark, sf):
    part = table(spark, sf, "part")
    return ops.merge_refreshed_records(part.selectExpr(*_cols(OLD)), part.where("p_type <> 'SMALL'").selectExpr(*_cols(NEW)))


QUERIES = {f.__name__: f for f in (
    build_alias_index, lookup_cached, filter_fresh, trim_to_capacity, coalesce_requests, tolerant_identity_join,
    stable_digest, validate_analyses, missing_analysis_worklist, merge_refreshed_records)}

_LE = "unhex(" + " || ".join(f"lpad(hex((n >> {8 * i}) & 255), 2, '0')" for i in range(8)) + ")"


def _le(x: str) -> str:
    return _LE.replace("n >>", f"octet_length(encode({x})) >>")


PROFILE_BROKEN = ("CASE WHEN {rate} = 0 THEN len({values}) > 0 ELSE {rate} > 8 OR len({values}) = 0 "
                  "OR len({values}) < floor(secs * {rate}) OR len({values}) > ceil(secs * {rate}) + 1 END")


def _out(x: str) -> str:
    return f"(isnan({x}) OR {x} < 0 OR {x} > 1)"


def _odd(values: str, rate: str) -> str:
    return f"({PROFILE_BROKEN.format(values=values, rate=rate)})"


ORACLES = {
    "build_alias_index": f"""
WITH r AS (SELECT {', '.join(_cols(RECORD))} FROM events),
a AS (SELECT asked_url AS alias, 0 AS i, canonical_key, written FROM r UNION ALL SELECT requested_url, 1, canonical_key, written FROM r
 UNION ALL SELECT canonical_url, 2, canonical_key, written FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY written DESC, i DESC) AS rn FROM a)
SELECT alias, canonical_key, written FROM w WHERE rn = 1""",
    "lookup_cached": f"""
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), l AS (SELECT user_id, max(s) AS s FROM e GROUP BY 1),
p AS (SELECT user_id, arg_max(s, event_id) AS s, arg_max({PROVIDER}, event_id) AS provider FROM e WHERE event_type <> 'view' GROUP BY 1),
q AS (SELECT o_orderkey AS id, 'https://c.example.com/' || (o_custkey % 200) AS url, o_custkey % 200 AS u, {MIDNIGHT} - (o_orderkey * 7) % 40000 AS as_of_s FROM orders),
j AS (SELECT q.*, l.user_id IS NOT NULL AND as_of_s - l.s <= 1800 AND as_of_s - (l.s - 600) <= 1800 AS known,
 coalesce(as_of_s - p.s <= CASE WHEN provider IN ('soundcloud', 'niconico', 'x') THEN 90 ELSE 300 END AND NOT (u % 3 = 0 AND p.s + 120 <= as_of_s + 60), false) AS ready
 FROM q LEFT JOIN l ON l.user_id = u LEFT JOIN p ON p.user_id = u)
SELECT id, url, as_of_s, CASE WHEN known AND ready THEN 'prepared' WHEN known THEN 'metadata' ELSE 'miss' END AS hit,
 CASE WHEN known AND ready THEN 'p' || u WHEN known THEN 'm' || u END AS record FROM j""",
    "filter_fresh": f"""
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
f AS (SELECT event_id, {PROVIDER} AS provider, s AS cached_at_s, CASE WHEN event_id % 4 <> 0 THEN s + CAST(floor(value) AS BIGINT) END AS expires_at, (s // 600 + 1) * 600 AS as_of_s FROM e),
g AS (SELECT *, coalesce(expires_at <= as_of_s + 60, false) AS stale FROM f)
SELECT event_id, provider, cached_at_s, expires_at, as_of_s, provider IN ('soundcloud', 'niconico', 'x') AS refresh FROM g
WHERE NOT stale AND as_of_s - cached_at_s <= CASE WHEN provider IN ('soundcloud', 'niconico', 'x') THEN 90 ELSE 300 END""",
    "trim_to_capacity": """
WITH c AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'metadata' ELSE 'prepared' END AS cache, event_id AS key, ts AS cached_at FROM events WHERE NOT value > 400),
r AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY cached_at DESC, key DESC) AS rn FROM c) SELECT cache, key, cached_at FROM r WHERE rn <= 4096""",
    "coalesce_requests": """
SELECT 'https://c.example.com/' || (user_id % 7) AS url, CAST(floor(epoch(ts)) AS BIGINT) // 600 * 600 AS window_start, min(event_id) AS event_id, count(*) AS requests
FROM events GROUP BY user_id % 7, 2""",
    "tolerant_identity_join": f"""
WITH w AS (SELECT {', '.join(_cols(WANTED))} FROM lineitem), s AS (SELECT {', '.join(_cols(STORED))} FROM part)
SELECT w.id, w.canonical_key, s.digest_source AS stored, s.digest_source IS NOT NULL AS hit FROM w LEFT JOIN s ON
 {' AND '.join(f'w.{k} = s.{k}' for k in KEYS)} AND coalesce(w.content_length = s.content_length, true) AND coalesce(abs(w.duration_us - s.duration_us) <= 1000000, true)""",
    "stable_digest": f"""
WITH p AS (SELECT page_id, 'p' || page_id AS provider, url AS canonical_key FROM pages)
SELECT page_id, provider, canonical_key, sha256({_le('provider')} || encode(provider) || {_le('canonical_key')} || encode(canonical_key)) AS digest FROM p""",
    "validate_analyses": f"""
WITH b AS (SELECT * REPLACE (CASE WHEN swap_markers THEN list_reverse(markers) ELSE markers END AS markers,
 CASE WHEN short_conf THEN marker_conf[1:1] ELSE marker_conf END AS marker_conf), duration_us / 1000000 AS secs FROM ({BROKEN_SQL}))
SELECT track, CASE WHEN duration_us = 0 THEN 'duration must be greater than zero'
 WHEN audible_start_us > audible_end_us OR audible_end_us > duration_us THEN 'audible boundaries must be ordered within the track duration'
 WHEN NOT intro_end_us BETWEEN audible_start_us AND audible_end_us OR NOT outro_start_us BETWEEN audible_start_us AND audible_end_us OR intro_end_us >= outro_start_us
  THEN 'structure boundaries must be ordered within the audible region'
 WHEN {_out('intro_confidence')} OR {_out('outro_confidence')} OR (intro_end_us IS NULL AND intro_confidence <> 0) OR (outro_start_us IS NULL AND outro_confidence <> 0)
  THEN 'structure confidences must match boundaries and be between zero and one'
 WHEN {_odd('vocal', 'vocal_rate')} OR len(vocal) <> len(vocal_conf) THEN 'vocal activity profile must have a valid rate, length, and confidence shape'
 WHEN {_odd('energy', 'energy_rate')} THEN 'energy profile must have a valid rate and length'
 WHEN NOT isfinite(bpm) OR bpm <= 0 THEN 'BPM must be finite and greater than zero'
 WHEN {_out('beat_confidence')} THEN 'beat confidence must be between zero and one'
 WHEN {_out('downbeat_confidence')} THEN 'downbeat confidence must be between zero and one'
 WHEN first_beat_us > duration_us THEN 'first beat must be within the track duration'
 WHEN list_max(markers) > duration_us OR markers <> list_sort(markers) OR len(list_distinct(markers)) <> len(markers) THEN 'beat markers must be ordered within the track duration'
 WHEN len(marker_conf) > 0 AND (len(marker_conf) <> len(markers) OR len(list_filter(marker_conf, lambda x: {_out('x')})) > 0)
  THEN 'beat marker confidences must match markers and be between zero and one'
 WHEN first_downbeat_us > duration_us THEN 'first downbeat must be within the track duration'
 WHEN key_tonic >= 12 OR {_out('key_confidence')} THEN 'musical key must have a valid tonic and confidence'
 WHEN NOT isfinite(rms_dbfs) OR NOT isfinite(peak_dbfs) THEN 'level measurements must be finite' END AS violation FROM b""",
    "missing_analysis_worklist": f"""
WITH q AS ({LISTENER_QUEUE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY listener ORDER BY pos) AS rn FROM q),
rel AS (SELECT DISTINCT listener, track FROM r WHERE rn <= 5), fly AS (SELECT DISTINCT listener, track FROM q WHERE pos % 6 = 1)
SELECT listener, track, 'analyse' AS action FROM rel JOIN part ON p_partkey = track WHERE p_size % 4 <> 0 AND p_partkey % 3 <> 0 AND (listener, track) NOT IN (SELECT (listener, track) FROM fly)
UNION ALL SELECT listener, track, 'cancel' FROM fly WHERE (listener, track) NOT IN (SELECT (listener, track) FROM rel)""",
    "merge_refreshed_records": f"""
WITH o AS (SELECT {', '.join(_cols(OLD))} FROM part), n AS (SELECT {', '.join(_cols(NEW))} FROM part WHERE p_type <> 'SMALL')
SELECT o.canonical_key, o.requested_url, o.author, o.uri, coalesce(n.title, o.title) AS title, coalesce(n.source_url, o.source_url) AS source_url,
 coalesce(n.thumbnail, o.thumbnail) AS thumbnail, coalesce(n.duration_us, o.duration_us) AS duration_us,
 CASE WHEN n.canonical_key IS NULL THEN 'resolve_again' ELSE 'refreshed' END AS action FROM o LEFT JOIN n USING (canonical_key)""",
}
