"""Registered playlist and byte-range queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.operators import manifests as ops
from segue.plans.tables import table
from segue.plans.url_queries import PAGE_POLICIES, sql_host, sql_named, sql_summary

CHUNK = 4096  # event ids are dense, so a chunk holds at most this many rows

LINE = (
    "CASE event_type WHEN 'error' THEN concat('#EXT-X-KEY:METHOD=', CASE WHEN user_id % 10 = 3 AND value > 400 THEN 'SAMPLE-AES' ELSE 'AES-128' END, "
    "',URI=\"k', event_id, '.bin\"', CASE WHEN event_id % 3 = 0 THEN ',IV=0x000000000000000000000000000000AB' ELSE '' END) "
    "WHEN 'signup' THEN CASE WHEN value > 250 THEN concat('#EXT-X-MEDIA-SEQUENCE:', event_id) WHEN value > 240 THEN '#EXT-X-MEDIA-SEQUENCE:oops' "
    "ELSE concat('#EXT-X-MAP:URI=\"/m', event_id, '.mp4\"') END "
    "WHEN 'click' THEN '#EXTINF:4.0' WHEN 'view' THEN concat('  s', event_id, '.ts ') ELSE concat('../s', event_id, '.ts?x=1') END")
BASE = "concat('https://cdn.example.net/a/b', user_id, '/list.m3u8')"


def explode_media_playlist(spark, sf):
    lines = table(spark, sf, "events").selectExpr(
        "user_id AS playlist", "event_id AS line_no", f"{LINE} AS line", f"{BASE} AS base_url",
        f"event_id div {CHUNK} AS part")
    return ops.explode_media_playlist(lines, "playlist", ["part"])


CHILDREN = ["'a.ts'", "'/r/b.ts?q=1'", "'../c.ts'", "'https://cdn.example.net/d.ts'", "'//other.example.com/e.ts'",
            "'?q=1'", "'./f/../g.ts'"]


def resolve_child_uris(spark, sf):
    df = table(spark, sf, "pages").selectExpr(
        "page_id", "replace(url, 'http://', 'https://') AS base_url",
        f"posexplode(array({', '.join(CHILDREN)})) AS (pos, child)").withColumn("provider", F.lit("mirror"))
    return ops.resolve_child_uris(df, policies=PAGE_POLICIES).drop("base_url")


OUTCOME = ("CASE WHEN event_type = 'purchase' AND value > 450 THEN 'new' WHEN event_type = 'signup' AND value > 485 THEN 'end' "
           "WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' AND value > 480 THEN 'new' ELSE 'none' END")


def detect_stalled_playlists(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "user_id AS stream", "event_id AS reload", f"{OUTCOME} AS outcome",
        "CAST(floor(value * 100000) AS BIGINT) AS target_us", f"event_id div {CHUNK} AS part")
    return ops.detect_stalled_playlists(df, "stream", ["part"], "reload")


RANGES = {
    "asset": "o_orderkey",
    "length": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "chunk": "CAST(65536 AS BIGINT)",
    "mode": "CASE WHEN o_orderstatus = 'F' THEN 'query' ELSE 'header' END",
}


def plan_byte_ranges(spark, sf):
    df = table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in RANGES.items()])
    return ops.plan_byte_ranges(df)


REQUEST = {
    "id": "o_orderkey", "mode": "CASE WHEN o_orderstatus = 'F' THEN 'query' ELSE 'header' END",
    "offset": "(o_orderkey % 3) * 1000",
    "range": "CASE WHEN o_custkey % 3 = 0 THEN concat('bytes=', (o_orderkey % 3) * 1000, '-') ELSE concat('bytes=', (o_orderkey % 3) * 1000, '-', (o_orderkey % 3) * 1000 + 499) END",
}
RESPONSE = {
    "id": "o_orderkey", "status": "CASE o_orderkey % 4 WHEN 0 THEN 206 WHEN 1 THEN 200 WHEN 2 THEN 206 ELSE 416 END",
    "content_range": "CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN concat('bytes 0-9/', o_custkey) ELSE concat('bytes ', (o_orderkey % 3) * 1000, '-1500/*') END",
    "content_length": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE (o_custkey * 37) % 1000 END",
}


def reconcile_range_responses(spark, sf):
    orders = table(spark, sf, "orders")
    return ops.reconcile_range_responses(
        orders.selectExpr(*[f"{e} AS `{n}`" for n, e in REQUEST.items()]),
        orders.selectExpr(*[f"{e} AS {n}" for n, e in RESPONSE.items()])).select("id", "offset", "accepted", "total")


PART_LEN = "CAST(floor(l_quantity * 500000) AS BIGINT)"
DECLARED = "CASE WHEN l_linenumber = 1 THEN CAST(floor(l_extendedprice * 1000) AS BIGINT) END"


def enforce_size_limits(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS body", "CASE WHEN l_orderkey % 5 = 0 THEN 'key' ELSE 'media' END AS kind",
        f"CASE WHEN l_orderkey % 5 = 0 THEN CAST(floor(l_quantity * 7) AS BIGINT) ELSE {PART_LEN} END AS length",
        f"CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE {DECLARED} END AS declared")
    return ops.enforce_size_limits(df, "body")


QUERIES = {f.__name__: f for f in (
    explode_media_playlist, resolve_child_uris, detect_stalled_playlists, plan_byte_ranges,
    reconcile_range_responses, enforce_size_limits)}

_HOME = "'https://cdn.example.net/a/b' || playlist || '/'"
ORACLES = {
    "explode_media_playlist": f"""
WITH l AS (SELECT user_id AS playlist, event_id AS line_no, event_type, value, trim({LINE}) AS line FROM events),
c AS (SELECT *, coalesce(last_value(CASE WHEN line LIKE '#EXT-X-MEDIA-SEQUENCE:%' THEN coalesce(TRY_CAST(substr(line, 23) AS BIGINT), 0) END IGNORE NULLS)
   OVER w, 0) AS seq, count(CASE WHEN NOT starts_with(line, '#') THEN 1 END) OVER w AS upto FROM l
   WINDOW w AS (PARTITION BY playlist ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN line LIKE '#EXT-X-KEY:METHOD=SAMPLE%' THEN 'unsupported key method: SAMPLE-AES' END AS err,
  CASE WHEN line LIKE '#EXT-X-KEY:%' THEN {_HOME} || 'k' || line_no || '.bin' END AS ku,
  CASE WHEN line LIKE '#EXT-X-KEY:%IV=%' THEN '000000000000000000000000000000ab' WHEN line LIKE '#EXT-X-KEY:%' THEN lpad(lower(hex(seq + upto)), 32, '0') END AS kiv FROM c),
f AS (SELECT *, last_value(ku IGNORE NULLS) OVER w AS key_url, last_value(kiv IGNORE NULLS) OVER w AS iv FROM k
   WINDOW w AS (PARTITION BY playlist ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT playlist, line_no, CASE WHEN err IS NOT NULL THEN 'error' WHEN line LIKE '#EXT-X-MAP%' THEN 'map' ELSE 'segment' END AS kind,
  CASE WHEN NOT starts_with(line, '#') THEN upto - 1 END AS segment_index,
  CASE WHEN line LIKE '#EXT-X-MAP%' THEN 'https://cdn.example.net/m' || line_no || '.mp4' WHEN line LIKE '../%' THEN 'https://cdn.example.net/a/' || substr(line, 4)
   ELSE {_HOME} || line END AS url, key_url, iv, err AS error FROM f WHERE err IS NOT NULL OR line LIKE '#EXT-X-MAP%' OR NOT starts_with(line, '#')),
g AS (SELECT *, min(CASE WHEN kind = 'error' THEN line_no END) OVER (PARTITION BY playlist) AS bad, max(CASE WHEN kind = 'map' THEN line_no END) OVER (PARTITION BY playlist) AS lastmap FROM r)
SELECT playlist, line_no, kind, segment_index, CASE WHEN error IS NULL THEN url END AS url, CASE WHEN error IS NULL THEN key_url END AS key_url,
 CASE WHEN error IS NULL THEN iv END AS iv, error FROM g
WHERE CASE WHEN bad IS NOT NULL THEN line_no = bad ELSE kind = 'segment' OR line_no = lastmap END""",
    "resolve_child_uris": f"""
WITH p AS (SELECT page_id, replace(url, 'http://', 'https://') AS b FROM pages),
q AS (SELECT *, regexp_extract(b, '^(https://[^/?#]*)', 1) AS o, regexp_extract(b, '^https://[^/?#]*([^?#]*)', 1) AS pth FROM p),
r AS (SELECT *, regexp_replace(pth, '[^/]*$', '') AS dir FROM q),
c AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, [{', '.join(CHILDREN)}][i] AS child, CASE i WHEN 1 THEN o || dir || 'a.ts' WHEN 2 THEN o || '/r/b.ts?q=1'
  WHEN 3 THEN o || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END || 'c.ts' WHEN 4 THEN 'https://cdn.example.net/d.ts' WHEN 5 THEN 'https://other.example.com/e.ts'
  WHEN 6 THEN o || pth || '?q=1' ELSE o || dir || 'g.ts' END AS url FROM r, range(1, 8) t(i)),
d AS (SELECT *, {sql_named(sql_host('url'))} AS h FROM c), e AS (SELECT *, coalesce(h = 'example.net' OR ends_with(h, '.example.net'), false) AS allowed FROM d)
SELECT page_id, pos, child, 'mirror' AS provider, url, allowed, CASE WHEN NOT allowed THEN 'unsafe target for mirror: ' || {sql_summary('url')} END AS violation FROM e""",
    "detect_stalled_playlists": f"""
WITH l AS (SELECT user_id AS stream, event_id AS reload, {OUTCOME} AS outcome, CAST(floor(value * 100000) AS BIGINT) AS target_us FROM events),
i AS (SELECT *, sum(CASE WHEN outcome = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY reload) AS island FROM l),
s AS (SELECT *, CAST(sum(CASE WHEN outcome IN ('none', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY stream, island ORDER BY reload) AS BIGINT) AS stalls FROM i),
e AS (SELECT *, outcome = 'end' OR stalls > 12 AS ended FROM s), f AS (SELECT *, min(CASE WHEN ended THEN reload END) OVER (PARTITION BY stream) AS fin FROM e)
SELECT stream, reload, outcome, stalls, ended, CASE WHEN NOT ended THEN CASE WHEN target_us < 500000 THEN 500000 WHEN target_us > 15000000 THEN 15000000 ELSE target_us END END AS next_delay_us
FROM f WHERE fin IS NULL OR reload <= fin""",
    "plan_byte_ranges": f"""
WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RANGES.items())} FROM orders),
o AS (SELECT *, unnest(CASE WHEN length IS NULL THEN [0] ELSE range(0, length, chunk) END) AS "offset" FROM r),
b AS (SELECT *, 'bytes=' || "offset" || '-' AS op FROM o)
SELECT asset, length, chunk, mode, CAST("offset" AS BIGINT) AS "offset", CASE WHEN length IS NULL THEN op WHEN mode = 'query' OR "offset" = 0 THEN 'bytes=' || "offset" || '-' || (least("offset" + chunk, length) - 1) ELSE op END AS first_range,
 CASE WHEN length IS NOT NULL AND mode <> 'query' AND "offset" > 0 THEN 'bytes=' || "offset" || '-' || (least("offset" + chunk, length) - 1) END AS second_range FROM b""",
    "reconcile_range_responses": f"""
WITH q AS (SELECT o_orderkey AS id, {REQUEST['mode']} AS mode, {REQUEST['offset']} AS "offset", o_custkey % 3 = 0 AS open_ended, {RESPONSE['status']} AS status, {RESPONSE['content_range']} AS cr, {RESPONSE['content_length']} AS cl, o_custkey FROM orders)
SELECT id, "offset", CASE WHEN status = 206 THEN CASE o_custkey % 5 WHEN 0 THEN false WHEN 1 THEN "offset" = 0 ELSE true END
 WHEN mode = 'query' AND status = 200 THEN "offset" = 0 OR open_ended OR cl IS NULL OR (cl > 0 AND cl <= 500) ELSE "offset" = 0 END AS accepted,
 CASE WHEN o_custkey % 5 = 1 THEN o_custkey END AS total FROM q""",
    "enforce_size_limits": f"""
WITH p AS (SELECT l_orderkey AS body, l_orderkey % 5 = 0 AS k, CASE WHEN l_orderkey % 5 = 0 THEN CAST(floor(l_quantity * 7) AS BIGINT) ELSE {PART_LEN} END AS length,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE {DECLARED} END AS d FROM lineitem)
SELECT body, CASE WHEN k THEN 'key' ELSE 'media' END AS kind, CAST(sum(length) AS BIGINT) AS received, max(d) AS declared,
 CASE WHEN k THEN sum(length) > 1024 ELSE coalesce(max(d) > 67108864, false) OR sum(length) > 67108864 END AS dropped FROM p GROUP BY body, k""",
}
