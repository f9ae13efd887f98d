"""Registered URL queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.operators import urls as ops
from segue.plans.tables import URL_REQUESTS_SQL, table, url_requests
from segue.rules import HostPolicy

# Policy for the hosts that occur in the pages table.
PAGE_POLICIES = (
    HostPolicy("site", "track", ("example.com",), (".example.com",)),
    HostPolicy("site", "playback", ("tv.example.com",)),
    HostPolicy("mirror", "track", ("clip.example.net",)),
    HostPolicy("mirror", "playback", ("example.net",), (".example.net",)),
)
PAGE_HOSTS = {
    "youtube": ("player.example.net",),
    "soundcloud": ("nowhere.example.org",),
    "bandcamp": ("store.example.org",),
    "niconico": ("localhost",),
    "vimeo": ("clip.example.net", "player.example.net"),
    "twitch": ("tv.example.com",),
    "x": ("www.example.com",),
}

HEADER_ROWS = [
    ("'Accept'", "concat('a', o_orderkey)"),
    ("'Cookie'", "concat('c', o_orderkey)"),
    ("'Referer'", "CASE WHEN o_orderkey % 13 = 3 THEN concat('r', chr(10), 'x') ELSE 'https://r.example.com/' END"),
    ("'X-Id'", "concat('x', o_orderkey)"),
    ("'User-Agent'", "CASE WHEN o_orderkey % 13 = 5 THEN repeat('u', 1100) ELSE 'agent' END"),
]
ORIGIN = "'https://CDN.example.com:443/a'"
TARGET = ("CASE o_orderkey % 3 WHEN 0 THEN concat('https://cdn.example.com/b/', o_orderkey) "
          "WHEN 1 THEN 'https://other.example.com/b' ELSE 'no url' END")

LOG_TEXT = "concat('GET ', url, '), ref=', url, '; pre', url, ' end http:// ok')"


def _headers(spark, sf):
    entries = ", ".join(f"{k}, {v}" for k, v in HEADER_ROWS)
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", f"{ORIGIN} AS origin", f"{TARGET} AS target", f"map({entries}) AS headers")


def _joined(headers):
    pairs = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), "|")


def filter_allowed_urls(spark, sf):
    return ops.filter_allowed_urls(url_requests(spark, sf), policies=PAGE_POLICIES)


def validate_playback_targets(spark, sf):
    df = url_requests(spark, sf).withColumn("provider", F.expr("CASE variant % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'mirror' ELSE 'other' END"))
    return ops.validate_playback_targets(df, policies=PAGE_POLICIES)


def audit_redirect_chains(spark, sf):
    hops = table(spark, sf, "pages").selectExpr(
        "(page_id div 12) * 2 + CASE WHEN page_id % 12 < 4 THEN 0 ELSE 1 END AS chain",
        "page_id % 12 - CASE WHEN page_id % 12 < 4 THEN 0 ELSE 4 END AS hop",
        "replace(url, 'http://', 'https://') AS url")
    return ops.audit_redirect_chains(hops, policies=PAGE_POLICIES)


def filter_forwarded_headers(spark, sf):
    return ops.filter_forwarded_headers(_headers(spark, sf)).select("id", _joined("headers").alias("headers"))


def sanitize_headers(spark, sf):
    return ops.sanitize_headers(_headers(spark, sf)).select("id", "unsafe", _joined("headers").alias("headers"))


def redact_urls(spark, sf):
    lines = url_requests(spark, sf).selectExpr("page_id", "variant", f"{LOG_TEXT} AS text")
    return ops.redact_urls(lines)


def route_provider(spark, sf):
    return ops.route_provider(url_requests(spark, sf), supports=ops.provider_rules(PAGE_HOSTS))


def canonicalize_targets(spark, sf):
    return ops.canonicalize_targets(url_requests(spark, sf), track_hosts=PAGE_HOSTS)


EXPIRY_URL = ("concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'expire=', page_id * 1000, "
              "'&ts=', page_id, 'x', '&clen=', '&clen=5')")


def extract_url_expiry(spark, sf):
    df = table(spark, sf, "pages").selectExpr(
        "page_id", f"split(url, '#')[0] AS url0").selectExpr(
        "page_id", EXPIRY_URL.replace("url", "url0") + " AS url",
        "concat('{\"expires\": ', page_id + 7, '}') AS token",
        "concat('{\"timestamp\": ', page_id, ', \"expires\": 9223372036854775', 707 + page_id, '}') AS config")
    return ops.extract_url_expiry(df, token="token", config="config").drop("token", "config")


EXTRACTOR = {
    "id": "concat('v', o_orderkey)",
    "stream_url": ("CASE o_orderkey % 5 WHEN 0 THEN concat('https://r1.googlevideo.com/p?clen=', o_orderkey, '&expire=9') "
                   "WHEN 1 THEN 'https://cdn.example.com/live.m3u8' WHEN 2 THEN '' "
                   "ELSE 'https://cdn.example.com/a.mp3' END"),
    "webpage_url": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('https://w.example.com/', o_orderkey) END",
    "is_live": "o_orderstatus = 'P'",
    "protocol": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'm3u8_native' WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'https' END",
    "filesize": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END",
    "filesize_approx": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 END",
    "title": "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('T', o_orderkey) END",
    "uploader": "CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 'up' END",
    "channel": "CASE WHEN o_orderkey % 6 = 1 THEN '' ELSE 'ch' END",
    "duration_s": "CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice / 4 END",
}


def build_prepared_source(spark, sf):
    info = table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in EXTRACTOR.items()])
    return ops.build_prepared_source(info).select(
        "id", "kind", "content_length", "range_chunk_size", "range_mode", "access_plan", "expires_at",
        "canonical_url", "final_title", "author", "duration_us")


STATUS = ("CASE o_orderkey % 9 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 410 "
          "WHEN 5 THEN 422 WHEN 6 THEN 500 WHEN 7 THEN 200 ELSE NULL END")


def classify_failures(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", f"{STATUS} AS status", "o_orderkey % 9 = 8 AND o_orderstatus = 'F' AS parse_error",
        "o_custkey % 2 = 0 AS token_refreshed", "o_custkey % 4 = 0 AS context_refreshed",
        "o_custkey % 5 = 0 AS forbidden", "CASE WHEN o_custkey % 10 = 0 THEN o_orderpriority END AS reason")
    return ops.classify_failures(df, forbidden="forbidden", reason="reason").select(
        "id", "probe_action", "payload_action", "forbidden_reason")


TITLE_TEXT = ("CASE WHEN doc_id % 10 = 0 THEN ' https://t.example.com/a ' "
              "ELSE concat('  see https://t.example.com/', doc_id, ' now', chr(10), chr(10), text) END")


def normalize_titles(spark, sf):
    df = table(spark, sf, "documents").selectExpr(
        "doc_id", f"{TITLE_TEXT} AS text", "concat('https://d.example.com/', doc_id) AS url",
        "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars * 1000000 + 999999 END AS duration_us")
    return ops.normalize_titles(df).select("doc_id", "title", "short_title", "compact", "duration")


QUERIES = {f.__name__: f for f in (
    filter_allowed_urls, validate_playback_targets, audit_redirect_chains, filter_forwarded_headers,
    sanitize_headers, redact_urls, route_provider, canonicalize_targets, extract_url_expiry,
    build_prepared_source, classify_failures, normalize_titles)}

# ---- SQL twins -------------------------------------------------------------


# The twin cuts a URL step by step: scheme, authority up to the first of / \\ ? #, userinfo, port, rest.
def _rest(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substring({u}, strpos({u}, '://') + 3) END"


def _authority(u: str) -> str:
    return f"regexp_extract({_rest(u)}, '^[^/?#\\\\]*')"


def _server(u: str) -> str:
    return f"list_extract(string_split({_authority(u)}, '@'), -1)"


def sql_host(u: str) -> str:
    name, port = f"regexp_replace({_server(u)}, ':[0-9]*$', '')", f"regexp_extract({_server(u)}, ':([0-9]*)$', 1)"
    fine = (f"NOT regexp_matches({_authority(u)}, '\\s') AND NOT regexp_matches(replace({u}, chr(10), ' '), '\\s\\S*$') AND len({port}) < 18 AND coalesce(TRY_CAST({port} AS BIGINT), 0) <= 65535 "
            f"AND (regexp_full_match({name}, '[^ :@<>^|%\\[\\]]+') OR regexp_full_match({name}, '\\[[0-9A-Fa-f:.]+\\]'))")
    return f"CASE WHEN {fine} THEN lower({name}) END"


def sql_scheme(u: str) -> str:
    return f"CASE WHEN {sql_host(u)} IS NOT NULL THEN lower(substring({u}, 1, strpos({u}, '://') - 1)) END"


def _after(u: str) -> str:
    return f"string_split(substring({_rest(u)}, len({_authority(u)}) + 1), '#')[1]"


def sql_path(u: str) -> str:
    way = f"replace(string_split({_after(u)}, '?')[1], chr(92), '/')"
    return f"CASE WHEN {sql_host(u)} IS NOT NULL THEN CASE WHEN {way} = '' THEN '/' ELSE {way} END END"


def sql_query(u: str) -> str:
    return f"CASE WHEN {sql_host(u)} IS NOT NULL AND contains({_after(u)}, '?') THEN substring({_after(u)}, strpos({_after(u)}, '?') + 1) ELSE '' END"


def sql_named(h: str) -> str:
    return f"CASE WHEN {h} <> 'localhost' AND NOT regexp_matches({h}, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') THEN {h} END"


_TRACK_OK = "(h = 'example.com' OR ends_with(h, '.example.com') OR h = 'clip.example.net')"
_PLAY_OK = "(h IN ('tv.example.com', 'example.net') OR ends_with(h, '.example.net'))"
_PARSED = (f"SELECT *, {sql_scheme('url')} AS sc, {sql_named(sql_host('url'))} AS h, {sql_host('url')} AS rawh, "
           f"{sql_path('url')} AS pth FROM ({URL_REQUESTS_SQL})")


def sql_summary(u: str) -> str:
    return (f"({sql_scheme(u)} || '://' || {sql_host(u)} || CASE WHEN {sql_path(u)} = '/' THEN '/' ELSE '/[redacted]' END)")


_HEADER_LIST = ", ".join(f"{{'k': {k}, 'v': {v}}}" for k, v in HEADER_ROWS)
_HEADERS_SQL = (f"SELECT o_orderkey AS id, {ORIGIN} AS origin, {TARGET} AS target, unnest([{_HEADER_LIST}]) AS e FROM orders")
_SAFE = "lower(e.k) IN ('accept', 'accept-language', 'origin', 'referer', 'user-agent')"
_LAST_DIGITS = "list_max(list_filter(range(1, len(seg) + 1), lambda i: regexp_full_match(seg[i], '[0-9]+')))"
_SEGS = f"SELECT *, list_filter(string_split(pth, '/'), lambda s: s <> '') AS seg, string_split(pth, '/') AS parts, {sql_query('url')} AS q FROM ({_PARSED})"
_HQ = "CASE WHEN regexp_matches(q, '(^|&)h(=|&|$)') THEN regexp_extract(q, '(?:^|&)h=?([^&]*)', 1) END"
_CANON = f"""SELECT page_id, variant, url,
 CASE WHEN rawh = 'tv.example.com' THEN
   CASE WHEN seg[1] = 'videos' AND regexp_full_match(seg[2], '[0-9]+') THEN 'twitch:video:' || seg[2]
        WHEN len(seg) = 1 AND seg[1] NOT IN ('directory', 'videos', 'login') THEN 'twitch:channel:' || lower(seg[1]) END END AS twitch_key,
 CASE WHEN rawh = 'clip.example.net' THEN 'vimeo:video:' || seg[{_LAST_DIGITS}]
      WHEN rawh = 'player.example.net' AND seg[1] = 'video' AND regexp_full_match(seg[2], '[0-9]+') THEN 'vimeo:video:' || seg[2] END AS vimeo_key,
 CASE WHEN rawh = 'clip.example.net' AND {_LAST_DIGITS} IS NOT NULL THEN coalesce({_HQ},
        CASE WHEN regexp_full_match(seg[{_LAST_DIGITS} + 1], '[0-9a-fA-F]{{6,}}') THEN seg[{_LAST_DIGITS} + 1] END)
      WHEN rawh = 'player.example.net' AND seg[1] = 'video' THEN {_HQ} END AS vimeo_hash,
 CASE WHEN rawh = 'www.example.com' AND len(parts) >= 4 AND parts[3] = 'status' THEN 'x:tweet:' || parts[4] END AS x_key,
 rawh, pth, seg FROM ({_SEGS})"""

_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_DOCS = f"SELECT doc_id, {TITLE_TEXT} AS text, n_chars FROM documents"

ORACLES = {
    "filter_allowed_urls": f"SELECT page_id, variant, url FROM ({_PARSED}) WHERE sc = 'https' AND {_TRACK_OK}",
    "validate_playback_targets": f"""
WITH p AS (SELECT *, CASE variant % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'mirror' ELSE 'other' END AS provider FROM ({_PARSED})),
q AS (SELECT *, coalesce(sc = 'https' AND CASE provider WHEN 'site' THEN h = 'tv.example.com'
  WHEN 'mirror' THEN h = 'example.net' OR ends_with(h, '.example.net') ELSE false END, false) AS allowed FROM p)
SELECT page_id, variant, url, provider, allowed,
 CASE WHEN provider = 'other' THEN 'unknown provider other'
      WHEN NOT allowed THEN 'unsafe target for ' || provider || ': ' || coalesce({sql_summary('url')}, '<invalid-url>') END AS violation
FROM q""",
    "audit_redirect_chains": f"""
WITH p AS (SELECT (page_id // 12) * 2 + CASE WHEN page_id % 12 < 4 THEN 0 ELSE 1 END AS chain,
  page_id % 12 - CASE WHEN page_id % 12 < 4 THEN 0 ELSE 4 END AS hop, replace(url, 'http://', 'https://') AS url FROM pages),
q AS (SELECT *, {sql_named(sql_host('url'))} AS h FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY hop) - 1 AS prev, {_TRACK_OK} OR {_PLAY_OK} AS ok FROM q)
SELECT chain, count(*) AS hops, bool_and(ok AND prev < 5) AS accepted,
 arg_min(CASE WHEN prev >= 5 THEN 'too many redirects' ELSE 'redirect target host is not allowed' END, hop)
   FILTER (WHERE NOT ok OR prev >= 5) AS reason FROM r GROUP BY chain""",
    "filter_forwarded_headers": f"""
WITH k AS (SELECT id, e.k AS k, e.v AS v FROM ({_HEADERS_SQL}) WHERE {_SAFE} OR target LIKE 'https://cdn.example.com/%')
SELECT id, string_agg(k || '=' || v, '|' ORDER BY k) AS headers FROM k GROUP BY id""",
    "sanitize_headers": f"""
WITH k AS (SELECT id, e.k AS k, e.v AS v FROM ({_HEADERS_SQL}) WHERE {_SAFE}),
b AS (SELECT id, bool_or(v LIKE '%' || chr(10) || '%' OR v LIKE '%' || chr(13) || '%' OR octet_length(encode(v)) > 1024) OR count(*) > 8 AS unsafe,
  string_agg(k || '=' || v, '|' ORDER BY k) AS headers FROM k GROUP BY id)
SELECT id, unsafe, CASE WHEN NOT unsafe THEN headers END AS headers FROM b""",
    "redact_urls": f"""
WITH t AS (SELECT page_id, variant, {LOG_TEXT} AS text FROM ({URL_REQUESTS_SQL})),
u AS (SELECT page_id, variant, unnest(regexp_extract_all(text, '\\S+|\\s+')) AS tok,
  unnest(range(len(regexp_extract_all(text, '\\S+|\\s+')))) AS i FROM t),
v AS (SELECT *, regexp_extract(tok, '^(.*?)(https?://.*?)([)\\]}},;]*)$', 1) AS pre,
  regexp_extract(tok, '^(.*?)(https?://.*?)([)\\]}},;]*)$', 2) AS body,
  regexp_extract(tok, '^(.*?)(https?://.*?)([)\\]}},;]*)$', 3) AS suf FROM u)
SELECT page_id, variant, string_agg(coalesce(pre || {sql_summary('body')} || suf, tok), '' ORDER BY i) AS text
FROM v GROUP BY page_id, variant""",
    "route_provider": f"""
SELECT page_id, variant, url, CASE WHEN rawh = 'player.example.net' THEN 'youtube'
 WHEN rawh = 'nowhere.example.org' THEN 'soundcloud'
 WHEN ends_with(rawh, '.store.example.org') AND contains(pth, '/track/') THEN 'bandcamp'
 WHEN rawh = 'localhost' THEN 'niconico' WHEN vimeo_key IS NOT NULL THEN 'vimeo'
 WHEN twitch_key IS NOT NULL THEN 'twitch' WHEN x_key IS NOT NULL THEN 'x' ELSE 'unsupported' END AS provider
FROM ({_CANON})""",
    "canonicalize_targets": f"SELECT page_id, variant, url, twitch_key, vimeo_key, vimeo_hash, x_key FROM ({_CANON})",
    "extract_url_expiry": f"""
WITH p AS (SELECT page_id, string_split(url, '#')[1] AS url FROM pages)
SELECT page_id, {EXPIRY_URL} AS url, page_id * 1000 AS expire, CAST(NULL AS BIGINT) AS clen, CAST(NULL AS BIGINT) AS ts,
 page_id + 7 AS token_expires,
 CASE WHEN CAST(page_id AS HUGEINT) + CAST('9223372036854775' || (707 + page_id) AS HUGEINT) <= 9223372036854775807
  THEN CAST(CAST(page_id AS HUGEINT) + CAST('9223372036854775' || (707 + page_id) AS HUGEINT) AS BIGINT) END AS config_expires FROM p""",
    "build_prepared_source": f"""
WITH i AS (SELECT {', '.join(f'{e} AS {n}' for n, e in EXTRACTOR.items())}, o_orderkey FROM orders),
j AS (SELECT *, is_live OR coalesce(protocol LIKE '%m3u8%', false) OR stream_url LIKE '%.m3u8%' AS hls,
  stream_url LIKE '%.googlevideo.com/%' AS cdn,
  coalesce(filesize, filesize_approx, CASE WHEN stream_url LIKE '%clen=%' THEN o_orderkey END) AS len,
  CASE WHEN webpage_url <> '' THEN webpage_url ELSE 'https://www.youtube.com/watch?v=' || id END AS canonical_url
  FROM i WHERE stream_url <> '')
SELECT id, CASE WHEN hls THEN 'hls' ELSE 'http' END AS kind, CASE WHEN NOT hls THEN len END AS content_length,
 CASE WHEN NOT hls AND cdn THEN CAST(11862014 AS BIGINT) END AS range_chunk_size,
 CASE WHEN hls THEN NULL WHEN cdn THEN 'query' ELSE 'header' END AS range_mode,
 CASE WHEN hls THEN 'playlist' WHEN len IS NOT NULL AND cdn THEN 'ranged' ELSE 'plain' END AS access_plan,
 CASE WHEN stream_url LIKE '%expire=%' THEN CAST(9 AS BIGINT) END AS expires_at, canonical_url,
 CASE WHEN title <> '' THEN title ELSE canonical_url END AS final_title,
 CASE WHEN uploader <> '' THEN uploader WHEN channel <> '' THEN channel ELSE 'YouTube' END AS author,
 CASE WHEN NOT is_live AND duration_s > 0 THEN CAST(round(duration_s * 1000000) AS BIGINT) END AS duration_us FROM j""",
    "classify_failures": f"""
WITH s AS (SELECT *, {STATUS} AS status, o_orderkey % 9 = 8 AND o_orderstatus = 'F' AS pe FROM orders)
SELECT o_orderkey AS id, CASE WHEN pe OR status IN (400, 404, 410, 422) THEN 'html_fallback' ELSE 'fail' END AS probe_action,
 CASE WHEN status IN (401, 403) THEN CASE WHEN o_custkey % 2 <> 0 THEN 'refresh_token' WHEN o_custkey % 4 <> 0 THEN 'refresh_context' ELSE 'fail' END ELSE 'fail' END AS payload_action,
 CASE WHEN o_custkey % 10 = 0 THEN o_orderpriority WHEN o_custkey % 5 = 0 THEN 'unknown' END AS forbidden_reason FROM s""",
    "normalize_titles": f"""
WITH a AS (SELECT doc_id, text, n_chars, list_filter(list_transform(string_split(regexp_replace(text, 'https?://\\S+', '', 'g'), chr(10)),
  lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ls FROM ({_DOCS})),
b AS (SELECT *, CASE WHEN len(ls) = 0 THEN 'https://d.example.com/' || doc_id ELSE array_to_string(ls, ' ') END AS title FROM a)
SELECT doc_id, title, CASE WHEN length(title) <= 180 THEN title ELSE substring(title, 1, 177) || '...' END AS short_title,
 CASE WHEN length({_FLAT}) <= 500 THEN {_FLAT} ELSE substring({_FLAT}, 1, 500) || '…' END AS compact,
 CASE WHEN doc_id % 6 = 0 THEN '--m --s' ELSE
  CASE WHEN n_chars // 60 < 10 THEN '0' ELSE '' END || (n_chars // 60) || 'm ' || CASE WHEN n_chars % 60 < 10 THEN '0' ELSE '' END || (n_chars % 60) || 's' END AS duration FROM b""",
}
