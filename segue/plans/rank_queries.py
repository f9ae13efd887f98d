"""Registered ranking queries and their SQL twins."""

from __future__ import annotations

from segue.operators import ranking as ops
from segue.plans.tables import table

POS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
POS_SQL = ", ".join(POS)
POS_DESC = ", ".join(f"{c} DESC" for c in POS)
URI = "concat('s', l_partkey, '.ts')"

TRANSCODING = {
    "mime_type": "CASE WHEN l_linestatus = 'O' THEN 'audio/mpeg' WHEN l_tax > 0.05 THEN 'audio/mpegurl' ELSE 'audio/ogg' END",
    "protocol": "CASE l_returnflag WHEN 'A' THEN 'progressive' WHEN 'N' THEN 'hls' ELSE 'dash' END",
    "quality": "CASE WHEN l_linenumber % 2 = 0 THEN 'sq' END",
    "preset": "CASE WHEN l_partkey % 2 = 0 THEN 'abr_sq' ELSE 'mp3_0_0' END",
    "url": URI,
}
VARIANT = {
    "content_type": "CASE l_returnflag WHEN 'A' THEN 'application/x-mpegURL' WHEN 'N' THEN 'video/mp4' ELSE 'video/webm' END",
    "bitrate": "CASE WHEN l_tax > 0.01 THEN CAST(l_quantity * 1000 AS BIGINT) END",
    "url": f"CASE WHEN l_linestatus = 'O' OR l_tax > 0.03 THEN {URI} END",
}
PROGRESSIVE = {
    "width": "CASE WHEN l_tax > 0.01 THEN CAST(l_quantity AS BIGINT) END",
    "height": "CAST(l_linenumber AS BIGINT)",
    "url": URI,
}
STREAM = {
    "codecs": "CASE l_returnflag WHEN 'A' THEN 'mp4a.40.2' WHEN 'N' THEN 'AVC1.4d,mp4a.40' END",
    "has_video": "l_returnflag = 'R' AND l_linestatus = 'O'",
    "has_audio_group": "l_tax > 0.04",
    "is_iframe": "l_linenumber = 7",
    "average_bandwidth": "CASE WHEN l_discount > 0.05 THEN CAST(l_quantity * 1000 AS BIGINT) END",
    "bandwidth": "CAST(l_quantity * 1100 AS BIGINT)",
    "url": URI,
}
MEDIA_LINE = (
    "concat(CASE WHEN l_returnflag = 'R' THEN '#EXT-X-STREAM-INF:' ELSE '#EXT-X-MEDIA:' END, 'TYPE=AUDIO,GROUP-ID=\"', "
    "CASE WHEN l_tax > 0.04 THEN 'HIGH' ELSE 'low' END, '\",DEFAULT=', CASE WHEN l_linestatus = 'O' THEN '\"YES\"' ELSE 'YES' END, "
    "CASE WHEN l_discount > 0.09 THEN '' ELSE concat(',URI=\"audio-aac-', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9)), 'k-', l_partkey, '.m3u8\"') END)")
STREAM_LINE = (
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '#EXT-X-STREAM-INF:BANDWIDTH=1,VIDEO=\"audio_only\"' "
    "WHEN l_returnflag = 'R' THEN '#EXT-X-STREAM-INF:CODECS=\"mp4a.40.2\"' "
    "WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN '#EXT-X-STREAM-INF:CODECS=\"mp4a.40.2,avc1\"' "
    "WHEN l_tax = 0.0 THEN '   ' ELSE concat(' p', l_partkey, '.m3u8 ') END")
QUALITY = {
    "kind": "CASE WHEN l_linestatus = 'O' THEN 'video' ELSE 'audio' END",
    "id": "concat('q', l_partkey)",
    "level": "CASE WHEN l_tax > 0.01 THEN CAST(l_quantity AS BIGINT) END",
    "available": "CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag = 'N' OR l_discount > 0.03 END",
}
CDN = ("concat('{\"default_cdn\":\"', CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE 'b' END, '\",\"cdns\":{\"a\":{\"url\":\"u\"},\"b\":{', "
       "CASE WHEN o_orderkey % 2 = 0 THEN concat('\"url\":\"m', o_orderkey, '\",') ELSE '' END, '\"avc_url\":\"v', o_orderkey, '\"}}}')")


def _cols(exprs: dict) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def _items(spark, sf, exprs):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS asset", *POS, *_cols(exprs))


def rank_transcodings(spark, sf):
    return ops.rank_transcodings(_items(spark, sf, TRANSCODING), "asset", POS, ["url"])


def pick_video_variant(spark, sf):
    return ops.pick_video_variant(_items(spark, sf, VARIANT), "asset", POS, ["content_type", "bitrate", "url"])


def pick_smallest_progressive(spark, sf):
    return ops.pick_smallest_progressive(_items(spark, sf, PROGRESSIVE), "asset", POS, ["url"])


def select_stream_variant(spark, sf):
    return ops.select_stream_variant(_items(spark, sf, STREAM), "asset", POS, ["url"])


def select_audio_rendition(spark, sf):
    return ops.select_audio_rendition(_items(spark, sf, {"line": MEDIA_LINE.replace("#EXT-X-STREAM-INF:", "#X:")}), "asset", POS)


def score_audio_rendition(spark, sf):
    return ops.score_audio_rendition(_items(spark, sf, {"line": MEDIA_LINE}), "asset", POS)


def first_audio_only_stream(spark, sf):
    # lines of an asset follow the part key, so part-key ranges cut a large asset
    df = _items(spark, sf, {"line": STREAM_LINE}).selectExpr("*", "l_partkey div 4096 AS part_range")
    order = ["l_partkey", *[c for c in POS if c != "l_partkey"]]
    return ops.first_audio_only_stream(df, "asset", ["part_range"], order)


def top_quality_pairs(spark, sf):
    return ops.top_quality_pairs(_items(spark, sf, QUALITY), "asset", POS)


def resolve_default_cdn(spark, sf):
    return ops.resolve_default_cdn(table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{CDN} AS config"))


def first_success_or_last_error(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "user_id AS source", "event_id AS prio", "event_type IN ('purchase', 'signup') AND value > 400 AS ok",
        "concat(event_type, '-', event_id) AS result")
    return ops.first_success_or_last_error(df, "source", "prio")


QUERIES = {f.__name__: f for f in (
    rank_transcodings, pick_video_variant, pick_smallest_progressive, select_stream_variant, select_audio_rendition,
    score_audio_rendition, first_audio_only_stream, top_quality_pairs, resolve_default_cdn,
    first_success_or_last_error)}


def _from(exprs: dict) -> str:
    return f"(SELECT l_orderkey AS asset, {POS_SQL}, {', '.join(_cols(exprs))} FROM lineitem)"


def _pick(source: str, order: str, out: str) -> str:
    return (f"WITH s AS ({source}), r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY {order}) AS rn FROM s) "
            f"SELECT asset, {out} FROM r WHERE rn = 1")


_BEST = ("r AS (SELECT *, row_number() OVER (PARTITION BY asset, kind ORDER BY coalesce(level, 0) DESC, " + POS_SQL + ") AS rn "
         f"FROM {_from(QUALITY)} WHERE available)")

ORACLES = {
    "rank_transcodings": _pick(
        f"SELECT *, CASE protocol WHEN 'progressive' THEN 2 ELSE 1 END AS protocol_score, "
        f"CASE WHEN mime_type = 'audio/mpeg' THEN 2 ELSE 1 END AS mime_score, "
        f"CASE WHEN quality = 'sq' THEN 1 ELSE 0 END + CASE WHEN preset = 'abr_sq' THEN 1 ELSE 0 END AS quality_score "
        f"FROM {_from(TRANSCODING)} WHERE mime_type <> 'audio/ogg' AND protocol <> 'dash'",
        f"protocol_score DESC, mime_score DESC, quality_score DESC, {POS_DESC}",
        "url, protocol_score, mime_score, quality_score"),
    "pick_video_variant": _pick(
        f"SELECT * FROM {_from(VARIANT)} WHERE url IS NOT NULL",
        f"CASE content_type WHEN 'application/x-mpegURL' THEN 0 WHEN 'video/mp4' THEN 1 ELSE 2 END, coalesce(bitrate, 0) DESC, {POS_SQL}",
        "content_type, bitrate, url"),
    "pick_smallest_progressive": _pick(
        f"SELECT *, coalesce(width, 0) * coalesce(height, 0) AS area FROM {_from(PROGRESSIVE)}", f"area, {POS_SQL}", "url, area"),
    "select_stream_variant": _pick(
        f"SELECT *, CASE WHEN has_video OR codecs LIKE 'AVC1%' THEN 3 WHEN codecs LIKE 'mp4a%' THEN 0 WHEN has_audio_group THEN 1 ELSE 2 END AS stream_class, "
        f"coalesce(average_bandwidth, bandwidth) AS used_bandwidth FROM {_from(STREAM)} WHERE NOT is_iframe",
        f"stream_class, used_bandwidth, {POS_SQL}", "url, stream_class, used_bandwidth"),
    "score_audio_rendition": _pick(
        "SELECT l_orderkey AS asset, *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.04 THEN 2 ELSE 0 END AS score, "
        "'audio-aac-' || CAST(l_quantity AS BIGINT) || 'k-' || l_partkey || '.m3u8' AS uri FROM lineitem WHERE l_returnflag <> 'R' AND NOT l_discount > 0.09",
        f"score DESC, {POS_DESC}", "score, uri"),
    "first_audio_only_stream": f"""
WITH l AS (SELECT l_orderkey AS asset, trim({STREAM_LINE}) AS line, {POS_SQL} FROM lineitem),
n AS (SELECT *, row_number() OVER w AS rn, lead(line) OVER w AS nxt FROM l WHERE line <> ''
 WINDOW w AS (PARTITION BY asset ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate))
SELECT asset, arg_min(nxt, rn) AS uri FROM n WHERE (line LIKE '%audio_only%' OR (line LIKE '%CODECS="mp4a.%' AND line NOT LIKE '%avc1%'))
 AND nxt IS NOT NULL AND NOT starts_with(nxt, '#') GROUP BY asset""",
    "top_quality_pairs": f"""
WITH {_BEST}, v AS (SELECT asset, CAST(rn AS INTEGER) AS video_rank, id AS video_id FROM r WHERE kind = 'video' AND rn <= 2),
a AS (SELECT asset, CAST(rn AS INTEGER) AS audio_rank, id AS audio_id FROM r WHERE kind = 'audio' AND rn <= 3)
SELECT coalesce(v.asset, a.asset) AS asset, video_rank, video_id, audio_rank, audio_id,
 CASE WHEN video_id IS NULL OR audio_id IS NULL THEN 'no playable quality pair' END AS error FROM v FULL JOIN a ON v.asset = a.asset""",
    "resolve_default_cdn": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'm' || o_orderkey ELSE 'v' || o_orderkey END AS master_url FROM orders""",
    "first_success_or_last_error": """
WITH a AS (SELECT user_id AS source, event_id AS prio, event_type IN ('purchase', 'signup') AND value > 400 AS ok, event_type || '-' || event_id AS result FROM events)
SELECT source, bool_or(ok) AS resolved, coalesce(arg_min(result, prio) FILTER (WHERE ok), arg_max(result, prio) FILTER (WHERE NOT ok)) AS result FROM a GROUP BY source""",
}
ORACLES["select_audio_rendition"] = _pick(
    "SELECT l_orderkey AS asset, *, CAST(l_quantity AS BIGINT) AS bitrate, 'audio-aac-' || CAST(l_quantity AS BIGINT) || 'k-' || l_partkey || '.m3u8' AS uri "
    "FROM lineitem WHERE l_returnflag <> 'R' AND NOT l_discount > 0.09", f"bitrate DESC, {POS_DESC}", "bitrate, uri")
