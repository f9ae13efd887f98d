"""Registered page and payload queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.operators import pages as ops
from segue.plans.tables import table
from segue.session import spread

Q = "&quot;"
_ALBUM = (
    "concat('<div data-tralbum = ''{\"url\":\"https://s.example.com/track/', page_id, '\",\"current\":{', "
    "CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('\"title\":\"Song &amp;amp; ', page_id, '\"') END, "
    "'},\"trackinfo\":[{', CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('\"track_id\":', page_id, ',') END, "
    "'\"title\":\"Alt ', page_id, '\",\"duration\":', page_id, '.5,\"file\":{', "
    "CASE WHEN page_id % 7 = 0 THEN '' ELSE concat('\"mp3-128\":\"https://b.example.com/s?ts=', page_id + 1700000000, '\"') END, '}}]}''></div>')"
)
PAGE_HTML = (
    "concat('<meta content=\"t', page_id, '\" property=\"og:title\"><meta property=''og:site_name'' content=\"Site ', page_id, '\">', "
    "'<meta name=\"server-response\" content=\"{&quot;data&quot;:{&quot;response&quot;:{&quot;video&quot;:{&quot;id&quot;:&quot;sm', page_id, '&quot;,"
    "&quot;duration&quot;:', page_id + 60, ',&quot;thumbnail&quot;:{&quot;player&quot;:&quot;p.jpg&quot;}},&quot;client&quot;:{},&quot;media&quot;:{&quot;domand&quot;:{}}}}}\">', "
    f"{_ALBUM}, "
    "'<script defer type=''Application/LD+json''> {\"@id\":\"i\",\"byArtist\":{', CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('\"name\":\"Artist ', page_id, '\"') END, '}} </script>', "
    "'<script src=\"/js/a', page_id, '.js?v=1\"></script><script async src=\"b.js\"></script><script src=\"c.css\"></script>', "
    "'<script>window.__sc_hydration = [{\"hydratable\":\"user\",\"data\":{\"id\":1}},{\"hydratable\":\"sound\",\"data\":{\"id\":', page_id, "
    "',\"title\":\"Snd ', page_id, '\",\"duration\":', page_id * 1000, ',\"user\":{\"username\":\"u\"},\"media\":{\"transcodings\":[{},{}]}}}];</script>', html)"
)


def _pages(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "url", f"{PAGE_HTML} AS html")


def extract_attribute(spark, sf):
    return ops.extract_attribute(_pages(spark, sf), "href").select("page_id", "value")


def extract_meta_content(spark, sf):
    df = ops.extract_meta_content(_pages(spark, sf), "property", "og:title", out="og_title")
    df = ops.extract_meta_content(df, "property", "og:image", out="og_image")
    return ops.extract_meta_content(df, "charset", "utf-8", out="charset_content").select(
        "page_id", "og_title", "og_image", "charset_content")


def extract_structured_script(spark, sf):
    df = ops.extract_structured_script(_pages(spark, sf))
    return ops.extract_structured_script(df, "<script>", out="plain").select("page_id", "body", "plain")


def decode_entities(spark, sf):
    return ops.decode_entities(_pages(spark, sf)).select("page_id", "html")


def extract_script_urls(spark, sf):
    return ops.extract_script_urls(_pages(spark, sf)).drop("url")


def build_page_metadata(spark, sf):
    return ops.build_page_metadata(_pages(spark, sf)).drop("url")


PAYLOADS = {
    "soundcloud": (
        "concat('{\"id\":', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat(',\"urn\":\"urn:', o_orderkey, '\"') ELSE '' END, "
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',\"title\":\"T\"' END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',\"media\":{}' END, "
        "',\"duration\":', o_custkey, '}')"),
    "vimeo": (
        "concat('{\"video\":{\"id\":', o_orderkey, ',\"url\":\"https://v/', o_custkey, '\"', CASE WHEN o_orderkey % 3 = 0 THEN concat(',\"share_url\":\"https://s/', o_custkey, '\"') ELSE '' END, "
        "',\"owner\":{\"name\":\"', o_orderpriority, '\"},\"duration\":', o_custkey, '}', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',\"request\":{}' END, '}')"),
    "twitch": (
        "concat('{\"data\":{\"user\":{\"login\":\"l', o_custkey, '\",\"displayName\":\"D', o_custkey, '\",\"profileImageURL\":\"p.png\",\"stream\":', "
        "CASE WHEN o_orderkey % 4 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN '{}' ELSE '{\"title\":\"Live\",\"previewImageURL\":\"i-{width}x{height}.jpg\"}' END, '}}}')"),
    "twitch_video": (
        "concat('{\"data\":{\"video\":', CASE WHEN o_orderkey % 6 = 0 THEN 'null' ELSE concat('{\"id\":\"', o_orderkey, '\",\"lengthSeconds\":', o_custkey, "
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',\"title\":\"Past\"' END, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',\"previewThumbnailURL\":\"v.jpg\"' END, "
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(',\"owner\":{\"displayName\":\"O', o_custkey, '\",\"profileImageURL\":\"o.png\"}') END, '}') END, '}}')"),
    "niconico": (
        "concat('{\"data\":{\"response\":{\"video\":{\"id\":\"sm', o_orderkey, '\",\"duration\":', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN ',\"title\":\"N\"' ELSE '' END, "
        "',\"thumbnail\":{\"url\":\"u.jpg\"', CASE WHEN o_orderkey % 3 = 0 THEN ',\"ogp\":\"o.jpg\"' ELSE '' END, '}},\"client\":{},\"media\":{', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '\"domand\":{}' END, '}}}}')"),
}
SHAPE_OF = "CASE o_custkey % 5 WHEN 0 THEN 'soundcloud' WHEN 1 THEN 'vimeo' WHEN 2 THEN 'twitch' WHEN 3 THEN 'twitch_video' ELSE 'niconico' END"


def normalize_payloads(spark, sf):
    orders = table(spark, sf, "orders").withColumn("shape", F.expr(SHAPE_OF))
    parts = []
    for shape, payload in PAYLOADS.items():
        rows = orders.where(F.col("shape") == shape).selectExpr(
            "o_orderkey AS id", "shape", "'https://asked.example.com/' AS url", f"{payload} AS payload")
        parts.append(ops.normalize_payloads(rows, shape).drop("url"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


POST = (
    "concat('{\"core\":{\"user_results\":{\"result\":{\"core\":{\"name\":\"N', user_id, '\"}}}},\"legacy\":{\"full_text\":\"clip ', event_id, ' https://t.example.com/x\"', "
    "CASE WHEN event_type = 'view' THEN '' ELSE concat(',\"entities\":{\"media\":[{\"media_url_https\":\"i.jpg\",\"video_info\":{\"duration_millis\":', event_id, ',\"variants\":[', "
    "CASE WHEN event_type = 'click' THEN '' ELSE '{\"content_type\":\"video/mp4\",\"url\":\"low\",\"bitrate\":5},{\"content_type\":\"video/mp4\",\"url\":\"high\",\"bitrate\":9}' END, "
    "CASE WHEN event_type = 'purchase' THEN ',{\"content_type\":\"application/x-mpegURL\",\"url\":\"list\"}' ELSE '' END, ']}}]}') END, '}}')")


def normalize_posts(spark, sf):
    # a post is parsed many times: the events are spread first, as a small file would be few tasks
    events = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id")
    df = events.selectExpr("event_id", "event_id AS post_id", "'https://x.example.com/' AS url", f"{POST} AS payload")
    return ops.normalize_posts(df).drop("post_id", "url")


def pick_hydration_entry(spark, sf):
    return ops.pick_hydration_entry(_pages(spark, sf)).drop("url", "urn", "permalink_url")


def extract_embedded_response(spark, sf):
    df = ops.extract_embedded_response(_pages(spark, sf))
    return df.select("page_id", F.try_variant_get("response", "$.data.response.video.id", "string").alias("video_id"),
                     F.try_variant_get("response", "$.data.response.video.duration", "long").alias("duration_s"))


_MEDIA = "concat('{\"k\":', event_id, ',\"video_info\":{\"variants\":[]}}')"
MEDIA_PAYLOAD = (
    "CASE event_type "
    f"WHEN 'view' THEN concat('{{\"legacy\":{{\"extended_entities\":{{\"media\":[{{}},', {_MEDIA}, ']}}}}}}') "
    f"WHEN 'click' THEN concat('{{\"legacy\":{{\"entities\":{{\"media\":[', {_MEDIA}, ']}}}}}}') "
    f"WHEN 'purchase' THEN concat('{{\"b\":{{\"k\":0}},\"a\":[1,{{\"z\":', {_MEDIA}, '}}]}}') "
    "WHEN 'signup' THEN '{\"legacy\":{\"entities\":{\"media\":[{\"video_info\":{}}]}}}' ELSE props END"
)


def find_media_node(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", f"{MEDIA_PAYLOAD} AS payload")
    return ops.find_media_node(df).select("event_id", F.get_json_object("media", "$.k").cast("long").alias("k"))


QUERIES = {f.__name__: f for f in (
    extract_attribute, extract_meta_content, extract_structured_script, decode_entities, extract_script_urls,
    build_page_metadata, normalize_payloads, normalize_posts, pick_hydration_entry, extract_embedded_response, find_media_node)}

_P = f"SELECT page_id, url, {PAGE_HTML} AS html FROM pages"
_DECODED = ("replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&#34;', '\"'), '&amp;', '&'), "
            "'&#39;', ''''), '&lt;', '<'), '&gt;', '>')")


def _orders_of(shape: str) -> str:
    return f"(SELECT * FROM orders WHERE {SHAPE_OF} = '{shape}')"


def _record(shape, err, key, url, title, author, thumb, dur) -> str:
    fields = ((key, "canonical_key"), (url, "canonical_url"), (title, "title"), (author, "author"),
              (thumb, "thumbnail"), (dur, "duration_us"))
    cols = ", ".join(f"CASE WHEN e IS NULL THEN {x} END AS {n}" for x, n in fields)
    return (f"SELECT o_orderkey AS id, '{shape}' AS shape, e AS error, {cols} FROM "
            f"(SELECT *, {err} AS e FROM {_orders_of(shape)})")


ORACLES = {
    "extract_attribute": f"SELECT page_id, nullif(regexp_extract(html, '(?:^|[^A-Za-z0-9_:-])href=\"([^\"]*)\"', 1), '') AS value FROM ({_P})",
    "extract_meta_content": "SELECT page_id, 't' || page_id AS og_title, CAST(NULL AS VARCHAR) AS og_image, CAST(NULL AS VARCHAR) AS charset_content FROM pages",
    "extract_structured_script": """
SELECT page_id, '{"@id":"i","byArtist":{' || CASE WHEN page_id % 5 = 0 THEN '' ELSE '"name":"Artist ' || page_id || '"' END || '}}' AS body,
 'window.__sc_hydration = [{"hydratable":"user","data":{"id":1}},{"hydratable":"sound","data":{"id":' || page_id || ',"title":"Snd ' || page_id ||
 '","duration":' || (page_id * 1000) || ',"user":{"username":"u"},"media":{"transcodings":[{},{}]}}}];' AS plain FROM pages""",
    "decode_entities": f"SELECT page_id, {_DECODED.format(x='html')} AS html FROM ({_P})",
    "extract_script_urls": f"""
WITH u AS (SELECT page_id, regexp_extract_all(html, '<script[^>]+src="([^"]+\\.js[^"]*)"', 1) AS a FROM ({_P}))
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS script_url FROM u, range(1, 100) r(i) WHERE i <= len(a)""",
    "build_page_metadata": """
WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'missing stream URL' END AS error FROM pages)
SELECT page_id, error, CASE WHEN error IS NULL THEN 'https://s.example.com/track/' || page_id END AS canonical_url,
 CASE WHEN error IS NULL THEN CASE WHEN page_id % 4 = 0 THEN 'bandcamp:url:https://s.example.com/track/' ELSE 'bandcamp:track:' END || page_id END AS canonical_key,
 CASE WHEN error IS NULL THEN CASE WHEN page_id % 3 = 0 THEN 'Alt ' ELSE 'Song &amp; ' END || page_id END AS title,
 CASE WHEN error IS NULL THEN CASE WHEN page_id % 5 = 0 THEN 'Site ' ELSE 'Artist ' END || page_id END AS author,
 CAST(NULL AS VARCHAR) AS thumbnail, CASE WHEN error IS NULL THEN page_id * 1000000 + 500000 END AS duration_us,
 CASE WHEN error IS NULL THEN 'https://b.example.com/s?ts=' || (page_id + 1700000000) END AS stream_url,
 CASE WHEN error IS NULL THEN page_id + 1700000000 END AS expires_at FROM p""",
    "normalize_payloads": " UNION ALL ".join((
        _record("soundcloud", "CASE WHEN o_orderkey % 5 = 0 THEN 'missing media payload' END",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'urn:' ELSE 'soundcloud:tracks:' END || o_orderkey",
                "'https://asked.example.com/'",
                "CASE WHEN o_orderkey % 4 = 0 THEN 'https://asked.example.com/' ELSE 'T' END", "'SoundCloud'",
                "CAST(NULL AS VARCHAR)", "o_custkey * 1000"),
        _record("vimeo", "CASE WHEN o_orderkey % 5 = 0 THEN 'missing request payload' END",
                "'vimeo:video:' || o_orderkey",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'https://s/' ELSE 'https://v/' END || o_custkey",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'https://s/' ELSE 'https://v/' END || o_custkey",
                "o_orderpriority", "CAST(NULL AS VARCHAR)", "o_custkey * 1000000"),
        _record("twitch", "CASE WHEN o_orderkey % 4 = 0 THEN 'channel is not live' END",
                "'twitch:channel:l' || o_custkey", "'https://www.twitch.tv/l' || o_custkey",
                "CASE WHEN o_orderkey % 4 = 1 THEN 'https://www.twitch.tv/l' || o_custkey ELSE 'Live' END",
                "'D' || o_custkey", "CASE WHEN o_orderkey % 4 = 1 THEN 'p.png' ELSE 'i-640x360.jpg' END",
                "CAST(NULL AS BIGINT)"),
        _record("twitch_video", "CASE WHEN o_orderkey % 6 = 0 THEN 'missing video payload' WHEN o_orderkey % 5 = 0 THEN 'missing video owner' END",
                "'twitch:video:' || o_orderkey", "'https://www.twitch.tv/videos/' || o_orderkey",
                "CASE WHEN o_orderkey % 4 = 0 THEN 'https://www.twitch.tv/videos/' || o_orderkey ELSE 'Past' END",
                "'O' || o_custkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'o.png' ELSE 'v.jpg' END", "o_custkey * 1000000"),
        _record("niconico", "CASE WHEN o_orderkey % 5 = 0 THEN 'missing media payload' END",
                "'niconico:video:sm' || o_orderkey", "'https://www.nicovideo.jp/watch/sm' || o_orderkey",
                "CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'sm' || o_orderkey END", "'niconico'",
                "CASE WHEN o_orderkey % 3 = 0 THEN 'o.jpg' ELSE 'u.jpg' END", "o_custkey * 1000000"))),
    "normalize_posts": """
WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'missing media' WHEN 'click' THEN 'missing video variant' END AS error FROM events)
SELECT event_id, error, CASE WHEN error IS NULL THEN 'x:tweet:' || event_id END AS canonical_key, CASE WHEN error IS NULL THEN 'clip ' || event_id END AS title,
 CASE WHEN error IS NULL THEN 'N' || user_id END AS author, CASE WHEN error IS NULL THEN 'i.jpg' END AS thumbnail, CASE WHEN error IS NULL THEN event_id * 1000 END AS duration_us,
 CASE WHEN error IS NULL THEN CASE WHEN event_type = 'purchase' THEN 'list' ELSE 'high' END END AS stream_url, CASE WHEN error IS NULL THEN CASE WHEN event_type = 'purchase' THEN 'hls' ELSE 'http' END END AS kind FROM e""",
    "pick_hydration_entry": """
SELECT page_id, page_id AS id, 'Snd ' || page_id AS title, page_id * 1000 AS duration_ms, 'u' AS username, CAST(2 AS INTEGER) AS transcodings FROM pages""",
    "extract_embedded_response": "SELECT page_id, 'sm' || page_id AS video_id, page_id + 60 AS duration_s FROM pages",
    "find_media_node": "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_id END AS k FROM events",
}
