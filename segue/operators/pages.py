"""Page and payload extraction over page and JSON tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions import html as H
from segue.functions import urls as U
from segue.operators.urls import clean_title
from segue.session import cut_lineage

LD_JSON = '<script type="application/ld+json">'
HYDRATION_START, HYDRATION_END = "window.__sc_hydration = ", ";</script>"


def extract_attribute(df: DataFrame, name: str, text: str = "html", out: str = "value") -> DataFrame:
    return df.withColumn(out, H.attribute(F.col(text), name))


def extract_meta_content(df: DataFrame, key: str, value: str, text: str = "html", out: str = "content") -> DataFrame:
    return df.withColumn(out, H.meta_content(F.col(text), key, value))


def extract_structured_script(df: DataFrame, open_tag: str = LD_JSON, text: str = "html",
                              out: str = "body") -> DataFrame:
    return df.withColumn(out, H.script_body(F.col(text), open_tag))


def decode_entities(df: DataFrame, text: str = "html") -> DataFrame:
    return df.withColumn(text, H.decode_entities(F.col(text)))


def extract_script_urls(df: DataFrame, text: str = "html") -> DataFrame:
    """One row per script URL with its position on the page."""
    found = F.regexp_extract_all(F.col(text), F.lit(r'<script[^>]+src="([^"]+\.js[^"]*)"'), F.lit(1))
    return df.select("*", F.posexplode(found).alias("pos", "script_url")).drop(text)


def build_page_metadata(df: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """Store page to track record; ``error`` names the first missing mandatory part."""
    page, raw = F.col(text), F.col(url)
    base = df.withColumn("_attr", H.attribute(page, "data-tralbum"))
    base = base.withColumn("_album", F.try_parse_json(H.decode_entities(F.col("_attr"))))
    base = base.withColumn("_ldraw", H.script_body(page, LD_JSON))
    base = base.withColumn("_ld", F.try_parse_json(F.col("_ldraw")))
    album, ld = F.col("_album"), F.col("_ld")
    first = "$.trackinfo[0]"
    stream = H.text_at(album, first + ".file['mp3-128']")
    error = (F.when(F.col("_attr").isNull(), "missing data attribute")
             .when(album.isNull(), "invalid data attribute")
             .when(F.col("_ldraw").isNotNull() & ld.isNull(), "invalid ld+json")
             .when(~H.has(album, "$.current"), "missing current payload")
             .when(~H.has(album, first), "missing trackinfo")
             .when(stream.isNull(), "missing stream URL"))
    canonical = F.coalesce(H.text_at(album, "$.url"), H.text_at(ld, "$['@id']"), raw)
    number = H.whole_at(album, first + ".track_id")

    def ok(value: Column) -> Column:
        return F.when(F.col("error").isNull(), value)

    return base.withColumn("error", error).select(
        *[c for c in df.columns if c != text], "error",
        ok(canonical).alias("canonical_url"),
        ok(F.coalesce(F.concat(F.lit("bandcamp:track:"), number), F.concat(F.lit("bandcamp:url:"), canonical)))
        .alias("canonical_key"),
        ok(F.coalesce(H.text_at(album, "$.current.title"), H.text_at(album, first + ".title"), raw)).alias("title"),
        ok(F.coalesce(H.text_at(ld, "$.byArtist.name"), H.meta_content(page, "property", "og:site_name"),
                      F.lit("Unknown"))).alias("author"),
        ok(F.coalesce(H.text_at(ld, "$.image"), H.meta_content(page, "property", "og:image"))).alias("thumbnail"),
        ok(F.round(H.number_at(album, first + ".duration") * 1000000).cast("long")).alias("duration_us"),
        ok(stream).alias("stream_url"),
        ok(U.unsigned(U.query_value(stream, "ts"))).alias("expires_at"))


# Where each payload shape keeps its parts, in order of preference,
# with the default author, the key prefix, the time unit and the mandatory paths.
PAYLOAD_SHAPES = {
    "soundcloud": {
        "id": ("$.id", "number"), "prefix": "soundcloud:tracks:", "own_key": "$.urn",
        "title": ("$.title",), "author": ("$.user.username",), "default_author": "SoundCloud",
        "thumbnail": ("$.artwork_url",), "duration": ("$.duration", 1_000), "url": ("$.permalink_url",),
        "required": (("$.media", "missing media payload"),),
    },
    "vimeo": {
        "id": ("$.video.id", "number"), "prefix": "vimeo:video:",
        "title": ("$.video.title",), "author": ("$.video.owner.name",), "default_author": "Vimeo",
        "thumbnail": ("$.video.thumbnail_url",), "duration": ("$.video.duration", 1_000_000),
        "url": ("$.video.share_url", "$.video.url"),
        "required": (("$.video", "missing video payload"), ("$.request", "missing request payload")),
    },
    "twitch": {
        "id": ("$.data.user.login", "text"), "prefix": "twitch:channel:",
        "title": ("$.data.user.stream.title",), "author": ("$.data.user.displayName",), "default_author": "Twitch",
        "thumbnail": ("$.data.user.stream.previewImageURL", "$.data.user.profileImageURL"), "duration": None,
        "url_prefix": "https://www.twitch.tv/",
        "required": (("$.data.user", "missing user payload"), ("$.data.user.stream", "channel is not live")),
    },
    "twitch_video": {
        "id": ("$.data.video.id", "text"), "prefix": "twitch:video:",
        "title": ("$.data.video.title",), "author": ("$.data.video.owner.displayName",), "default_author": "Twitch",
        "thumbnail": ("$.data.video.previewThumbnailURL", "$.data.video.owner.profileImageURL"),
        "duration": ("$.data.video.lengthSeconds", 1_000_000), "url_prefix": "https://www.twitch.tv/videos/",
        "required": (("$.data.video", "missing video payload"), ("$.data.video.owner", "missing video owner")),
    },
    "niconico": {
        "id": ("$.data.response.video.id", "text"), "prefix": "niconico:video:",
        "title": ("$.data.response.video.title",), "title_default": "id",
        "author": ("$.data.response.owner.nickname",), "default_author": "niconico",
        "thumbnail": ("$.data.response.video.thumbnail.ogp", "$.data.response.video.thumbnail.player",
                      "$.data.response.video.thumbnail.url"),
        "duration": ("$.data.response.video.duration", 1_000_000), "url_prefix": "https://www.nicovideo.jp/watch/",
        "required": (("$.data.response", "missing response payload"), ("$.data.response.video", "missing video payload"),
                     ("$.data.response.client", "missing client payload"),
                     ("$.data.response.media.domand", "missing media payload")),
    },
}


def normalize_payloads(df: DataFrame, shape: str, payload: str = "payload", url: str = "url") -> DataFrame:
    """JSON payload of one provider shape to the common track record."""
    spec = PAYLOAD_SHAPES[shape]
    df = df.withColumn("_doc", F.try_parse_json(F.col(payload)))
    doc, raw = F.col("_doc"), F.col(url)

    def first_text(paths) -> Column:
        return F.coalesce(*[H.text_at(doc, p) for p in paths])

    path, kind = spec["id"]
    ident = H.whole_at(doc, path).cast("string") if kind == "number" else H.text_at(doc, path)
    error = F.when(doc.isNull(), "invalid payload")
    for needed, message in spec["required"]:
        error = error.when(F.coalesce(F.schema_of_variant(F.try_variant_get(doc, needed, "variant")), F.lit("VOID"))
                           == "VOID", message)
    error = error.when(ident.isNull(), "missing id")
    if "url_prefix" in spec:
        canonical = F.concat(F.lit(spec["url_prefix"]), ident)
    else:
        canonical = F.coalesce(first_text(spec["url"]), raw)
    key = F.concat(F.lit(spec["prefix"]), ident)
    if "own_key" in spec:
        key = F.coalesce(H.text_at(doc, spec["own_key"]), key)
    fallback = ident if spec.get("title_default") == "id" else canonical
    thumb = first_text(spec["thumbnail"])
    if shape.startswith("twitch"):
        thumb = F.replace(F.replace(thumb, F.lit("{width}"), F.lit("640")), F.lit("{height}"), F.lit("360"))
    length = F.lit(None).cast("long")
    if spec["duration"]:
        length = H.whole_at(doc, spec["duration"][0]) * spec["duration"][1]

    def ok(value: Column) -> Column:
        return F.when(F.col("error").isNull(), value)

    return df.withColumn("error", error).select(
        *[c for c in df.columns if c not in (payload, "_doc")], "error",
        ok(key).alias("canonical_key"), ok(canonical).alias("canonical_url"),
        ok(F.coalesce(first_text(spec["title"]), fallback)).alias("title"),
        ok(F.coalesce(first_text(spec["author"]), F.lit(spec["default_author"]))).alias("author"),
        ok(thumb).alias("thumbnail"), ok(length).alias("duration_us"))


def normalize_posts(df: DataFrame, payload: str = "payload", post: str = "post_id", url: str = "url") -> DataFrame:
    """Post payload with a media object to the common track record."""
    found = find_media_node(df.withColumn("_doc", F.try_parse_json(F.col(payload))), payload, "_media")
    found = found.withColumn("_m", F.try_parse_json("_media"))
    doc, media = F.col("_doc"), F.col("_m")
    usable = F.filter(F.try_variant_get(media, "$.video_info.variants", "array<variant>"),
                      lambda v: H.text_at(v, "$.content_type").isNotNull() & H.text_at(v, "$.url").isNotNull())
    kinds = F.transform(usable, lambda v, k: F.struct(
        F.when(H.text_at(v, "$.content_type") == "application/x-mpegURL", 0)
        .when(H.text_at(v, "$.content_type") == "video/mp4", 1).otherwise(2).alias("kind"),
        (-F.coalesce(H.whole_at(v, "$.bitrate"), F.lit(0))).alias("rate"), k.alias("k"), H.text_at(v, "$.url").alias("url")))
    best = F.array_min(kinds)
    error = F.when(media.isNull(), "missing media").when(best.isNull(), "missing video variant")
    found = found.withColumn("error", error).withColumn("_best", best)

    def ok(value: Column) -> Column:
        return F.when(F.col("error").isNull(), value)

    raw = F.coalesce(H.text_at(doc, "$.legacy.full_text"), F.col(url))
    hls = (F.col("_best.kind") == 0) | F.col("_best.url").contains(".m3u8")
    return found.select(
        *[c for c in df.columns if c != payload], "error",
        ok(F.concat(F.lit("x:tweet:"), F.col(post))).alias("canonical_key"),
        ok(clean_title(raw, F.col(url))).alias("title"),
        ok(F.coalesce(H.text_at(doc, "$.core.user_results.result.core.name"), F.lit("X"))).alias("author"),
        ok(H.text_at(media, "$.media_url_https")).alias("thumbnail"),
        ok(H.whole_at(media, "$.video_info.duration_millis") * 1000).alias("duration_us"),
        ok(F.col("_best.url")).alias("stream_url"), ok(F.when(hls, "hls").otherwise("http")).alias("kind"))


def pick_hydration_entry(df: DataFrame, text: str = "html", hydratable: str = "sound") -> DataFrame:
    """Typed columns of the first matching entry between the page markers."""
    entries = F.try_variant_get(F.try_parse_json(H.between(F.col(text), HYDRATION_START, HYDRATION_END)), "$",
                                "array<variant>")
    hit = F.filter(entries, lambda e: F.coalesce(H.text_at(e, "$.hydratable") == hydratable, F.lit(False)))
    df = df.withColumn("_entry", F.try_variant_get(F.get(hit, F.lit(0)), "$.data", "variant"))
    e = F.col("_entry")
    return df.select(
        *[c for c in df.columns if c not in (text, "_entry")],
        H.whole_at(e, "$.id").alias("id"), H.text_at(e, "$.urn").alias("urn"), H.text_at(e, "$.title").alias("title"),
        H.text_at(e, "$.permalink_url").alias("permalink_url"), H.whole_at(e, "$.duration").alias("duration_ms"),
        H.text_at(e, "$.user.username").alias("username"),
        F.size(F.try_variant_get(e, "$.media.transcodings", "array<variant>")).alias("transcodings"))


def extract_embedded_response(df: DataFrame, text: str = "html", out: str = "response") -> DataFrame:
    """Entity-decoded JSON of the ``server-response`` meta tag, as a variant."""
    return df.withColumn(out, F.try_parse_json(H.decode_entities(
        H.meta_content(F.col(text), "name", "server-response"))))


MEDIA_PATHS = ("$.legacy.extended_entities.media", "$.legacy.entities.media")


def find_media_node(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    """Media object of a payload: two fixed paths first, then anywhere, the first in depth-first order (keys sorted).

    What both fixed paths miss is searched level by level: the containers of a level that are no media object are exploded
    into the next. Every node carries its path of positions, so the first hit of a payload is its least path. A level is
    one job over the nodes left; there are as many as the deepest payload has levels. A text that names no ``video_info``
    holds no media object and is not searched; an escape may hide the name.
    """
    def usable(m: Column) -> Column:
        return F.try_variant_get(m, "$.video_info.variants", "array<variant>").isNotNull()

    doc = F.try_parse_json(F.col(payload))
    primary = F.coalesce(*[
        F.get(F.filter(F.try_variant_get(doc, p, "array<variant>"), usable), F.lit(0)) for p in MEDIA_PATHS])
    rows = cut_lineage(df.withColumn("_fixed", F.to_json(primary)).withColumn("_row", F.monotonically_increasing_id()))
    def promising(nodes: DataFrame) -> DataFrame:
        return nodes.where(F.col("_text").contains("video_info") | F.col("_text").contains("\\"))

    missed = rows.where("_fixed IS NULL")
    nodes = promising(missed.select("_row", F.array().cast("array<int>").alias("_path"), F.col(payload).alias("_text")))
    hits, found = [], df.sparkSession.createDataFrame([], "_row bigint, _path array<int>, _text string")
    while not nodes.isEmpty():
        level = nodes.select("_row", "_path", "_text", F.try_parse_json("_text").alias("_node")).withColumn(
            "_media", F.coalesce(usable(F.col("_node")), F.lit(False)))
        hits.append(level.where("_media").select("_row", "_path", "_text"))
        inner = level.where("NOT _media").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_node").outer()))
        inner = inner.select("_row", F.concat("_path", F.array("pos")).alias("_path"), F.to_json("value").alias("_text"))
        nodes = cut_lineage(promising(inner.where(F.substring("_text", 1, 1).isin("{", "["))))
    for level in hits:
        found = found.unionByName(level.select("_row", "_path", F.to_json(F.try_parse_json("_text")).alias("_text")))
    first = found.groupBy("_row").agg(F.min_by("_text", "_path").alias("_deep"))
    # only the missed rows are shuffled to their hits
    fixed = rows.where("_fixed IS NOT NULL").withColumn(out, F.col("_fixed"))
    deep = missed.join(first, "_row", "left").withColumn(out, F.col("_deep")).drop("_deep")
    return fixed.unionByName(deep).drop("_fixed", "_row", payload)
