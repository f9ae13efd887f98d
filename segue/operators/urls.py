"""URL column jobs: filters, routing, canonical keys, headers, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue import rules
from segue.functions import urls as U
from segue.rules import HOST_POLICIES, HostPolicy


def filter_allowed_urls(df: DataFrame, url: str = "url", scope: str = "track", policies=HOST_POLICIES) -> DataFrame:
    return df.where(U.policy_allows(F.col(url), scope, policies))


def validate_playback_targets(df: DataFrame, provider: str = "provider", url: str = "url",
                              policies=HOST_POLICIES) -> DataFrame:
    """Adds ``allowed`` and, for violations, ``violation`` with the redacted URL."""
    ok = U.provider_allows(F.col(provider), F.col(url), "playback", policies)
    known = F.col(provider).isin(*sorted({p.provider for p in policies}))
    reported = F.coalesce(U.summary(F.col(url)), F.lit("<invalid-url>"))
    return df.withColumn("allowed", ok).withColumn(
        "violation",
        F.when(~known, F.concat(F.lit("unknown provider "), F.col(provider)))
        .when(~ok, F.concat(F.lit("unsafe target for "), F.col(provider), F.lit(": "), reported)))


def audit_redirect_chains(hops: DataFrame, chain: str = "chain", hop: str = "hop", url: str = "url",
                          policies=HOST_POLICIES) -> DataFrame:
    """One row per chain. ``hop`` counts the predecessors of the hop."""
    allowed = U.policy_allows(F.col(url), "track", policies) | U.policy_allows(F.col(url), "playback", policies)
    fits = F.col(hop) < rules.MAX_REDIRECTS
    return (hops.groupBy(chain)
            .agg(F.count(F.lit(1)).alias("hops"),
                 F.bool_and(allowed & fits).alias("accepted"),
                 F.min(F.when(~fits | ~allowed, F.struct(
                     F.col(hop), F.when(~fits, F.lit("too many redirects"))
                     .otherwise(F.lit("redirect target host is not allowed")).alias("reason")))).alias("_f"))
            .select(chain, "hops", "accepted", F.col("_f.reason").alias("reason")))


def filter_forwarded_headers(df: DataFrame, origin: str = "origin", target: str = "target",
                             headers: str = "headers") -> DataFrame:
    safe = F.map_filter(headers, lambda k, v: F.lower(k).isin(*rules.CROSS_HOST_HEADERS))
    same = U.same_host(F.col(origin), F.col(target))
    return df.withColumn(headers, F.when(same, F.col(headers)).otherwise(safe))


def sanitize_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Keeps allow-listed names; ``unsafe`` marks records that must fail."""
    kept = F.map_filter(headers, lambda k, v: F.lower(k).isin(*rules.CROSS_HOST_HEADERS))
    bad = F.exists(F.map_values(kept),
                   lambda v: v.rlike("[\r\n]") | (F.octet_length(v) > rules.MAX_HEADER_VALUE_BYTES))
    return (df.withColumn("unsafe", F.coalesce(bad | (F.size(kept) > rules.MAX_HEADERS), F.lit(False)))
            .withColumn(headers, F.when(~F.col("unsafe"), F.coalesce(kept, F.create_map().cast("map<string,string>")))))


def redact_urls(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, U.redact(F.col(text)))


def provider_rules(track_hosts: dict[str, tuple[str, ...]] | None = None) -> dict[str, object]:
    """``supports`` predicates, url column -> boolean column.

    ``track_hosts`` swaps the host names each rule listens to.
    """
    hosts = {p.provider: p.exact for p in HOST_POLICIES if p.scope == "track"}
    hosts.update(track_hosts or {})

    def on(provider: str):
        return lambda u: U.host(u).isin(*hosts[provider])

    def store_page(u: Column) -> Column:
        ends = F.lit(False)
        for name in hosts["bandcamp"]:
            ends = ends | U.host(u).endswith("." + name)
        return ends & U.path(u).contains("/track/")

    def status_page(u: Column) -> Column:
        # empty segments count here
        parts = F.split(U.path(u), "/")
        return U.host(u).isin(*hosts["x"]) & (F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == "status")

    return {
        "youtube": on("youtube"),
        "soundcloud": on("soundcloud"),
        "bandcamp": store_page,
        "niconico": on("niconico"),
        "vimeo": lambda u: video_reference(u, hosts["vimeo"])["id"].isNotNull(),
        "twitch": lambda u: channel_target(u, hosts["twitch"]).isNotNull(),
        "x": status_page,
    }


def route_provider(df: DataFrame, url: str = "url", supports: dict | None = None,
                   order=rules.PROVIDER_ORDER) -> DataFrame:
    supports = supports or provider_rules()
    routed = F.coalesce(*[F.when(supports[p](F.col(url)), F.lit(p)) for p in order], F.lit("unsupported"))
    return df.withColumn("provider", routed)


def channel_target(url: Column, hosts) -> Column:
    """``channel:<login>`` or ``video:<digits>``."""
    seg = U.segments(url)
    first, second = F.get(seg, F.lit(0)), F.get(seg, F.lit(1))
    video = (first == "videos") & second.rlike("^[0-9]+$")
    login = (F.size(seg) == 1) & ~first.isin(*rules.RESERVED_CHANNELS)
    return F.when(U.host(url).isin(*hosts),
                  F.when(video, F.concat(F.lit("video:"), second))
                  .when(login, F.concat(F.lit("channel:"), F.lower(first))))


def video_reference(url: Column, hosts) -> Column:
    """Struct(id, hash): last all-digit segment; hash from ``h=`` or the next segment.

    The ``player.`` host of the list takes ``/video/<digits>`` only.
    """
    seg = U.segments(url)
    h = U.host(url)
    player = [x for x in hosts if x.startswith("player.")]
    site = [x for x in hosts if not x.startswith("player.")]
    digits = F.transform(seg, lambda s, i: F.when(s.rlike("^[0-9]+$"), i))
    last = F.array_max(digits)
    nxt = F.get(seg, last + 1)
    fallback = F.when(nxt.rlike("^[0-9A-Fa-f]{6,}$"), nxt)
    on_site = h.isin(*site) if site else F.lit(False)
    on_player = h.isin(*player) if player else F.lit(False)
    second = F.get(seg, F.lit(1))
    player_id = F.when((F.get(seg, F.lit(0)) == "video") & second.rlike("^[0-9]+$"), second)
    return F.struct(
        F.when(on_player, player_id).when(on_site, F.get(seg, last)).alias("id"),
        F.when(on_player & player_id.isNotNull(), U.query_value(url, "h"))
        .when(on_site & last.isNotNull(), F.coalesce(U.query_value(url, "h"), fallback)).alias("hash"))


def canonicalize_targets(df: DataFrame, url: str = "url", track_hosts: dict | None = None) -> DataFrame:
    """Adds ``twitch_key``, ``vimeo_key``, ``vimeo_hash``, ``x_key``."""
    hosts = {p.provider: p.exact for p in HOST_POLICIES if p.scope == "track"}
    hosts.update(track_hosts or {})
    u = F.col(url)
    ref = video_reference(u, hosts["vimeo"])
    parts = F.split(U.path(u), "/")
    status = F.when(U.host(u).isin(*hosts["x"]) & (F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == "status"),
                    F.get(parts, F.lit(3)))
    return (df.withColumn("twitch_key", F.concat(F.lit("twitch:"), channel_target(u, hosts["twitch"])))
            .withColumn("vimeo_key", F.concat(F.lit("vimeo:video:"), ref["id"]))
            .withColumn("vimeo_hash", ref["hash"])
            .withColumn("x_key", F.concat(F.lit("x:tweet:"), status)))


def soundcloud_id(key: Column) -> Column:
    digits = F.regexp_extract(key, r"^soundcloud:tracks:(.*)$", 1)
    return U.unsigned(digits)


def extract_url_expiry(df: DataFrame, url: str = "url", token: str | None = None,
                       config: str | None = None) -> DataFrame:
    """Adds ``expire``, ``clen``, ``ts`` from the query, ``token_expires`` from a
    JSON token and ``config_expires`` = timestamp + expires of a JSON config."""
    for key in ("expire", "clen", "ts"):
        df = df.withColumn(key, U.unsigned(U.query_value(F.col(url), key)))
    if token:
        df = df.withColumn("token_expires", U.unsigned(F.get_json_object(token, "$.expires")))
    if config:
        df = df.withColumn("config_expires", F.try_add(
            U.unsigned(F.get_json_object(config, "$.timestamp")), U.unsigned(F.get_json_object(config, "$.expires"))))
    return df


def build_prepared_source(df: DataFrame) -> DataFrame:
    """From extractor columns (id, stream_url, webpage_url, is_live, protocol, filesize,
    filesize_approx, title, uploader, channel, duration_s) to source and metadata columns.
    """
    u = F.col("stream_url")
    live = F.coalesce(F.col("is_live"), F.lit(False))
    hls = live | F.coalesce(F.col("protocol").contains("m3u8"), F.lit(False)) | u.contains(".m3u8")
    on_cdn = F.coalesce((U.host(u) == "googlevideo.com") | U.host(u).endswith(".googlevideo.com"), F.lit(False))
    length = F.coalesce(F.col("filesize"), F.col("filesize_approx"), U.unsigned(U.query_value(u, "clen")))
    canonical = F.coalesce(F.nullif(F.col("webpage_url"), F.lit("")),
                           F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("id")))
    seconds = F.col("duration_s")
    return df.where(F.coalesce(u, F.lit("")) != "").select(
        "*",
        F.when(hls, F.lit("hls")).otherwise(F.lit("http")).alias("kind"),
        F.when(~hls, length).alias("content_length"),
        F.when(~hls & on_cdn, F.lit(rules.RANGE_CHUNK_BYTES).cast("long")).alias("range_chunk_size"),
        F.when(~hls, F.when(on_cdn, F.lit("query")).otherwise(F.lit("header"))).alias("range_mode"),
        F.when(~hls, F.when(length.isNotNull() & on_cdn, F.lit("ranged")).otherwise(F.lit("plain")))
        .otherwise(F.lit("playlist")).alias("access_plan"),
        U.unsigned(U.query_value(u, "expire")).alias("expires_at"),
        canonical.alias("canonical_url"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), canonical).alias("final_title"),
        F.coalesce(F.nullif(F.col("uploader"), F.lit("")), F.nullif(F.col("channel"), F.lit("")),
                   F.lit("YouTube")).alias("author"),
        F.when(~live & ~F.isnan(seconds) & (seconds > 0) & (seconds != float("inf")),
               F.round(seconds * 1000000).cast("long")).alias("duration_us"))


def classify_failures(df: DataFrame, status: str = "status", parse_error: str = "parse_error",
                      token_refreshed: str = "token_refreshed", context_refreshed: str = "context_refreshed",
                      forbidden: str | None = None, reason: str | None = None) -> DataFrame:
    """Adds ``probe_action``, ``payload_action`` and ``forbidden_reason``."""
    s = F.col(status)
    probe = F.when(F.col(parse_error) | s.isin(400, 404, 410, 422), F.lit("html_fallback")).otherwise(F.lit("fail"))
    payload = (F.when(~F.col(parse_error) & s.isin(401, 403) & ~F.col(token_refreshed), F.lit("refresh_token"))
               .when(~F.col(parse_error) & s.isin(401, 403) & ~F.col(context_refreshed), F.lit("refresh_context"))
               .otherwise(F.lit("fail")))
    df = df.withColumn("probe_action", F.coalesce(probe, F.lit("fail")))
    df = df.withColumn("payload_action", F.coalesce(payload, F.lit("fail")))
    if forbidden:
        df = df.withColumn("forbidden_reason", F.when(F.col(forbidden), F.coalesce(F.col(reason), F.lit("unknown"))))
    return df


def clean_title(text: Column, fallback: Column) -> Column:
    bare = F.regexp_replace(text, r"https?://\S+", "")
    lines = F.transform(F.split(bare, "\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    joined = F.array_join(F.filter(lines, lambda s: s != ""), " ")
    return F.coalesce(F.nullif(joined, F.lit("")), fallback)


def compact_text(text: Column, limit: int = 500) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("…")))


def truncate_text(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three replaced by dots on overflow."""
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, max(limit - 3, 0)), F.lit("...")))


def format_duration(micros: Column) -> Column:
    """``MMm SSs``; minutes are not wrapped at 60."""
    seconds = F.floor(micros / 1000000)
    minutes, rest = F.floor(seconds / 60), seconds % 60

    def pad(n: Column) -> Column:
        return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))

    return F.coalesce(F.concat(pad(minutes), F.lit("m "), pad(rest), F.lit("s")), F.lit("--m --s"))


def normalize_titles(df: DataFrame, text: str = "text", fallback: str = "url", duration_us: str = "duration_us",
                     limit: int = 180) -> DataFrame:
    return (df.withColumn("title", clean_title(F.col(text), F.col(fallback)))
            .withColumn("short_title", truncate_text(F.col("title"), limit))
            .withColumn("compact", compact_text(F.col(text)))
            .withColumn("duration", format_duration(F.col(duration_us))))
