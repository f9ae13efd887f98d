"""Dedupe, freshness, capacity, digests and data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import rules


def build_alias_index(records: DataFrame, written: list[str]) -> DataFrame:
    """alias -> canonical_key, the last write per alias wins."""
    names = F.array("asked_url", "requested_url", "canonical_url")
    rows = records.select(F.posexplode(names).alias("_i", "alias"), "canonical_key", *written)
    return (rows.groupBy("alias").agg(F.max(F.struct(*written, "_i", "canonical_key")).alias("_w"))
            .select("alias", "_w.canonical_key", *[F.col(f"_w.{w}").alias(w) for w in written]))


def lookup_cached(requests: DataFrame, aliases: DataFrame, metadata: DataFrame, prepared: DataFrame,
                  ttl_s: int = rules.METADATA_TTL_S) -> DataFrame:
    """requests(url, as_of_s) against aliases(url, canonical_key, cached_at_s), metadata and
    prepared (canonical_key, cached_at_s, record [, provider, expires_at]); adds ``hit``."""
    alias = aliases.select(F.col("url"), F.col("canonical_key"), F.col("cached_at_s").alias("_a"))
    meta = metadata.select("canonical_key", F.col("cached_at_s").alias("_m"), F.col("record").alias("_mr"))
    prep = prepared.select("canonical_key", F.col("cached_at_s").alias("_p"), F.col("record").alias("_pr"),
                           "provider", "expires_at")
    now = F.col("as_of_s")
    found = (requests.join(alias, "url", "left")
             .withColumn("canonical_key", F.when(now - F.col("_a") <= ttl_s, F.col("canonical_key")))
             .join(meta, "canonical_key", "left").join(prep, "canonical_key", "left"))
    known = F.coalesce(now - F.col("_m") <= ttl_s, F.lit(False))
    ready = known & F.coalesce(is_fresh(F.col("provider"), F.col("_p"), F.col("expires_at"), now), F.lit(False))
    return found.select(
        *requests.columns,
        F.when(ready, "prepared").when(known, "metadata").otherwise("miss").alias("hit"),
        F.when(ready, F.col("_pr")).when(known, F.col("_mr")).alias("record"))


def prepared_ttl(provider: Column) -> Column:
    return F.when(provider.isin(*rules.TRANSIENT_PROVIDERS), rules.TRANSIENT_TTL_S).otherwise(rules.PREPARED_TTL_S)


def is_stale(expires_at: Column, now: Column) -> Column:
    return F.coalesce(expires_at <= now + rules.REFRESH_SKEW_S, F.lit(False))


def is_fresh(provider: Column, cached_at: Column, expires_at: Column, now: Column) -> Column:
    return (now - cached_at <= prepared_ttl(provider)) & ~is_stale(expires_at, now)


def filter_fresh(entries: DataFrame) -> DataFrame:
    """entries(provider, cached_at_s, expires_at, as_of_s): fresh rows, with ``refresh``
    telling whether a prepare must still ask the provider."""
    provider, now = F.col("provider"), F.col("as_of_s")
    fresh = is_fresh(provider, F.col("cached_at_s"), F.col("expires_at"), now)
    refresh = is_stale(F.col("expires_at"), now) | provider.isin(*rules.TRANSIENT_PROVIDERS)
    return entries.where(fresh).withColumn("refresh", refresh)


def trim_to_capacity(entries: DataFrame, cache: str, key: str, cached_at: str, expired: Column,
                     caps: dict[str, int] = rules.CACHE_CAPS) -> DataFrame:
    """Rows that stay: not expired and among the newest ``cap`` of their cache; caches without a cap keep all.

    Counts per minute, then per moment of one minute, find the moment in which the cap is reached. Newer rows stay
    whole, and only the rows of that moment are ranked. The edges are one row per capped cache.
    """
    live = entries.where(~expired)
    at, seconds = F.col(cached_at), F.col(cached_at)
    if entries.schema[cached_at].dataType.typeName().startswith("timestamp"):
        seconds = at.cast("timestamp")
    minute = F.floor(seconds.cast("double") / 60)
    cap = reduce(lambda acc, kv: acc.when(F.col(cache) == kv[0], kv[1]), caps.items(), F).cast("long")
    columns = [F.col(c) for c in entries.columns]
    free = live.where(F.coalesce(~F.col(cache).isin(*caps), F.lit(True))).select(*columns)
    capped = live.where(F.col(cache).isin(*caps)).withColumns({"_minute": minute, "_room": cap}).where("_room > 0")

    def edge(rows: DataFrame, by: str) -> DataFrame:
        """Per cache the value of ``by`` in which the room runs out, and the room left in it."""
        newer = Window.partitionBy(cache).orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(cache, "_room", by).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_left", F.col("_room") - F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        return counts.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_n"))).select(cache, by, F.col("_left").alias("_room"))

    last_minute = edge(capped, "_minute")
    inside = capped.drop("_room").join(F.broadcast(last_minute), [cache, "_minute"])
    moment = edge(inside, cached_at).select(F.col(cache).alias("_c"), at.alias("_at"), F.col("_room").alias("_most"))
    marked = capped.join(F.broadcast(moment), F.col(cache) == F.col("_c"), "left")
    newest = marked.where(F.col("_c").isNull() | (at > F.col("_at")))
    order = Window.partitionBy(cache).orderBy(F.col(key).desc())
    tied = marked.where(at == F.col("_at")).withColumn("_r", F.row_number().over(order)).where("_r <= _most")
    return free.unionByName(newest.select(*columns)).unionByName(tied.select(*columns))


def coalesce_requests(requests: DataFrame, gate: str, at: str, order: list[str], window: str = "10 minutes") -> DataFrame:
    """One resolution per gate key and window: the first request leads, the rest share it."""
    slot = F.window(at, window)
    return (requests.groupBy(gate, slot.alias("_w"))
            .agg(F.min(F.struct(*order)).alias("_lead"), F.count(F.lit(1)).alias("requests"))
            .select(gate, F.col("_w.start").alias("window_start"),
                    *[F.col(f"_lead.{c}").alias(c) for c in order], "requests"))


def tolerant_identity_join(wanted: DataFrame, stored: DataFrame, keys: list[str], exact: str = "content_length",
                           near: str = "duration_us", tolerance: int = rules.DURATION_TOLERANCE_US,
                           how: str = "inner") -> DataFrame:
    """Equi join on the identity keys; nullable members match when either is null.

    ``how``: ``inner``, ``left`` (every wanted row) or ``left_anti`` (wanted rows without any match).
    """
    right = stored.withColumnsRenamed({exact: "_e", near: "_n"})
    same = F.col(exact).isNull() | F.col("_e").isNull() | (F.col(exact) == F.col("_e"))
    close = F.col(near).isNull() | F.col("_n").isNull() | (F.abs(F.col(near) - F.col("_n")) <= tolerance)
    on = [wanted[k] == right[k] for k in keys] + [same, close]
    joined = wanted.join(right, on, how)
    return joined if how == "left_anti" else joined.drop(*[right[k] for k in keys], "_e", "_n")


def _length_prefixed(text: Column) -> Column:
    size = F.octet_length(text).cast("long")
    # little-endian bytes of the length
    digits = [F.lpad(F.hex(F.shiftright(size, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]
    return F.concat(F.unhex(F.concat(*digits)), F.encode(text, "UTF-8"))


def digest(provider: Column, key: Column) -> Column:
    return F.sha2(F.concat(_length_prefixed(provider), _length_prefixed(key)), 256)


def stable_digest(df: DataFrame, provider: str = "provider", key: str = "canonical_key") -> DataFrame:
    return df.withColumn("digest", digest(F.col(provider), F.col(key)))


def _unit(c: Column) -> Column:
    """Finite and within 0..1 (null counts as valid)."""
    return F.coalesce(~F.isnan(c) & (c >= 0) & (c <= 1), F.lit(True))


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(True))


def _profile_ok(values: Column, rate: Column, seconds: Column) -> Column:
    n, expected = F.size(values), seconds * rate
    filled = (rate <= 8) & (n > 0) & (n >= F.floor(expected)) & (n <= F.ceil(expected) + 1)
    return F.when(rate == 0, n == 0).otherwise(filled)


def validate_analyses(df: DataFrame) -> DataFrame:
    """Adds ``violation``: the first broken rule of an analysis record, null if valid."""
    c = F.col
    seconds = c("duration_us") / 1000000
    intro, outro = c("intro_end_us"), c("outro_start_us")

    def outside(x: Column) -> Column:
        return F.coalesce((x < c("audible_start_us")) | (x > c("audible_end_us")), F.lit(False))

    def absent_but_set(boundary: Column, confidence: Column) -> Column:
        return boundary.isNull() & (confidence != 0)

    rising = F.size(F.filter(c("markers"), lambda m, i: (i > 0) & (m <= F.get(c("markers"), i - 1)))) == 0
    # Rules in checking order with their messages.
    checks = (
        (c("duration_us") == 0, "duration must be greater than zero"),
        ((c("audible_start_us") > c("audible_end_us")) | (c("audible_end_us") > c("duration_us")),
         "audible boundaries must be ordered within the track duration"),
        (outside(intro) | outside(outro) | F.coalesce(intro >= outro, F.lit(False)),
         "structure boundaries must be ordered within the audible region"),
        (~_unit(c("intro_confidence")) | ~_unit(c("outro_confidence"))
         | absent_but_set(intro, c("intro_confidence")) | absent_but_set(outro, c("outro_confidence")),
         "structure confidences must match boundaries and be between zero and one"),
        (~_profile_ok(c("vocal"), c("vocal_rate"), seconds) | (F.size("vocal") != F.size("vocal_conf")),
         "vocal activity profile must have a valid rate, length, and confidence shape"),
        (~_profile_ok(c("energy"), c("energy_rate"), seconds), "energy profile must have a valid rate and length"),
        (~_finite(c("bpm")) | F.coalesce(c("bpm") <= 0, F.lit(False)), "BPM must be finite and greater than zero"),
        (~_unit(c("beat_confidence")), "beat confidence must be between zero and one"),
        (~_unit(c("downbeat_confidence")), "downbeat confidence must be between zero and one"),
        (c("first_beat_us") > c("duration_us"), "first beat must be within the track duration"),
        (F.exists("markers", lambda m: m > c("duration_us")) | ~rising,
         "beat markers must be ordered within the track duration"),
        ((F.size("marker_conf") > 0)
         & ((F.size("marker_conf") != F.size("markers")) | F.exists("marker_conf", lambda x: ~_unit(x))),
         "beat marker confidences must match markers and be between zero and one"),
        (c("first_downbeat_us") > c("duration_us"), "first downbeat must be within the track duration"),
        ((c("key_tonic") >= 12) | ~_unit(c("key_confidence")), "musical key must have a valid tonic and confidence"),
        (~_finite(c("rms_dbfs")) | ~_finite(c("peak_dbfs")), "level measurements must be finite"),
    )
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks])
    return df.withColumn("violation", first)


def missing_analysis_worklist(queue: DataFrame, tracks: DataFrame, stored: DataFrame, in_flight: DataFrame,
                              lookahead: int = rules.ANALYSIS_LOOKAHEAD) -> DataFrame:
    """queue(listener, pos, track), tracks(track, kind), stored(track), in_flight(listener, track)
    to rows ``analyse`` (relevant, HTTP, not stored, not running) and ``cancel`` (running, no longer relevant)."""
    order = Window.partitionBy("listener").orderBy("pos")
    relevant = (queue.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= lookahead + 1)
                .select("listener", "track").distinct())
    start = (relevant.join(tracks.where(F.col("kind") == "http").select("track"), "track", "left_semi")
             .join(stored, "track", "left_anti").join(in_flight, ["listener", "track"], "left_anti"))
    cancel = in_flight.join(relevant, ["listener", "track"], "left_anti")
    return (start.select("listener", "track", F.lit("analyse").alias("action"))
            .unionByName(cancel.select("listener", "track", F.lit("cancel").alias("action"))))


def merge_refreshed_records(stored: DataFrame, refreshed: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Refreshed title and source win; missing thumbnail and duration keep the old value;
    author, uri and requested URL stay. Unmatched rows are marked ``resolve_again``."""
    new = refreshed.select(key, F.lit(True).alias("_new"), *[
        F.col(c).alias(f"_{c}") for c in ("title", "source_url", "thumbnail", "duration_us")])
    joined = stored.join(new, key, "left")
    hit = F.col("_new").isNotNull()
    return joined.select(
        key, "requested_url", "author", "uri",
        F.when(hit, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(hit, F.col("_source_url")).otherwise(F.col("source_url")).alias("source_url"),
        F.when(hit, F.coalesce("_thumbnail", "thumbnail")).otherwise(F.col("thumbnail")).alias("thumbnail"),
        F.when(hit, F.coalesce("_duration_us", "duration_us")).otherwise(F.col("duration_us")).alias("duration_us"),
        F.when(hit, "refreshed").otherwise("resolve_again").alias("action"))
