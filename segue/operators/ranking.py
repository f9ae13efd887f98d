"""Ranked choice per group.

Every choice has a total order (score, then row position), so it is a map-side
combinable ``max_by``/``min_by`` rather than a sort of the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions.ordered import Shifted, scan, top_by


def rank_transcodings(df: DataFrame, group: str, position: list[str], payload: list[str]) -> DataFrame:
    """Best mp3 transcoding; among equals the later row."""
    mime, protocol = F.col("mime_type"), F.col("protocol")
    kept = df.where(mime.contains("audio/mpeg") & protocol.isin("progressive", "hls"))
    # Score parts by protocol, mime type and quality/preset.
    s_protocol = F.when(protocol == "progressive", 2).when(protocol == "hls", 1).otherwise(0)
    s_mime = F.when(mime.contains("mpegurl"), 1).when(mime.contains("audio/mpeg"), 2).otherwise(0)
    s_quality = (F.coalesce(F.col("quality") == "sq", F.lit(False)).cast("int")
                 + F.coalesce(F.col("preset").contains("abr"), F.lit(False)).cast("int"))
    scored = kept.select("*", s_protocol.alias("protocol_score"), s_mime.alias("mime_score"),
                         s_quality.alias("quality_score"))
    rank = F.struct("protocol_score", "mime_score", "quality_score", *position)
    return top_by(scored, [group], rank, [*payload, "protocol_score", "mime_score", "quality_score"])


def pick_video_variant(df: DataFrame, group: str, position: list[str], payload: list[str]) -> DataFrame:
    """First HLS by bitrate, else first mp4, else first; among equals the earlier row."""
    kind = (F.when(F.col("content_type") == "application/x-mpegURL", 0)
            .when(F.col("content_type") == "video/mp4", 1).otherwise(2))
    rank = F.struct(kind.alias("k"), (-F.coalesce(F.col("bitrate"), F.lit(0))).alias("b"), *position)
    usable = df.where(F.col("content_type").isNotNull() & F.col("url").isNotNull())
    return top_by(usable, [group], rank, payload, largest=False)


def pick_smallest_progressive(df: DataFrame, group: str, position: list[str], payload: list[str]) -> DataFrame:
    area = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0))
    return top_by(df.where(F.col("url").isNotNull()), [group], F.struct(area.alias("a"), *position),
                  [*payload, area.alias("area")], largest=False)


def stream_class(codecs: Column, has_video_attr: Column, has_audio_group: Column) -> Column:
    """0 audio codec only, 1 audio group only, 2 neither, 3 video."""
    text = F.lower(F.coalesce(codecs, F.lit("")))
    # Codec names that mean video and audio.
    video = has_video_attr | text.rlike("avc1|hvc1|hev1|av01|vp9")
    audio = text.rlike("mp4a|opus|ac-3|ec-3")
    return F.when(video, 3).when(audio, 0).when(has_audio_group, 1).otherwise(2)


def select_stream_variant(df: DataFrame, group: str, position: list[str], payload: list[str]) -> DataFrame:
    """Lowest class, then lowest (average) bandwidth, then first; i-frame rows are out."""
    cls = stream_class(F.col("codecs"), F.col("has_video"), F.col("has_audio_group"))
    bandwidth = F.coalesce(F.col("average_bandwidth"), F.col("bandwidth"))
    rank = F.struct(cls.alias("c"), bandwidth.alias("b"), *position)
    return top_by(df.where(~F.col("is_iframe")), [group], rank,
                  [*payload, cls.alias("stream_class"), bandwidth.alias("used_bandwidth")], largest=False)


def line_attribute(line: Column, name: str) -> Column:
    """Double-quoted attribute of a playlist tag; null if absent or unclosed."""
    found = F.regexp_extract_all(line, F.lit(name + '="([^"]*)"'), F.lit(1))
    return F.get(found, F.lit(0))


def select_audio_rendition(df: DataFrame, group: str, position: list[str], line: str = "line") -> DataFrame:
    """Highest bitrate named in the URI; among equals the last row."""
    uri = line_attribute(F.col(line), "URI")
    digits = F.regexp_extract(uri, "audio-aac-([0-9]*)", 1)
    # a number that does not fit 32 bits counts as zero
    value = F.coalesce(digits.try_cast("long"), F.lit(0))
    bitrate = F.when(value <= 4294967295, value).otherwise(F.lit(0))
    kept = df.where(F.col(line).startswith("#EXT-X-MEDIA:TYPE=AUDIO") & uri.isNotNull())
    return top_by(kept, [group], F.struct(bitrate.alias("b"), *position), [bitrate.alias("bitrate"), uri.alias("uri")])


def score_audio_rendition(df: DataFrame, group: str, position: list[str], line: str = "line") -> DataFrame:
    """DEFAULT=YES counts 1, a "high" group counts 2; among equals the last row."""
    text = F.col(line)
    uri = line_attribute(text, "URI")
    score = (F.coalesce(line_attribute(text, "DEFAULT") == "YES", F.lit(False)).cast("int")
             + 2 * F.coalesce(F.lower(line_attribute(text, "GROUP-ID")).contains("high"), F.lit(False)).cast("int"))
    kept = df.where(text.startswith("#EXT-X-MEDIA:") & text.contains("TYPE=AUDIO") & uri.isNotNull())
    return top_by(kept, [group], F.struct(score.alias("s"), *position), [score.alias("score"), uri.alias("uri")])


def first_audio_only_stream(df: DataFrame, group: str, chunk: list[str], position: list[str],
                            line: str = "line") -> DataFrame:
    """URI after the first audio-only STREAM-INF line whose next line is not a tag."""
    lines = df.withColumn(line, F.trim(line)).where(F.col(line) != "")
    paired = scan(lines, [group], chunk, position, next_line=Shifted(F.col(line), 1))
    text = F.col(line)
    # Markers of an audio-only stream.
    audio = text.contains('VIDEO="audio_only"') | (
        text.contains('CODECS="mp4a.') & ~text.rlike("avc1|hvc1|hev1|av01"))
    hit = paired.where(text.startswith("#EXT-X-STREAM-INF:") & audio
                       & F.col("next_line").isNotNull() & ~F.col("next_line").startswith("#"))
    return top_by(hit, [group], F.struct(*position), [F.col("next_line").alias("uri")], largest=False)


def top_quality_pairs(df: DataFrame, group: str, position: list[str], videos: int = 2, audios: int = 3) -> DataFrame:
    """Best available qualities of both kinds, paired; an empty side is an error row."""
    level = F.coalesce(F.col("level"), F.lit(0))
    usable = df.where(F.coalesce(F.col("available"), F.lit(False)) & F.col("id").isNotNull())

    def best(kind: str, limit: int) -> DataFrame:
        # ``row_number() <= k`` is cut per partition before the shuffle
        order = Window.partitionBy(group).orderBy(level.desc(), *position)
        side = usable.where(F.col("kind") == kind).withColumn("r", F.row_number().over(order))
        return side.where(F.col("r") <= limit).select(
            group, F.col("r").alias(f"{kind}_rank"), F.col("id").alias(f"{kind}_id"))

    pairs = best("video", videos).join(best("audio", audios), group, "full_outer")
    empty = F.col("video_id").isNull() | F.col("audio_id").isNull()
    return pairs.withColumn("error", F.when(empty, F.lit("no playable quality pair")))


def resolve_default_cdn(df: DataFrame, config: str = "config") -> DataFrame:
    """URL of the named default entry: ``url``, else ``avc_url``."""
    doc = F.from_json(config, "struct<default_cdn string, cdns map<string, struct<url string, avc_url string>>>")
    entry = F.try_element_at(doc["cdns"], doc["default_cdn"])
    return df.withColumn("master_url", F.coalesce(entry["url"], entry["avc_url"])).drop(config)


def first_success_or_last_error(df: DataFrame, group: str, priority: str, ok: str = "ok",
                                result: str = "result") -> DataFrame:
    won, lost = F.col(ok), ~F.col(ok)
    return (df.groupBy(group)
            .agg(F.min_by(F.col(result), F.when(won, F.col(priority))).alias("_win"),
                 F.bool_or(won).alias("resolved"),
                 F.max_by(F.col(result), F.when(lost, F.col(priority))).alias("_err"))
            .select(group, "resolved", F.when(F.col("resolved"), F.col("_win")).otherwise(F.col("_err"))
                    .alias(result)))
