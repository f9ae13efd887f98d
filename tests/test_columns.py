"""Literal cases of the URL, page, ranking, playlist and freshness jobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from segue.functions import html as H
from segue.functions import urls as U
from segue.operators import freshness, manifests, pages, ranking, urls


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_url_policy(spark):
    cases = [("https://www.youtube.com/watch?v=1", True), ("http://www.youtube.com/", False), ("https://evil.example.com/", False),
             ("https://artist.bandcamp.com/track/x", True), ("https://127.0.0.1/", False), ("https://localhost/", False),
             ("https://WWW.YouTube.com:443/", True), ("https://notbandcamp.com/", False), ("nonsense", False)]
    df = spark.createDataFrame(cases, "url string, want boolean").withColumn("got", U.policy_allows(F.col("url"), "track"))
    assert df.where("got <> want").count() == 0
    targets = [("youtube", "https://r1.googlevideo.com/x", True), ("soundcloud", "https://r1.googlevideo.com/x", False),
               ("vimeo", "https://a.vimeocdn.com/x", True), ("nobody", "https://a.vimeocdn.com/x", False)]
    df = urls.validate_playback_targets(spark.createDataFrame(targets, "provider string, url string, want boolean"))
    assert df.where("allowed <> want").count() == 0
    assert df.where("provider = 'soundcloud'").first().violation == "unsafe target for soundcloud: https://r1.googlevideo.com/[redacted]"


def test_redaction_keeps_text_and_drops_secrets(spark):
    got = one(spark, "req url=https://u:p@A.example.com:8/v?sig=1), x http:// y https://b.example.com/ z\n", U.redact)
    assert got == "req url=https://a.example.com/[redacted]), x http:// y https://b.example.com/ z\n"
    long = "word " * 20000 + "https://c.example.com/s"
    assert one(spark, long, U.redact).endswith("https://c.example.com/[redacted]")


def test_routing_and_keys(spark):
    cases = [("https://youtu.be/x", "youtube"), ("https://a.bandcamp.com/track/y", "bandcamp"), ("https://a.bandcamp.com/album/y", "unsupported"),
             ("https://vimeo.com/76979871", "vimeo"), ("https://www.twitch.tv/videos/12", "twitch"), ("https://www.twitch.tv/directory", "unsupported"),
             ("https://x.com/u/status/9", "x"), ("https://nico.ms/sm9", "niconico")]
    df = urls.route_provider(spark.createDataFrame(cases, "url string, want string"))
    assert df.where("provider <> want").count() == 0
    rows = [("https://vimeo.com/76979871/abcdef12",), ("https://player.vimeo.com/video/5?h=zz",), ("https://twitch.tv/SomeOne",)]
    got = urls.canonicalize_targets(spark.createDataFrame(rows, "url string")).collect()
    assert (got[0].vimeo_key, got[0].vimeo_hash) == ("vimeo:video:76979871", "abcdef12")
    assert (got[1].vimeo_key, got[1].vimeo_hash) == ("vimeo:video:5", "zz")
    assert got[2].twitch_key == "twitch:channel:someone"


def test_attribute_and_entities(spark):
    assert one(spark, "<script class='p' data-tralbum = '{&quot;id&quot;:1}'>", lambda c: H.attribute(c, "data-tralbum")) == "{&quot;id&quot;:1}"
    assert one(spark, "<a x-name='no' name=\"open", lambda c: H.attribute(c, "name")) is None
    assert one(spark, '<meta content="payload" name="server-response">', lambda c: H.meta_content(c, "name", "server-response")) == "payload"
    assert one(spark, "<script defer type='application/ld+json'>{\"a\":1}</script>", lambda c: H.script_body(c, pages.LD_JSON)) == '{"a":1}'
    assert one(spark, "&amp;lt; &amp;quot;", H.decode_entities) == "< &quot;"


def test_titles_and_durations(spark):
    df = spark.createDataFrame([("a https://t.co/x \n\n  b ", 3_661_000_000), ("https://t.co/x", None)], "text string, duration_us long")
    got = urls.normalize_titles(df.withColumn("url", F.lit("u"))).collect()
    assert [(r.title, r.duration) for r in got] == [("a b", "61m 01s"), ("u", "--m --s")]


def test_choice_ties(spark):
    rows = [(1, p, "progressive", "audio/mpeg", "sq", None) for p in (0, 1)] + [(1, 2, "dash", "audio/mpeg", "sq", None)]
    df = spark.createDataFrame(rows, "a int, pos int, protocol string, mime_type string, quality string, preset string")
    assert ranking.rank_transcodings(df, "a", ["pos"], ["pos"]).first().pos == 1  # later row
    rows = [(1, 0, "video/mp4", 5, "u"), (1, 1, "video/mp4", 5, "v"), (1, 2, "other", 9, "w")]
    df = spark.createDataFrame(rows, "a int, pos int, content_type string, bitrate int, url string")
    assert ranking.pick_video_variant(df, "a", ["pos"], ["url"]).first().url == "u"  # earlier row
    lines = [(1, 0, '#EXT-X-STREAM-INF:VIDEO="audio_only"'), (1, 1, "#EXTINF"), (1, 2, '#EXT-X-STREAM-INF:CODECS="mp4a.40.2"'), (1, 3, "b.m3u8")]
    df = spark.createDataFrame(lines, "a int, pos int, line string").withColumn("c", F.expr("pos div 2"))
    assert ranking.first_audio_only_stream(df, "a", ["c"], ["pos"]).first().uri == "b.m3u8"


def test_playlist_keys_follow_their_line(spark):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXT-X-MAP:URI=\"i.mp4\"\ns0.ts\n#EXT-X-KEY:METHOD=AES-128,URI=\"../k\"\ns1.ts\ns2.ts\n"
    df = spark.createDataFrame([(1, text)], "playlist int, text string")
    lines = manifests.playlist_lines(df).withColumn("base_url", F.lit("https://h.example.com/a/b/list.m3u8")).withColumn("part", F.expr("line_no div 2"))
    got = manifests.explode_media_playlist(lines, "playlist", ["part"]).orderBy("line_no").collect()
    assert [(r.kind, r.url, r.key_url, r.iv) for r in got] == [
        ("map", "https://h.example.com/a/b/i.mp4", None, None), ("segment", "https://h.example.com/a/b/s0.ts", None, None),
        ("segment", "https://h.example.com/a/b/s1.ts", "https://h.example.com/a/k", "0" * 31 + "8"),
        ("segment", "https://h.example.com/a/b/s2.ts", "https://h.example.com/a/k", "0" * 31 + "8")]


def test_digest_matches_hashlib(spark):
    df = spark.createDataFrame([("youtube", "kéy")], "provider string, canonical_key string")
    parts = b"".join(len(b).to_bytes(8, "little") + b for b in ("youtube".encode(), "kéy".encode()))
    assert freshness.stable_digest(df).first().digest == hashlib.sha256(parts).hexdigest()


def test_tolerant_join(spark):
    want = spark.createDataFrame([("a", 1, 5_000_000), ("b", None, None), ("c", 2, 1)], "k string, content_length long, duration_us long")
    have = spark.createDataFrame([("a", 1, 6_000_000), ("b", 9, 9), ("c", 3, 1)], "k string, content_length long, duration_us long")
    assert {r.k for r in freshness.tolerant_identity_join(want, have, ["k"]).collect()} == {"a", "b"}
    assert [r.k for r in freshness.tolerant_identity_join(want, have, ["k"], how="left_anti").collect()] == ["c"]
