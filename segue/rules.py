"""Provider host policies, word lists and limits.

They must equal the published behaviour for results to match; every operator
takes them as arguments with these defaults.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HostPolicy:
    """Hosts of one provider and scope: exact names and allowed endings."""

    provider: str
    scope: str  # "track" or "playback"
    exact: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


# Allowed hosts per provider and scope.
HOST_POLICIES: tuple[HostPolicy, ...] = (
    HostPolicy("youtube", "track",
               ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")),
    HostPolicy("youtube", "playback",
               ("googlevideo.com", "manifest.googlevideo.com", "youtube.com", "www.youtube.com", "music.youtube.com"),
               (".googlevideo.com", ".youtube.com")),
    HostPolicy("soundcloud", "track",
               ("soundcloud.com", "www.soundcloud.com", "m.soundcloud.com", "on.soundcloud.com")),
    HostPolicy("soundcloud", "playback", ("sndcdn.com",), (".sndcdn.com",)),
    HostPolicy("x", "track",
               ("twitter.com", "www.twitter.com", "mobile.twitter.com", "x.com", "www.x.com", "mobile.x.com")),
    HostPolicy("x", "playback", ("video.twimg.com",), (".video.twimg.com",)),
    HostPolicy("niconico", "track", ("nicovideo.jp", "www.nicovideo.jp", "nico.ms")),
    HostPolicy("niconico", "playback",
               ("nicovideo.jp", "www.nicovideo.jp", "delivery.domand.nicovideo.jp", "api.dmc.nico"),
               (".nicovideo.jp", ".domand.nicovideo.jp", ".dmc.nico", ".nimg.jp")),
    HostPolicy("bandcamp", "track", ("bandcamp.com",), (".bandcamp.com",)),
    HostPolicy("bandcamp", "playback", ("bcbits.com",), (".bcbits.com",)),
    HostPolicy("vimeo", "track", ("vimeo.com", "www.vimeo.com", "player.vimeo.com")),
    HostPolicy("vimeo", "playback",
               ("player.vimeo.com", "vod-progressive.akamaized.net", "vod-adaptive.akamaized.net"),
               (".vimeocdn.com",)),
    HostPolicy("twitch", "track", ("twitch.tv", "www.twitch.tv", "m.twitch.tv")),
    HostPolicy("twitch", "playback", ("usher.ttvnw.net",), (".ttvnw.net",)),
)

# Order in which providers are tried.
PROVIDER_ORDER = ("youtube", "soundcloud", "bandcamp", "niconico", "vimeo", "twitch", "x")

# Path words that are not channel names.
RESERVED_CHANNELS = (
    "activate", "bits", "bits-checkout", "directory", "downloads", "following", "jobs", "login", "logout",
    "manager", "messages", "p", "payments", "popout", "prime", "search", "settings", "signup", "store", "subs",
    "subscriptions", "turbo", "user", "videos", "wallet",
)

# Header names that may cross hosts / survive sanitising.
CROSS_HOST_HEADERS = ("accept", "accept-language", "origin", "referer", "user-agent")
MAX_HEADERS = 8
MAX_HEADER_VALUE_BYTES = 1024

# Providers whose prepared sources are short-lived.
TRANSIENT_PROVIDERS = ("soundcloud", "niconico", "x")
METADATA_TTL_S = 30 * 60
PREPARED_TTL_S = 5 * 60
TRANSIENT_TTL_S = 90
REFRESH_SKEW_S = 60
CACHE_CAPS = {"metadata": 4096, "prepared": 4096, "alias": 12288}

# Sizes and limits.
RANGE_CHUNK_BYTES = 11_862_014
MAX_REDIRECTS = 5
MAX_MEDIA_BYTES = 64 * 1024 * 1024
MAX_KEY_BYTES = 1024
SEGMENT_MEMORY = 512
MAX_STALLS = 12
MIN_RELOAD_US, MAX_RELOAD_US = 500_000, 15_000_000
ANALYSIS_SCHEMA_VERSION = 8
MAX_STORED_BYTES = 256 * 1024
DURATION_TOLERANCE_US = 1_000_000
MAX_QUEUE, MAX_PENDING = 512, 64
ANALYSIS_LOOKAHEAD = 4
PREVIEW_LIMIT = 10
FIELD_BYTES, TITLE_CHARS = 1024, 180
