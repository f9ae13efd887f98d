"""URL column functions (JVM-side regular expressions, lower-cased hosts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue.rules import HOST_POLICIES, HostPolicy

# groups: 1 scheme, 2 host, 3 path, 4 query; a backslash ends the authority like a slash, ports end at 65535
PORT_PATTERN = r"0*(?:[1-5]?[0-9]{1,4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?"
URL_PATTERN = (
    r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/\\?#\s]*@)?"
    r"(\[[0-9A-Fa-f:.]+\]|[^\s/?#:@\[\]<>^|%\\]+)(?::" + PORT_PATTERN + r")?"
    r"([/\\][^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
)
IPV4_PATTERN = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(_part(url, 1), F.lit("")))


def host(url: Column) -> Column:
    """Lower-cased host, null if the URL does not parse."""
    return F.lower(F.nullif(_part(url, 2), F.lit("")))


def path(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.coalesce(F.nullif(F.translate(_part(url, 3), "\\", "/"), F.lit("")), F.lit("/")))


def query(url: Column) -> Column:
    return _part(url, 4)


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def named_host(url: Column) -> Column:
    """Host usable in a policy: not ``localhost`` and not an IP address."""
    h = host(url)
    return F.when((h != "localhost") & ~h.rlike(IPV4_PATTERN), h)


def matches(host_col: Column, exact, suffixes) -> Column:
    hit = host_col.isin(*exact) if exact else F.lit(False)
    for suffix in suffixes:
        hit = hit | host_col.endswith(suffix)
    return hit


def policy_allows(url: Column, scope: str, policies: tuple[HostPolicy, ...] = HOST_POLICIES) -> Column:
    """True if https and the host is allowed by ANY provider in ``scope``."""
    h = named_host(url)
    chosen = [p for p in policies if p.scope == scope]
    exact = sorted({e for p in chosen for e in p.exact})
    suffixes = sorted({s for p in chosen for s in p.suffixes})
    return F.coalesce((scheme(url) == "https") & matches(h, exact, suffixes), F.lit(False))


def provider_allows(provider: Column, url: Column, scope: str = "playback",
                    policies: tuple[HostPolicy, ...] = HOST_POLICIES) -> Column:
    """True if https and the host is allowed for the row's own provider."""
    h = named_host(url)
    hit = F.lit(False)
    for p in policies:
        if p.scope == scope:
            hit = F.when(provider == p.provider, matches(h, p.exact, p.suffixes)).otherwise(hit)
    return F.coalesce((scheme(url) == "https") & hit, F.lit(False))


def same_host(left: Column, right: Column) -> Column:
    return F.coalesce(named_host(left) == named_host(right), F.lit(False))


def summary(url: Column) -> Column:
    """``scheme://host/`` or ``scheme://host/[redacted]``; null if unparseable."""
    tail = F.when(path(url) == "/", F.lit("/")).otherwise(F.lit("/[redacted]"))
    return F.concat(scheme(url), F.lit("://"), host(url), tail)


def redact(text: Column) -> Column:
    """Replace every http(s) token of free text by its summary."""
    # a URL runs to the next blank, so blank-free tokens can be treated alone
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\S+|\s+"), F.lit(0))

    def one(token: Column) -> Column:
        start = F.least(F.nullif(F.instr(token, "http://"), F.lit(0)), F.nullif(F.instr(token, "https://"), F.lit(0)))
        url = F.substring(token, start, F.length(token))
        body = F.regexp_replace(url, r"[)\]},;]+$", "")
        suffix = F.substring(url, F.length(body) + 1, F.length(url))
        return F.coalesce(F.concat(F.substring(token, F.lit(1), start - 1), summary(body), suffix), token)

    return F.array_join(F.transform(tokens, one), "")


def query_value(url: Column, key: str) -> Column:
    """First value of a query parameter, null if absent."""
    pairs = F.filter(F.split(query(url), "&"), lambda kv: F.substring_index(kv, "=", 1) == key)
    first = F.get(pairs, F.lit(0))
    return F.when(first.contains("="), F.substring(first, len(key) + 2, 1 << 30)).when(first.isNotNull(), F.lit(""))


def unsigned(text: Column) -> Column:
    """Decimal digits (optional plus sign) as a long; null otherwise or on overflow."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))
