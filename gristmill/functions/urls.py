"""URL column functions. Every parse is a ``try_`` form, so a bad address never fails a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import col_of, jstrim

# Tracking parameters removed from story addresses.
TRACKING_PARAMS = [
    "traffic_source", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "at_medium", "at_campaign", "xrs", "ocid",
]
# Paths that hold video, live pages, galleries or audio instead of an article.
THIN_URL_RE = r"(?i)/(video|videos|liveblog|live|live-news|live-blog|gallery|podcast|podcasts|watch)/"
# Hosts whose articles are always behind a paywall, and phrases that give one away.
PAYWALL_HOST_RE = r"(^|\.)(wsj\.com|ft\.com|bloomberg\.com|economist\.com|barrons\.com)$"
PAYWALL_TEXT_RE = (
    r"(?i)(subscribe to (continue|read)|already a subscriber|sign in to (continue|read)"
    r"|create a free account to (continue|read)|to continue reading)"
)
# Catalog image rules.
IMAGE_EXT_RE = r"(?i)\.(jpe?g|png|webp|gif|avif|svg|bmp|tiff?)(\?|#|$)"
PRIVATE_HOST_RE = (
    r"(?i)(localhost|127\.0\.0\.1|0\.0\.0\.0|192\.168\.|10\.\d+\.|172\.(1[6-9]|2\d|3[01])\."
    r"|\.local\b|\.internal\b|\.lan\b|\.test\b)"
)


def encoded(u) -> Column:
    """Spaces percent-encoded, as a browser does before parsing."""
    return F.replace(jstrim(u), F.lit(" "), F.lit("%20"))


def url_part(u, part: str) -> Column:
    return F.try_parse_url(encoded(u), F.lit(part))


def url_parses(u) -> Column:
    """A scheme is required; http(s) addresses also need a host."""
    scheme = url_part(u, "PROTOCOL")
    return scheme.isNotNull() & (~F.lower(scheme).isin("http", "https") | url_part(u, "HOST").isNotNull())


def host_of(u) -> Column:
    """Host in lower case without a leading ``www.``; empty text when the address does not parse."""
    h = F.coalesce(url_part(u, "HOST"), F.lit(""))
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def root_host(h) -> Column:
    """Last two labels of a host."""
    return F.substring_index(col_of(h), ".", -2)


def clean_url(u) -> Column:
    """Address without tracking parameters; other parameters keep their order."""
    u = F.coalesce(col_of(u), F.lit(""))
    base = F.substring_index(u, "#", 1)
    frag = F.substring(u, F.length(base) + 1, F.length(u))
    path = F.substring_index(base, "?", 1)
    query = F.substring(base, F.length(path) + 2, F.length(base))
    drop = F.array(*[F.lit(k) for k in TRACKING_PARAMS])
    kept = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~F.array_contains(drop, F.substring_index(p, "=", 1)),
    )
    cleaned = F.concat(
        path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), frag
    )
    return F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), cleaned).otherwise(u)


def is_thin_url(u) -> Column:
    return F.coalesce(col_of(u), F.lit("")).rlike(THIN_URL_RE)


def is_paywalled(u, text=None) -> Column:
    """Known paywall host, or a short text that asks for a subscription."""
    by_host = F.lower(F.coalesce(url_part(u, "HOST"), F.lit(""))).rlike(PAYWALL_HOST_RE)
    if text is None:
        return by_host
    t = F.coalesce(col_of(text), F.lit(""))
    return by_host | ((F.length(t) < 1500) & t.rlike(PAYWALL_TEXT_RE))


def wrapped_target(u, param: str = "url") -> Column:
    """The publisher address that an aggregator link carries in a query parameter, else null."""
    inner = F.try_url_decode(F.try_parse_url(encoded(u), F.lit("QUERY"), F.lit(param)))
    return F.when(inner.rlike(r"(?i)^https?://"), inner)
