"""URL rules: normalisation, extraction, identifiers and handles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import parse_qs, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "ref", "source", "xtor", "wtmc"]
REDIRECT_TRACKING = ["rct", "sa", "ct", "cd", "ved", "usg"]
# Addresses that are not articles.
NOT_ARTICLES = [r"/login", r"/signin", r"/auth", r"/account", r"/register", r"\.(jpg|jpeg|png|gif|pdf|mp4|mp3|webp)(\?|$)", r"twitter\.com/intent", r"x\.com/intent", r"youtube\.com/watch", r"youtu\.be/", r"instagram\.com/p/", r"facebook\.com/share", r"/datenschutz", r"/impressum", r"/agb"]
NOT_EXTERNAL = [r"/login", r"/signin", r"/auth", r"\.(jpg|jpeg|png|gif|mp4|mp3)(\?|$)", r"youtube\.com/watch", r"youtu\.be/"]
OWN_HOSTS = ["x.com", "twitter.com", "pic.twitter.com"]
# Names shown for connector types.
DISPLAY = {"rss": "RSS Feed", "x_scraper": "X.com", "mastodon": "Mastodon", "bluesky": "Bluesky", "instagram_scraper": "Instagram", "instagram": "Instagram", "telegram": "Telegram", "html": "Website", "pdf": "PDF", "google_alerts": "Google Alerts", "twitter": "Twitter", "linkedin": "LinkedIn"}


def _normal(url: str | None) -> str | None:
    if url is None:
        return None
    try:
        parts = urlsplit(unquote(url))
    except ValueError:
        return url
    host = parts.netloc.lower()
    drop = set(TRACKING) | set(REDIRECT_TRACKING)
    kept = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k.lower() not in drop}
    path = parts.path.rpartition("/")
    path = (path[0] + path[1] + path[2].partition(";")[0]).rstrip("/") or "/"
    front = f"{parts.scheme}://{host[4:] if host.startswith('www.') else host}" if host else (f"{parts.scheme}:" if parts.scheme else "")
    return front + (path if not host or path.startswith("/") else "/" + path) + ("?" + urlencode(kept, doseq=True) if kept else "")


@F.pandas_udf(StringType())
def normalize_url_exact(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Percent signs decoded first, then host, tracking parameters, trailing slash, parameters and fragment cleaned."""
    for s in urls:
        yield s.map(_normal)


def normalize_url(url: Column) -> Column:
    """The same for addresses without percent signs, plus signs and repeated keys, in built-in functions."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r";[^/]*$", ""), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    drop = TRACKING + REDIRECT_TRACKING
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(drop))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def domain(url: Column) -> Column:
    return F.replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def redirect_target(url: Column) -> Column:
    """The address inside a search engine's redirect, decoded; other addresses as they are."""
    inner = F.regexp_extract(url, r"[?&]url=([^&#]*)", 1)
    return F.when((F.contains(url, F.lit("google.com/url")) | F.contains(url, F.lit("google.de/url"))) & (inner != ""), F.try_url_decode(inner)).otherwise(url)


def clean_url(url: Column) -> Column:
    """Tracking parameters and blank values out; everything else stays."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: F.rlike(p, F.lit("^[^=]+=.")) & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(TRACKING))
    text = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(query == "", url).otherwise(F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), text, F.regexp_extract(url, r"(#.*)$", 1)))


def _any(url: Column, patterns: list[str]) -> Column:
    return F.rlike(url, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


# Breaks inside of addresses that are closed, what an address is in a text, and marks that end it.
BROKEN_SCHEME, BROKEN_PATH = r"(?U)https?://\s+", r"(?U)([/\w.-])\s+([/\w.-])"
ADDRESS, END_MARKS = r"""(?U)(https?://[^\s<>"'{}|\\^`\[\]]+)""", r"""[.,;:!?)"'\]]+$"""


def extract_urls(text: Column) -> Column:
    """Addresses in a text, spaces inside them repaired, marks at their end cut, own hosts and non-articles dropped."""
    text = F.regexp_replace(F.regexp_replace(text, BROKEN_SCHEME, "https://"), BROKEN_PATH, "$1$2")
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(1)), lambda u: F.regexp_replace(u, END_MARKS, ""))
    host = lambda u: F.lower(F.regexp_extract(u, "^https?://([^/?#]*)", 1))
    return F.filter(found, lambda u: ~host(u).isin(OWN_HOSTS) & ~_any(u, NOT_ARTICLES))


def is_external_article(url: Column) -> Column:
    own = F.lit(False)
    for host in [*OWN_HOSTS, "pbs.twimg.com"]:
        own = own | F.contains(url, F.lit(host))
    web = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.coalesce(url != "", F.lit(False)) & ~own & (F.contains(url, F.lit("t.co/")) | (~_any(url, NOT_EXTERNAL) & web))


def identifier(connector: Column, config: Column) -> Column:
    """What names a channel within its connector, lower-cased."""
    key = lambda k: F.lower(F.coalesce(F.try_element_at(config, F.lit(k)), F.lit("")))
    profile = key("profile_url")
    slug = lambda part: F.nullif(F.regexp_extract(profile, f"/{part}/([^/]+)", 1), F.lit(""))
    linkedin = F.when(F.contains(profile, F.lit("/company/")), slug("company")).when(F.contains(profile, F.lit("/in/")), slug("in")).otherwise(F.nullif(profile, F.lit("")))
    return (
        F.when(connector.isin("x_scraper", "twitter", "instagram", "instagram_scraper"), key("username"))
        .when(connector.isin("mastodon", "bluesky"), key("handle"))
        .when(connector.isin("rss", "html", "pdf", "google_alerts"), key("url"))
        .when(connector == "telegram", key("channel"))
        .when(connector == "linkedin", linkedin)
    )


def display_name(name: Column, connector: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in DISPLAY.items() for x in pair))
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.coalesce(F.try_element_at(names, connector), connector))


def telegram_channel(value: Column) -> Column:
    last = F.when(F.contains(value, F.lit("t.me/")), F.element_at(F.split(value, "t\\.me/"), -1)).otherwise(value)
    return F.regexp_replace(F.element_at(F.split(last, "/"), 1), "^@+", "")


def fediverse_handle(handle: Column) -> Column:
    """struct user, instance of a user@instance handle."""
    bare = F.split(F.regexp_replace(handle, "^@+", ""), "@")
    return F.struct(F.element_at(bare, 1).alias("user"), F.try_element_at(bare, F.lit(2)).alias("instance"))


def client_ip(forwarded: Column, peer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)


def valid_pattern(pattern: str) -> bool:
    """Whether a rule's regular expression may be used; checked once when rules are loaded."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
