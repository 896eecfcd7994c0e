"""Expressions over URLs: owner links, handles, link classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Owner link patterns in the order they are tried.
OWNER_PATTERNS = [
    ("handle", r"@([^/?]+)"),
    ("channelId", r"/channel/(UC[a-zA-Z0-9_-]{22})"),
    ("customUrl", r"/c/([^/?]+)"),
    ("user", r"/user/([^/?]+)"),
]
# Lookup cost per link type; a custom link that needs a search costs more.
LOOKUP_COST = {"channelId": 0, "handle": 1, "user": 1, "customUrl": 1}
SEARCH_COST = 101

# Link classes.
SOCIAL_DOMAINS = [
    "instagram.com", "twitter.com", "x.com", "facebook.com", "fb.com", "tiktok.com", "snapchat.com", "threads.net",
    "linkedin.com",
]
AFFILIATE_DOMAINS = [
    "amzn.to", "bit.ly", "tinyurl.com", "goo.gl", "shorte.st", "adf.ly", "linktr.ee", "shrinkme.io",
]
AFFILIATE_MARKS = ["tag=", "ref=", "affiliate", "/dp/", "/gp/"]
VIDEO_DOMAINS = ["youtube.com", "youtu.be"]
URL_PATTERN = r"""(?i)https?://[^\s<>"']+"""


def parse_owner_url(url: Column) -> Column:
    """``struct(identifier, type)`` of the first matching pattern, else null."""
    found = F.lit(None).cast("struct<identifier:string,type:string>")
    for kind, pattern in reversed(OWNER_PATTERNS):
        found = F.when(
            url.rlike(pattern),
            F.struct(F.regexp_extract(url, pattern, 1).alias("identifier"), F.lit(kind).alias("type")),
        ).otherwise(found)
    return found


def handle_of(url: Column, strip_slash: bool = False) -> Column:
    """Lower-case handle after ``/@``; '' when there is none."""
    handle = F.lower(F.regexp_extract(url, r"/@([^/?]+)", 1))
    return F.regexp_replace(handle, "/+$", "") if strip_slash else handle


def progress_id(url: Column) -> Column:
    """Stable id of a link whose owner is not known."""
    is_url = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    from_path = F.translate(F.regexp_replace(path, "^/", ""), "/", "_")
    from_text = F.left(F.regexp_replace(url, r"[^a-zA-Z0-9@_-]", "_"), F.lit(100))
    text = F.when(is_url, from_path).otherwise(from_text)
    return F.coalesce(F.when(text != "", text), F.lit("unknown"))


def lookup_cost(link_type: Column, found_by_handle: Column | None = None) -> Column:
    cost = F.lit(None).cast("int")
    for kind, units in LOOKUP_COST.items():
        cost = F.when(link_type == kind, F.lit(units)).otherwise(cost)
    if found_by_handle is not None:
        cost = F.when((link_type == "customUrl") & ~found_by_handle, F.lit(SEARCH_COST)).otherwise(cost)
    return cost


def _any_of(parts: list[str]) -> str:
    return "|".join(re.escape(p) for p in parts)


def _class_of(low: Column, host: Column, strict_domains: bool) -> Column:
    def on(domains: list[str]) -> Column:
        names = _any_of(domains)
        return host.rlike(rf"(?:^|\.)(?:{names})(?::\d+)?$" if strict_domains else names)

    return (
        F.when(on(SOCIAL_DOMAINS), "social")
        .when(on(AFFILIATE_DOMAINS) | low.rlike(_any_of(AFFILIATE_MARKS)), "affiliate")
        .when(on(VIDEO_DOMAINS), F.when(low.rlike("playlist|list="), "playlist").otherwise("video"))
        .otherwise("website")
    )


def _host(low: Column) -> Column:
    return F.regexp_extract(low, r"https?://(?:www\.)?([^/]+)", 1)


def link_class(url: Column, strict_domains: bool = False) -> Column:
    """One class per link: social, affiliate, playlist, video or website.

    Domains are matched anywhere in the host by default; ``strict_domains``
    asks for the host itself or a sub-domain of it.
    """
    low = F.lower(url)
    return _class_of(low, _host(low), strict_domains)


def links_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL_PATTERN})"), F.lit(1))


def link_classes_in(text: Column, strict_domains: bool = False) -> Column:
    """Class of every link of a text; the host is taken once per link."""
    parts = F.transform(
        F.transform(links_in(text), lambda u: F.lower(u)), lambda u: F.struct(u.alias("low"), _host(u).alias("host"))
    )
    return F.transform(parts, lambda p: _class_of(p["low"], p["host"], strict_domains))
