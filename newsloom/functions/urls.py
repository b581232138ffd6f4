"""URL column builders.

One portable pattern splits a URL, so a malformed address gives nulls or empty
parts instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.texts import bind

# RFC 3986 split; groups are scheme, authority, path, query.
URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
SCHEME, AUTHORITY, PATH, QUERY = 1, 2, 3, 4
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Tracking parameters dropped from article addresses.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("fbclid", "gclid")

# Parameters that carry the real target of a redirect, in order.
REDIRECT_PARAMS = ("url", "u", "continue", "redirect", "redirect_uri", "dest", "destination", "r")
MAX_REDIRECT_LEVELS = 3


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PATTERN, group)


def hostname(url: Column) -> Column:
    """Lower-case host without user and port; the input itself when it has none."""
    host = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    return F.when(host == "", url).otherwise(host)


def query_pairs(query: Column) -> Column:
    """Non-empty ``k=v`` pieces of a query string."""
    return F.filter(F.split(query, "&"), lambda p: p != "")


def query_value(query: Column, key: str) -> Column:
    """First non-blank value of a parameter, still percent-encoded; empty if absent."""
    return F.regexp_extract(query, rf"(?:^|&){key}=([^&]+)", 1)


def decode_component(value: Column) -> Column:
    """Percent- and plus-decoding that keeps text it cannot decode."""
    return F.coalesce(F.try_url_decode(value), value)


def encode_component(value: Column) -> Column:
    """Form encoding where only letters, digits and ``_.-~`` stay bare."""
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_source_url(url: Column) -> Column:
    """Canonical article address.

    Default scheme http, lower-case host, no fragment, no trailing slash, no
    ``utm_*``, ``fbclid`` or ``gclid`` parameters; other parameters keep their
    order and are re-encoded.  Null for a null or empty input.
    """
    scheme = F.lower(part(url, SCHEME))
    scheme = F.when(scheme == "", "http").otherwise(scheme)
    authority = F.lower(part(url, AUTHORITY))
    path = F.regexp_replace(part(url, PATH), r";[^/]*$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)

    def reencode(pair: Column) -> Column:
        name = decode_component(F.substring_index(pair, "=", 1))
        value = decode_component(F.regexp_extract(pair, "^[^=]*=(.*)$", 1))
        return F.concat(encode_component(name), F.lit("="), encode_component(value))

    def kept(pair: Column) -> Column:
        name = decode_component(F.substring_index(pair, "=", 1))
        return ~(name.startswith(TRACKING_PREFIX) | name.isin(*TRACKING_PARAMS))

    query = F.array_join(F.transform(F.filter(query_pairs(part(url, QUERY)), kept), reencode), "&")
    address = F.when(authority != "", F.concat(scheme, F.lit("://"), authority, path)).otherwise(
        F.concat(scheme, F.when((path == "") | path.startswith("/"), "://").otherwise(":"), path)
    )
    full = F.when(query != "", F.concat(address, F.lit("?"), query)).otherwise(address)
    return F.when(F.length(url) > 0, full)


def redirect_target(url: Column) -> Column:
    """Target of one redirect level, or null when no parameter carries one."""
    query = part(url, QUERY)
    found = []
    for name in REDIRECT_PARAMS:
        value = F.trim(decode_component(query_value(query, name)))
        # the value may be encoded once more; this pass leaves plus signs alone
        value = decode_component(F.replace(value, F.lit("+"), F.lit("%2B")))
        found.append(F.when(F.lower(value).rlike("^https?://"), value))
    return F.coalesce(*found)


def unwrap_redirect_url(url: Column) -> Column:
    """Follow embedded target addresses up to three levels."""
    current = F.trim(F.coalesce(url, F.lit("")))
    for _ in range(MAX_REDIRECT_LEVELS):
        current = bind(current, lambda u: F.coalesce(redirect_target(u), u))
    return current
