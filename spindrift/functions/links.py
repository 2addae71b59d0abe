"""Addresses of listings: why one may not be followed, and safe forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 2048
# Address ranges that are not public (IANA registry), and endings of private host names.
PRIVATE_V4 = r"^(0|10|127)\.\d+\.\d+\.\d+$|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^192\.0\.[02]\.\d+$|^192\.168\.\d+\.\d+$|^198\.1[89]\.\d+\.\d+$|^198\.51\.100\.\d+$|^203\.0\.113\.\d+$|^2[45]\d\.\d+\.\d+\.\d+$"
PRIVATE_NAMES = r"(^|\.)localhost$|\.(local|internal|localdomain)$"
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
HOST_NAME = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$"


def _netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a dot at the end; empty if there is none."""
    place = F.regexp_extract(_netloc(url), "([^@]*)$", 1)
    return F.rtrim(F.lower(F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"^\[|\]$", "")), F.lit("."))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def rejection(url: Column, hosts: Column | None = None, paths: Column | None = None, longest: int = LONGEST) -> Column:
    """Why a URL may be neither fetched nor shown, null if it may.

    hosts: array of host names that are allowed with all below them; null allows every public host, an empty array
    none. paths: array of beginnings of paths; null or empty allows every path. Private hosts are never allowed."""
    text = F.btrim(url, F.lit(SPACE))
    place = F.regexp_extract(_netloc(text), "([^@]*)$", 1)
    user = F.regexp_extract(_netloc(text), "^(.*)@", 1)
    port = F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^\[:]*):(.*)$", 1)
    host, path = host_of(text), path_of(text)
    v6 = F.contains(host, F.lit(":"))
    unclosed = F.contains(_netloc(text), F.lit("[")) != F.contains(_netloc(text), F.lit("]"))
    private = F.rlike(host, F.lit(PRIVATE_NAMES)) | F.rlike(host, F.lit(PRIVATE_V4)) | (v6 & F.rlike(host, F.lit(r"^(::1?$|f[cd]|fe[89ab]|2001:db8|::ffff:)")))
    reason = (
        F.when(text.isNull() | (text == ""), "missing").when(F.length(text) > longest, "too_long").when(F.rlike(text, F.lit(r"[\x00-\x1f\x7f]")), "control_characters")
        .when(unclosed | ~F.rlike(port, F.lit(r"^\d{0,5}$")) | (F.coalesce(F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999")), F.lit(0)) > 65535), "malformed")
        .when(~F.rlike(text, F.lit("^(?i)https?:")), "non_http_scheme").when((user != "") & (user != ":"), "embedded_credentials").when(host == "", "malformed")
        .when(private, "private_host").when(~F.rlike(host, F.lit(HOST_NAME)), "malformed"))
    if hosts is not None:
        named = F.transform(hosts, lambda h: F.ltrim(F.lower(F.trim(h)), F.lit(".")))
        reason = F.coalesce(reason, F.when(hosts.isNotNull() & ~F.exists(named, lambda h: (h != "") & ((host == h) | F.endswith(host, F.concat(F.lit("."), h)))), "unexpected_host"))
    if paths is not None:
        begins = F.transform(paths, lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))
        fits = F.exists(begins, lambda p: (path == F.rtrim(p, F.lit("/"))) | F.startswith(path, p))
        reason = F.coalesce(reason, F.when((F.size(paths) > 0) & ~fits, "unexpected_path"))
    return reason


def safe_link(url: Column) -> Column:
    """A public http(s) URL without slashes at its end; null for any other."""
    return F.when(rejection(url).isNull(), F.nullif(F.rtrim(F.btrim(url, F.lit(SPACE)), F.lit("/")), F.lit("")))
