"""Locations of listings: work mode, labels, destinations, home."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text as T


def work_mode_of(location: Column) -> Column:
    """``remote``, ``hybrid`` or null, from the suffix of a location."""
    low = F.lower(F.coalesce(location, F.lit("")))
    return F.when(F.contains(low, F.lit("/ etä")) | F.endswith(low, F.lit(" etä")), "remote").when(F.contains(low, F.lit("/ hybridi")), "hybrid")


def display_label(location: Column, destination: Column | None = None) -> Column:
    """A destination without its country, else what stands before the first slash or comma; null for nothing."""
    first = F.nullif(F.trim(F.split_part(F.split_part(location, F.lit("/"), F.lit(1)), F.lit(","), F.lit(1))), F.lit(""))
    if destination is None:
        return first
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(destination, ", Finland$", ""), ", Suomi$", "")), F.lit("")), first)


def without_mode(location: Column) -> Column:
    """A location up to its work mode, without a comma at the end."""
    low = F.lower(location)
    at = F.coalesce(*(F.nullif(F.instr(low, F.lit(m)), F.lit(0)) for m in ("/ etä", "/ hybridi")))
    cut = F.rtrim(F.trim(F.substr(location, F.lit(1), at - 1)), F.lit(","))
    return F.when(at.isNull(), F.trim(location)).otherwise(cut)


def destination(place: Column) -> Column:
    """A place as a destination with its country; null for nothing and for the whole country."""
    plain = without_mode(place)
    low = F.lower(plain)
    named = F.contains(low, F.lit("finland")) | F.contains(low, F.lit("suomi"))
    return F.when((plain == "") | low.isin(fixed.WHOLE_COUNTRY), F.lit(None)).when(named, plain).otherwise(F.concat(plain, F.lit(", Finland")))


def destinations(location: Column) -> Column:
    """Destinations of a location in order, each once; none if it is vague as a whole."""
    plain = without_mode(F.coalesce(location, F.lit("")))
    mode = F.coalesce(work_mode_of(location), F.lit(""))
    parts = F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).isin(fixed.WHOLE_COUNTRY) & ~((mode == "remote") & F.lower(x).isin("etä", "eta", "remote")))
    found = F.array_distinct(F.array_compact(F.transform(parts, destination)))
    return F.when(F.lower(plain).isin(fixed.WHOLE_COUNTRY), F.array().cast("array<string>")).otherwise(found)


def full_remote(location: Column) -> Column:
    """Whether a location or text proves full-time remote work; mere possibilities and hybrids never do."""
    low = F.lower(F.coalesce(location, F.lit("")))
    weak = T.has_any(low, fixed.WEAK_REMOTE) | F.contains(low, F.lit("/ hybridi"))
    whole = F.btrim(F.trim(low), F.lit(".")).isin(fixed.WHOLLY_REMOTE)
    letters, latin = "[^a-zåäö]", "[^a-z]"
    told = [rf"(^|{letters})etätyö({letters}|$)", rf"(^|{latin})fully remote({latin}|$)", rf"(^|{latin})100\s*%\s*remote({latin}|$)", rf"(^|{letters})täysin etänä({letters}|$)"]
    proof = whole | F.contains(low, F.lit("/ etä")) | F.rlike(low, F.lit("|".join(told))) | F.endswith(low, F.lit(" etä"))
    return ~weak & (F.trim(low) != "") & proof


def city_name(place: Column) -> Column:
    """What stands before the first slash or comma, folded."""
    return F.lower(F.trim(F.split_part(F.split_part(place, F.lit("/"), F.lit(1)), F.lit(","), F.lit(1))))


def origin_city(address: Column) -> Column:
    """The first part of an address without a digit, which is no street; else its first part."""
    parts = F.filter(F.transform(F.split(address, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(F.filter(parts, lambda x: ~F.rlike(x, F.lit(r"\d"))), F.lit(0)), F.get(parts, F.lit(0)))
