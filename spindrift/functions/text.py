"""Text functions of listings, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

TOKEN = "[0-9a-zåäö]+"
#: What is no token, as ranges: Java looks for a negated class with these letters seven times as slowly.
OTHER = r"[\x00-/:-`\x7B-\xE3\xE6-\xF5\xF7-\x{10FFFF}]+"


def folded(text: Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Distinct tokens in the order of their first occurrence; null gives an empty array."""
    # Cutting at what is no token is faster than finding tokens; it leaves empty strings at the ends.
    return F.array_remove(F.array_distinct(F.split(folded(F.coalesce(text, F.lit(""))), OTHER)), "")


def token_variants(token: Column) -> Column:
    """A token, its base form if the table has one, and its stem under every ending that leaves 5 characters
    (for tokens of 7 and more)."""
    lemmas = F.create_map(*(F.lit(x) for pair in fixed.LEMMAS.items() for x in pair))
    ends = F.array(*map(F.lit, fixed.SUFFIXES))
    fits = F.filter(ends, lambda s: F.endswith(token, s) & (F.length(token) - F.length(s) >= 5))
    stems = F.transform(fits, lambda s: F.substr(token, F.lit(1), F.length(token) - F.length(s)))
    found = F.concat(F.array(token), F.array_compact(F.array(F.try_element_at(lemmas, token))), F.when(F.length(token) >= 7, stems).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(found)


def expanded_tokens(text: Column) -> Column:
    """All variants of all tokens."""
    return F.array_distinct(F.flatten(F.transform(tokens(text), token_variants)))


def normalized(text: Column) -> Column:
    """Tokens joined by single spaces, repeats kept; null gives an empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text as whole tokens; an empty phrase never does. Both are normalised."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def either(marks: list[str]) -> str:
    """A pattern that finds any of the marks. They are grouped by their first letter, as Java tries one after another at
    every place of a text."""
    by: dict[str, list[str]] = {}
    for m in marks:
        by.setdefault(m[:1], []).append(re.escape(m[1:]))
    if "" in by or not by:
        return "" if by else "(?!)"
    return f"(?=[{''.join(map(re.escape, by))}])(?:{'|'.join(f'{re.escape(c)}(?:{"|".join(rest)})' for c, rest in by.items())})"


def has_any(text: Column, marks: list[str]) -> Column:
    """Whether any of the marks is part of a text: one pattern, so that the text is made once and the test stays in
    generated code."""
    return F.rlike(text, F.lit(either(marks)))


def first_mark(text: Column, marks: list[str]) -> Column:
    """The first of the marks that is part of a text, in the order of the list; null if none is."""
    return F.get(F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m)), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences in order: cut at . ! ? ; and line ends, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n;]+"), lambda s: F.trim(s)), lambda s: s != "")


def without_markup(html: Column) -> Column:
    """Tags become spaces, runs of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def work_mode(text: Column) -> Column:
    """Struct (mode, confidence, evidence) of a folded text: a negation decides; remote and hybrid together
    stay unknown; a mere possibility proves nothing."""
    no, full, part, may = (first_mark(text, m) for m in (fixed.REMOTE_NEGATED, fixed.FULL_REMOTE, fixed.HYBRID, fixed.REMOTE_POSSIBLE))
    make = lambda mode, sure, why: F.struct(F.lit(mode).alias("mode"), F.lit(sure).alias("confidence"), why.alias("evidence"))
    return (
        F.when(no.isNotNull(), make("none", "high", no)).when(full.isNotNull() & part.isNotNull(), make("unknown", "low", full))
        .when(full.isNotNull(), make("full_remote", "high", full)).when(part.isNotNull(), make("hybrid", "high", part)).otherwise(make("unknown", "low", may)))


def with_work_mode(location: Column, suffix: Column) -> Column:
    """A location with a work-mode suffix behind it, unless it has it already."""
    place = F.nullif(F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"\s+", " ")), F.lit(""))
    return F.when(suffix.isNull(), place).when(place.isNull(), suffix).when(F.contains(F.lower(place), F.lower(suffix)), place).otherwise(F.concat(place, F.lit(" / "), suffix))


def city_of(text: Column) -> Column:
    """City that a text names: aliases first, then the first city of the list, with or without a case ending."""
    plain = without_markup(text)
    low = F.lower(plain)
    alias = F.coalesce(*(F.when(F.contains(low, F.lit(a)), F.lit(c)) for a, c in fixed.CITY_ALIASES.items()))
    city = F.coalesce(*(F.when(F.rlike(plain, F.lit(f"(?i)(^|[^A-Za-zÅÄÖåäö]){c}(ssa|ssä|sta|stä|an|en|in)?([^A-Za-zÅÄÖåäö]|$)")), F.lit(c)) for c in fixed.CITIES))
    return F.coalesce(alias, city)


def without_personal_data(text: Column, secrets: list[str] | None = None) -> Column:
    """E-mail addresses, phone numbers and known secrets of four characters and more replaced."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(mail, r"\+?[0-9][0-9 ()-]{6,}[0-9]", "[phone]")
    for secret in secrets or []:
        if len(secret) >= 4:
            out = F.replace(out, F.lit(secret), F.lit("[secret]"))
    return out


def formatted_duration(seconds: Column) -> Column:
    """Whole minutes, rounded up and at least 1, as "1 h 5 min"."""
    minutes = F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("long")
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(hours == 0, F.concat(rest.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(hours.cast("string"), F.lit(" h"))).otherwise(F.concat(hours.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min")))
