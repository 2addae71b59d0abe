"""Further functions of listings: excerpts, identities, dates, travel texts, categories."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, text as T

def stem(token: Column, least: int = 4) -> Column:
    """A token without the first of the endings that leaves ``least`` characters."""
    fits = F.filter(F.array(*map(F.lit, fixed.PHRASE_ENDINGS)), lambda s: F.endswith(token, s) & (F.length(token) - F.length(s) >= least))
    return F.coalesce(F.substr(token, F.lit(1), F.length(token) - F.length(F.get(fits, F.lit(0)))), token)


def stemmed(text: Column) -> Column:
    """Stems of all tokens in order, joined by spaces."""
    tokens = F.filter(F.split(T.normalized(text), " "), lambda x: x != "")
    return F.array_join(F.transform(tokens, lambda x: stem(x)), " ")


def stemmed_runs(text: Column, begins: list[str]) -> Column:
    """stemmed() of those runs of tokens alone that begin with one of some stems, with bars between runs. As a stem is how
    its token begins, a phrase of these stems stands in it just where it stands in stemmed()."""
    if not begins:
        return F.lit("")
    first = f"(?={T.either(begins)})"
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"{first}(?<!{T.TOKEN[:-1]}){T.TOKEN}(?:{T.OTHER}{first}{T.TOKEN})*"), F.lit(0))
    return F.array_join(F.transform(runs, stemmed), " | ")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used: Spark makes array functions anew at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decisive(text: Column, marks: list[str]) -> Column:
    """The sentences that hold one of the marks, with their end marks, in order, trimmed."""
    # The space is looked for first, then what stands in front of it; only sentences with a mark are trimmed.
    parts = F.split(F.coalesce(text, F.lit("")), r"\s(?<=[.!?]\s)\s*")
    return F.transform(F.filter(parts, lambda s: T.has_any(F.lower(s), marks)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def excerpt(text: Column, limit: int, marks: list[str]) -> Column:
    """A text of at most ``limit`` characters as it is; of a longer one the first half of that, and right after it, in
    order, the sentences of the whole text with one of the marks, chosen from the end while they fit; if none is chosen,
    the first ``limit`` characters."""
    return F.when(F.length(text) <= limit, text).otherwise(_bound(decisive(text, marks), lambda found: _shortened(text, limit, found)))


def _shortened(text: Column, limit: int, found: Column) -> Column:
    """The excerpt of a text that is longer than ``limit``, from its decisive sentences."""
    half = limit // 2
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    fits = lambda got, s: got["used"] + F.length(s) + 1 <= limit - half
    more = lambda got, s: F.struct(F.array_prepend(got["kept"], s).alias("kept"), (got["used"] + F.length(s) + 1).alias("used"))
    kept = F.aggregate(F.reverse(found), start, lambda got, s: F.when(fits(got, s), more(got, s)).otherwise(got), lambda got: got["kept"])
    made = lambda tail: F.substring(F.concat(F.substring(text, 1, half), tail), 1, limit)
    return _bound(F.array_join(kept, " "), lambda tail: F.when(tail == "", F.substring(text, 1, limit)).otherwise(made(tail)))


def coverage(text: Column, limit: int, marks: list[str]) -> Column:
    """Struct (decisive, by_head, by_excerpt): how many sentences decide, and how many of them the first ``limit``
    characters and the excerpt of that length hold whole."""
    held = lambda found, whole: _bound(whole, lambda w: F.size(F.filter(found, lambda s: F.contains(w, s))))
    short = lambda found: F.when(F.length(text) <= limit, text).otherwise(_shortened(text, limit, found))
    return _bound(decisive(text, marks), lambda found: F.struct(
        F.size(found).alias("decisive"), held(found, F.substring(text, 1, limit)).alias("by_head"), held(found, short(found)).alias("by_excerpt")))


def first_sentences(text: Column, most: int, chars: int) -> Column:
    """The first ``most`` sentences with their end marks, cut at a word within ``chars`` characters."""
    # Trimmed of every kind of space, as the SQL does; line ends stay.
    parts = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]"), F.lit(0)), 1, most), lambda s: F.regexp_replace(s, r"^\p{Zs}+|\p{Zs}+\z", ""))
    joined = F.array_join(parts, " ")
    # \z, not $, which also stands before a line end at the end; \s would hold the vertical tab.
    cut = F.regexp_replace(F.substring(joined, 1, chars), r"[ \t\n\f\r]+[^ \t\n\f\r]*\z", "")
    return F.when(F.length(joined) <= chars, joined).otherwise(F.concat(cut, F.lit(".")))


def precision(location: Column) -> Column:
    """0 for nothing, 1 for the whole country or remote work alone, 2 for a region, 3 for a place."""
    region = F.rlike(location, F.lit("|".join(fixed.REGION_MARKS)))
    return F.when(F.coalesce(location, F.lit("")) == "", 0).when(location.isin("Suomi", "Etä"), 1).when(region, 2).otherwise(3)


def chosen_location(current: Column, candidate: Column) -> Column:
    """The candidate if it is at least as precise."""
    return F.when(precision(candidate) >= precision(current), candidate).otherwise(current)


def is_short(description: Column, threshold: int) -> Column:
    return F.length(F.trim(F.coalesce(description, F.lit("")))) < threshold


def identity(**fields: Column) -> Column:
    """sha256 of the JSON object of fields in the order of their names; nulls count."""
    return F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def category(title: Column, employer: Column, titles: Column, keywords: Column, sectors: Column, hidden: Column) -> Column:
    """Struct (category, hidden) by the first rung that holds: words of the title, then matched terms and words of
    title and employer, topic by topic; titles, keywords and sectors are arrays of matched terms, null for none."""
    none = F.array().cast("array<string>")
    titles, keywords, sectors = (F.coalesce(x, none) for x in (titles, keywords, sectors))
    low = F.lower(F.coalesce(title, F.lit("")))
    shown = F.split(F.replace(F.lower(F.concat_ws(" ", title, employer)), F.lit("-"), F.lit(" ")), r"\s+")
    every = F.concat(titles, keywords, sectors)
    in_title = lambda terms: T.has_any(low, terms) | F.arrays_overlap(titles, F.array(*map(F.lit, terms)))
    anywhere = lambda terms: F.arrays_overlap(F.concat(shown, every), F.array(*map(F.lit, terms)))
    strong = [x for x in fixed.LEADERSHIP_TERMS if x != "koordinaattori"]
    rungs = [
        (in_title(fixed.LIBRARY_TERMS), "library"), (in_title(strong), "leadership"), (anywhere(fixed.MUSIC_TERMS), "music"), (anywhere(fixed.GUIDANCE_TERMS), "guidance"), (anywhere(fixed.CULTURE_TERMS), "culture"),
        (anywhere(fixed.LEADERSHIP_TERMS), "leadership"), (anywhere(fixed.LIBRARY_TERMS), "library"), (hidden, "hidden"),
    ]
    named = F.coalesce(*(F.when(test, F.lit(fixed.CATEGORIES[k])) for test, k in rungs), F.lit(fixed.CATEGORIES["other"]))
    return F.struct(named.alias("category"), hidden.alias("hidden"))


def publication_mode(provider_ready: Column, hosted_allowed: Column, provider_name: Column) -> Column:
    """``hosted`` with a provider; without, ``deterministic_only`` if that is on purpose, else ``unavailable``."""
    on_purpose = ~F.coalesce(hosted_allowed, F.lit(True)) | (F.trim(F.coalesce(provider_name, F.lit(""))) == "")
    return F.when(F.coalesce(provider_ready, F.lit(False)), "hosted").when(on_purpose, "deterministic_only").otherwise("unavailable")


def token_usage(provider: Column, usage: Column) -> Column:
    """Struct (input_tokens, output_tokens, cached_tokens, usage_present) of what a provider reports as JSON, in the
    shape of ``gemini`` or of others; what is absent stays null."""
    get = lambda path: F.get_json_object(usage, path).cast("long")
    either = lambda a, b: F.when(provider == "gemini", get(a)).otherwise(get(b))
    read, made, cached = either("$.promptTokenCount", "$.input_tokens"), either("$.candidatesTokenCount", "$.output_tokens"), either("$.cachedContentTokenCount", "$.input_tokens_details.cached_tokens")
    return F.struct(read.alias("input_tokens"), made.alias("output_tokens"), cached.alias("cached_tokens"), (read.isNotNull() | made.isNotNull()).alias("usage_present"))


def localized(values: Column, *languages: str) -> Column:
    """The text in the first of the languages that has one, else the first of all; values: map of language to text."""
    texts = [F.nullif(F.try_element_at(values, F.lit(x)), F.lit("")) for x in languages]
    return F.coalesce(*texts, F.nullif(F.get(F.map_values(values), F.lit(0)), F.lit("")))


def name_from_slug(slug: Column) -> Column:
    """Words of a slug with capitals, also those of forms of companies."""
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    return F.nullif(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2), F.length(w))))), " "), F.lit(""))


def next_weekday_morning(at: Column, zone: str = "Europe/Helsinki", hour: int = 8) -> Column:
    """The next weekday's morning in a zone, as UTC."""
    day = F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))
    ahead = F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1)
    return F.to_utc_timestamp(F.date_add(day, ahead).cast("timestamp") + F.expr(f"make_dt_interval(0, {hour})"), zone)


def patched_concerns(concerns: Column, text: Column, good: Column) -> Column:
    """Concerns on location are replaced by a text; if there is none, a text that is not good is added once."""
    match = lambda c: F.contains(F.lower(c), F.lit("sijainti ei osu"))
    some = F.exists(concerns, match)
    return F.when(some, F.array_distinct(F.transform(concerns, lambda c: F.when(match(c), text).otherwise(c)))).when(good | F.array_contains(concerns, text), concerns).otherwise(F.array_append(concerns, text))


def utc(value: Column, ends: bool = False, zone: str = "Europe/Helsinki") -> Column:
    """Struct (at, date_only, malformed) of a date in text: a mere date is the zone's day, its beginning or,
    with ``ends``, its end; a time without offset is the zone's."""
    plain = F.nullif(F.trim(value), F.lit(""))
    date_only = F.rlike(plain, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    offset = F.rlike(plain, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    parsed = F.try_to_timestamp(plain)
    day = F.to_utc_timestamp(F.date_add(parsed.cast("date"), 1 if ends else 0).cast("timestamp"), zone)
    at = F.when(date_only, day).when(offset, parsed).otherwise(F.to_utc_timestamp(parsed, zone))
    return F.struct(at.alias("at"), F.coalesce(date_only & parsed.isNotNull(), F.lit(False)).alias("date_only"), (plain.isNotNull() & parsed.isNull()).alias("malformed"))


def without_names(text: Column, allowed: Column) -> Column:
    """Capitalised words that are not among the allowed (folded) ones are replaced, wherever they stand."""
    words = F.split(text, " ")
    bare = lambda w: F.regexp_replace(w, r"[^\p{L}'-]+", "")
    named = lambda w: F.rlike(bare(w), F.lit(r"^[A-ZÅÄÖ][a-zåäö]+$")) & ~F.array_contains(allowed, F.lower(bare(w)))
    return F.array_join(F.transform(words, lambda w: F.when(named(w), F.lit("[name]")).otherwise(w)), " ")


def model_input(fields: dict[str, Column], chars: int = 4000) -> Column:
    """One JSON text of fields in the order of their names, long ones cut, personal data replaced."""
    clean = [T.without_personal_data(F.substring(c, 1, chars)).alias(k) for k, c in sorted(fields.items())]
    return F.to_json(F.struct(*clean))
