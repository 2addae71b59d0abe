"""Queries of the rules that decide on a listing: freshness, languages, qualifications, places, addresses, scores,
categories, publication. Their SQL states the rules anew over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, links, listing as L, places as P, text as T
from ..operators import gates, ranking, scoring
from . import flagship
from .binding import Tables
from .listings import _ENDS, _NORM, _TOKENS, _any, as_of
from .registry import query

_AS_OF = "timestamp '2024-03-20 00:00:00'"


def _chosen(values: list[str | None], by: str = "n_chars") -> F.Column:
    """The value at the place of ``by`` modulo their number."""
    return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))


def _sql_chosen(values: list[str | None], by: str = "n_chars") -> str:
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({by} % {len(values)}) + 1]"


def _filled(text: F.Column, **parts: F.Column) -> F.Column:
    """A text with each ``{name}`` replaced by the column of that name."""
    for name, part in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), part)
    return text


def _sql_filled(text: str, **parts: str) -> str:
    for name, part in parts.items():
        text = f"replace({text}, '{{{name}}}', {part})"
    return text


# --- dates -----------------------------------------------------------------------------------------------------

_DATED = f"""select job_id, case when job_id % 17 <> 0 then published_at end as published_at, case when job_id % 2 = 0 then published_at + interval 1 day end as first_seen_at, expires_at,
  job_id % 19 = 0 as published_malformed, job_id % 29 = 0 as first_seen_malformed, job_id % 23 = 0 as deadline_malformed from job"""


@query(f"""with d as ({_DATED}), e as (select *, case when not published_malformed then published_at end as p, case when not first_seen_malformed then first_seen_at end as s from d),
  a as (select *, coalesce(p, s) as eff, date_diff('microsecond', coalesce(p, s), {_AS_OF}) / 86400000000.0 as age from e),
  r as (select *, case when eff is null then 'no_publication_date' when eff > {_AS_OF} + interval 6 hour then 'future_publication_date' when age > 30 then 'too_old' else 'fresh' end as dated, case when not deadline_malformed then expires_at < {_AS_OF} end as passed from a)
  select job_id, round(age, 4) as age_days, passed as deadline_passed, case when p is not null then 'published_at' when s is not null then 'first_seen' else 'unknown' end as source,
    case when passed then 'past_deadline' when deadline_malformed and dated <> 'too_old' then 'unknown_deadline' else dated end as reason, dated <> 'too_old' and not coalesce(passed, false) as eligible,
    dated in ('no_publication_date', 'future_publication_date') or published_malformed or first_seen_malformed or deadline_malformed as review from r""")
def freshness_gate(t: Tables) -> DataFrame:
    k = F.col("job_id")
    jobs = t.job.withColumns({
        "first_seen_at": F.when(k % 2 == 0, F.col("published_at") + F.expr("make_dt_interval(1)")), "published_at": F.when(k % 17 != 0, F.col("published_at")),
        "published_malformed": k % 19 == 0, "first_seen_malformed": k % 29 == 0, "deadline_malformed": k % 23 == 0})
    return gates.freshness(jobs, as_of()).select("job_id", "age_days", "deadline_passed", "source", "reason", "eligible", "review")


_LATE = "timezone('UTC', timezone('Europe/Helsinki', {}))"


@query(f"""with v as (select event_id, ts, event_id % 4 as kind from events)
  select event_id, case kind when 0 then {_LATE.format("date_trunc('day', ts)::timestamp")} when 1 then date_trunc('second', ts) end as at, kind = 0 as date_only, kind = 2 as malformed from v""")
def date_coerce(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 2, "odd")
    rows = t.events.select("event_id", L.utc(text).alias("d"))
    return rows.select("event_id", F.col("d.at").cast("timestamp_ntz").alias("at"), "d.date_only", "d.malformed")


@query(f"""with d as (select event_id, timezone('Europe/Helsinki', timezone('UTC', ts))::date as d from events)
  select event_id, {_LATE.format("(d + (case dayofweek(d) when 5 then 3 when 6 then 2 else 1 end)::int)::timestamp + to_hours(8)")} as leave from d""")
def next_weekday_departure(t: Tables) -> DataFrame:
    return t.events.select("event_id", L.next_weekday_morning(F.col("ts")).cast("timestamp_ntz").alias("leave"))


# --- languages and qualifications ------------------------------------------------------------------------------

_SAID = [
    "Englannin kielen taito vaaditaan", "Edellytämme erinomaista ruotsin kielen taitoa", "Saksan kielen taito katsotaan eduksi", "Vaaditaan sujuva ruotsin kielen taito", "Vaaditaan suomen tai saksan kielen taito", "Saksan tai englannin kielen taito vaaditaan",
    "Ruotsin kielen taito vaaditaan", "Englannin kielen taitoa ei vaadita", "Saksan markkinan tuntemus vaaditaan", "Vaaditaan ukrainan or ruotsin kielen taito", "",
]
_RULES = [("fi", "pass"), ("en", "reject"), ("sv", "above_b2"), ("de", "reject")]
_NAMED = {c: _any("x", n) for c, n in fixed.LANGUAGE_NAMES.items()}
_TOP = _any("x", fixed.NATIVE_MARKERS + fixed.EXCELLENT_MARKERS)


@query(f"""with s as (select job_id, generate_subscripts(p, 1) - 1 as pos, lower(unnest(p)) as x from (select job_id, list_filter(list_transform(string_split_regex(coalesce(title, '') || '. ' || description || '. ' || {_sql_chosen(_SAID)}, '[.!?\\n;]+'), lambda x: trim(x)), lambda x: x <> '') as p from job)),
  l as (select unnest(['en', 'sv', 'de']) as code, unnest(['reject', 'above_b2', 'reject']) as rule),
  h as (select s.*, l.code, l.rule, {_TOP} as top from s join l on case l.code """ + " ".join(f"when '{c}' then {x}" for c, x in _NAMED.items()) + f""" end
    where {_any('x', fixed.LANGUAGE_CONTEXT)} and not {_any('x', fixed.NEGATION_MARKERS)} and not {_any('x', fixed.OPTIONAL_MARKERS)} and ({_any('x', fixed.STRONG_MARKERS)} or {_TOP})
      and not ((contains(x, ' tai ') or contains(x, ' or ')) and (({_NAMED['fi']}) or (l.code <> 'sv' and {_NAMED['sv']})))),
  v as (select *, case when rule = 'reject' or top then 'fail' when {_any('x', fixed.AT_MOST_B2_MARKERS)} then 'pass' else 'caution' end as verdict from h)
  select job_id, code, arg_min(verdict, pos) as verdict, cast(min(pos) as int) as pos from v group by all""")
def language_gate(t: Tables) -> DataFrame:
    jobs = t.job.withColumn("description", F.concat("description", F.lit(". "), _chosen(_SAID)))
    return gates.language_gate(jobs, t.spark.createDataFrame(_RULES, "code string, rule string"))


_TITLES = ["Hammaslääkäri ", "Koordinaattori ", "Myyjä ", ""]
_DEMANDS = [
    "Sosiaalityöntekijän kelpoisuutta edellytetään", "Sosiaalityöntekijän kelpoisuus katsotaan eduksi", "Hammaslääkärin työpari", "Hammaslääkärin ei tarvitse", "Hammaslääkäri ei tarvitse autoa", "Ajokortista sovitaan", "Hygieniapassia kysytään", "Kelpoisuus sosiaalityöntekijän", "",
]
_CHECKS = [
    ("dentist", ["hammaslääkäri"], [], [], [], [], False), ("social", [], ["sosiaalityöntekijän kelpoisuus"], ["koordinaattori"], [], [], False), ("driver", [], [], [], ["ajokortti"], ["hygieniapassi"], True), ("hygiene", [], [], [], ["ajokortti"], ["hygieniapassi"], False),
]


def _demanding(t: Tables) -> DataFrame:
    return t.job.withColumns({"title": F.concat(_chosen(_TITLES, "job_id"), "title"), "description": F.concat("description", F.lit(". "), _chosen(_DEMANDS), F.lit("."))})


def _ending(token: str) -> str:
    """SQL of a token without the first ending that leaves four characters."""
    return f"coalesce(substr({token}, 1, length({token}) - length(list_filter({fixed.PHRASE_ENDINGS!r}, lambda e: ends_with({token}, e) and length({token}) - length(e) >= 4)[1])), {token})"


def _stems(text: str) -> str:
    return f"' ' || coalesce(array_to_string(list_transform(list_filter(string_split({_NORM.format(text)}, ' '), lambda w: w <> ''), lambda w: {_ending('w')}), ' '), '') || ' '"


def _soft(phrase: str) -> str:
    first = f"list_filter(string_split_regex(lower(raw), '[.!?\\n]'), lambda s: contains(s, '{phrase}'))[1]"
    return "coalesce(" + " or ".join(f"contains({first}, '{m}')" for m in fixed.DEMAND_NEGATED + fixed.DEMAND_OPTIONAL) + ", false)"


# Stems of the phrases: hammaslääkäri, sosiaalityöntekijä kelpoi, koordinaattori, ajokort, hygieniapassi.
_PHRASE = {p: f"({_stems(chr(39) + p + chr(39))})" for p in ("hammaslääkäri", "sosiaalityöntekijän kelpoisuus", "koordinaattori", "ajokortti", "hygieniapassi")}


@query(f"""with j as (select job_id, concat({_sql_chosen(_TITLES, 'job_id')}, title) as title, description || '. ' || {_sql_chosen(_DEMANDS)} || '.' as d from job),
  x as (select job_id, title || '. ' || d as raw, {_stems('title')} as tt, {_stems("title || '. ' || d")} as xx from j),
  v as (select job_id, 'dentist' as name, case when contains(tt, {_PHRASE['hammaslääkäri']}) then 'reject' when contains(xx, {_PHRASE['hammaslääkäri']}) then case when {_soft('hammaslääkäri')} then 'caution' else 'reject' end end as verdict from x
    union all select job_id, 'social', case when contains(xx, {_PHRASE['sosiaalityöntekijän kelpoisuus']}) then case when {_soft('sosiaalityöntekijän kelpoisuus')} then 'caution' when contains(tt, {_PHRASE['koordinaattori']}) then 'caution' else 'reject' end end from x
    union all select job_id, 'driver', case when contains(xx, {_PHRASE['ajokortti']}) then 'caution' end from x
    union all select job_id, 'hygiene', case when contains(xx, {_PHRASE['hygieniapassi']}) then 'caution' end from x)
  select * from v where verdict is not null""")
def qualification_gate(t: Tables) -> DataFrame:
    phrases = "name string, title_or_text array<string>, reject array<string>, adjacent array<string>, caution array<string>, required array<string>, never_by_title boolean"
    return gates.qualification_gate(_demanding(t), t.spark.createDataFrame(_CHECKS, phrases))


@query(f"""with j as (select job_id, title || '. ' || description || '. ' || {_sql_chosen(_DEMANDS)} || '.' as raw from job)
  select job_id, {_soft('sosiaalityöntekijän kelpoisuus')} as softened from j""")
def softened_requirement(t: Tables) -> DataFrame:
    rows = t.job.select("job_id", F.concat("title", F.lit(". "), "description", F.lit(". "), _chosen(_DEMANDS), F.lit(".")).alias("raw"))
    return rows.select("job_id", gates.softened(F.col("raw"), F.lit("sosiaalityöntekijän kelpoisuus")).alias("softened"))


@query(f"""select job_id, contains({_stems("title || '. ' || description || '. ' || " + _sql_chosen(_DEMANDS))}, {_PHRASE['sosiaalityöntekijän kelpoisuus']}) as found from job""")
def stemmed_phrase_match(t: Tables) -> DataFrame:
    text = F.concat("title", F.lit(". "), "description", F.lit(". "), _chosen(_DEMANDS))
    pad = lambda c: F.concat(F.lit(" "), L.stemmed(c), F.lit(" "))
    return t.job.select("job_id", F.contains(pad(text), pad(F.lit("sosiaalityöntekijän kelpoisuus"))).alias("found"))


# --- places ----------------------------------------------------------------------------------------------------

#: Ways of writing a location; {a}, {b} and {c} are the first words of a listing's title, which stand for its towns.
_LOCATIONS = [
    "{a}", "{a} / Etä", "{a} / Hybridi", "Suomi", "Oulu", "{a}, {b}, Oulu", None, " ", "Etätyö.", "Oulu / Etä", "täysin etänä", "{a}, mahdollisuus etätyöhön / Etä", "Ylivieska / Hybridi", "Suomi, {b}", "Turku, etä",
    "fully remote ({a})", "etätyöntekijä, {a}", "{b}, Finland", "Nurmes", "{c}, Kempele, {c}", "{a}, {b}, {c}", "{b}, {c} / Hybridi", "Kuopio, Finland",
]
_WORD = "[A-Za-zÅÄÖåäö]+"
_TOWNS = f"""(select job_id, n_chars, coalesce(w[1], '') as a, coalesce(w[2], '') as b, coalesce(w[3], '') as c from (select job_id, n_chars, regexp_extract_all(title, '{_WORD}') as w from job) as worded) as towns"""
_PLACED = f"select job_id, {_sql_filled(_sql_chosen(_LOCATIONS), a='a', b='b', c='c')} as location from {_TOWNS}"
_REMOTE = f"""(not ({_any('low', fixed.WEAK_REMOTE)} or contains(low, '/ hybridi')) and trim(low) <> '' and (trim(trim(low), '.') in ({', '.join(repr(x) for x in fixed.WHOLLY_REMOTE)}) or contains(low, '/ etä') or ends_with(low, ' etä')
  or regexp_matches(low, '(^|[^a-zåäö])etätyö([^a-zåäö]|$)|(^|[^a-z])fully remote([^a-z]|$)|(^|[^a-z])100\\s*%\\s*remote([^a-z]|$)|(^|[^a-zåäö])täysin etänä([^a-zåäö]|$)')))"""
# First the location up to its mode, then its parts with the country, vague ones left out.
_CUT = "trim(case when contains(low, '/ etä') then rtrim(trim(substr(loc, 1, strpos(low, '/ etä') - 1)), ',') when contains(low, '/ hybridi') then rtrim(trim(substr(loc, 1, strpos(low, '/ hybridi') - 1)), ',') else loc end)"
_PLACES = f"""d as (select job_id, location, coalesce(location, '') as loc, lower(coalesce(location, '')) as low from ({_PLACED})),
  q as (select *, case when lower({_CUT}) in ('suomi', 'finland', 'fi') then [] else list_transform(list_filter(list_transform(string_split({_CUT}, ','), lambda x: trim(x)),
    lambda x: x <> '' and lower(x) not in ('suomi', 'finland', 'fi') and not ((contains(low, '/ etä') or ends_with(low, ' etä')) and lower(x) in ('etä', 'eta', 'remote'))),
    lambda x: case when contains(lower(x), 'finland') or contains(lower(x), 'suomi') then x else x || ', Finland' end) end as every, {_REMOTE} as remote from d),
  p as (select *, list_filter(every, lambda x, i: list_position(every, x) = i) as places from q)"""


def _towns(t: Tables) -> DataFrame:
    words = F.regexp_extract_all("title", F.lit(_WORD), F.lit(0))
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias("abc"[i])
    return t.job.select("job_id", "n_chars", word(0), word(1), word(2))


def _placed(t: Tables) -> DataFrame:
    """Listings with a location that is written in one of many ways around words of their own."""
    return _towns(t).select("job_id", _filled(_chosen(_LOCATIONS), a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("location"))


@query(f"with {_PLACES} select job_id, remote as full_remote from p")
def full_remote_flag(t: Tables) -> DataFrame:
    return _placed(t).select("job_id", P.full_remote(F.col("location")).alias("full_remote"))


@query(f"with {_PLACES} select job_id, array_to_string(places, '|') as places from p")
def destinations(t: Tables) -> DataFrame:
    return _placed(t).select("job_id", F.array_join(P.destinations(F.col("location")), "|").alias("places"))


@query(f"""with {_PLACES} select job_id, case when contains(low, '/ etä') or ends_with(low, ' etä') then 'remote' when contains(low, '/ hybridi') then 'hybrid' end as mode, nullif(trim(split_part(split_part(location, '/', 1), ',', 1)), '') as label,
  coalesce(nullif(trim(regexp_replace(places[1], ', Finland$', '')), ''), nullif(trim(split_part(split_part(location, '/', 1), ',', 1)), '')) as by_destination from p""")
def location_labels(t: Tables) -> DataFrame:
    place = F.col("location")
    return _placed(t).select("job_id", P.work_mode_of(place).alias("mode"), P.display_label(place).alias("label"), P.display_label(place, F.get(P.destinations(place), F.lit(0))).alias("by_destination"))


@query("""with s as (select doc_id, location, ([null, 'Etä', 'Hybridi'])[(n_chars % 3) + 1] as suffix from (select doc_id, n_chars, case when doc_id % 8 <> 0 then location end as location from listing))
  select doc_id, case when suffix is null then nullif(trim(regexp_replace(coalesce(location, ''), '\\s+', ' ', 'g')), '') when coalesce(trim(location), '') = '' then suffix when contains(lower(location), lower(suffix)) then trim(regexp_replace(location, '\\s+', ' ', 'g')) else trim(regexp_replace(location, '\\s+', ' ', 'g')) || ' / ' || suffix end as location from s""")
def work_mode_suffix(t: Tables) -> DataFrame:
    location = F.when(F.col("doc_id") % 8 != 0, F.col("location"))
    return t.listing.select("doc_id", T.with_work_mode(location, _chosen([None, "Etä", "Hybridi"])).alias("location"))


_ADDRESSES = ["Jalkatie 2, {a}, Finland", "{a}", "{b} 1, 90100", "{c}, Finland", " , {b}"]


@query(f"""with {_PLACES}, a as (select job_id, list_filter(list_transform(string_split({_sql_filled(_sql_chosen(_ADDRESSES, 'job_id'), a='a', b='b', c='c')}, ','), lambda x: trim(x)), lambda x: x <> '') as parts from {_TOWNS})
  select job_id, coalesce(trim(split_part(split_part(low, '/', 1), ',', 1)) = 'oulu' and location is not null, false) as home, list_contains(places, 'Oulu, Finland') as has_home,
    coalesce(list_filter(parts, lambda x: not regexp_matches(x, '[0-9]'))[1], parts[1]) as origin from p join a using (job_id)""")
def home_city_flags(t: Tables) -> DataFrame:
    place = F.col("location")
    words = {x: F.col(x) for x in "abc"}
    rows = _towns(t).select("job_id", _filled(_chosen(_LOCATIONS), **words).alias("location"), _filled(_chosen(_ADDRESSES, "job_id"), **words).alias("address"))
    home, inside = F.coalesce(P.city_name(place) == "oulu", F.lit(False)), F.array_contains(P.destinations(place), P.destination(F.lit("Oulu")))
    return rows.select("job_id", home.alias("home"), inside.alias("has_home"), P.origin_city(F.col("address")).alias("origin"))


_ROUTES = "(values ('Oulu, Finland', 600, 8.0), ('Ylivieska, Finland', 5400, 130.0), ('Kuopio, Finland', 14400, 290.0), ('Helsinki, Finland', 21600, 610.0), ('Kempele, Finland', 1500, 12.0), ('Kuopio, Suomi', 7200, 290.0)) as r(destination, duration_s, km)"


# Towns with a route and those whose look-up failed: a town's distance is the length of the shortest text that starts with it.
_ROADS = f"""met as (select a || ', Finland' as destination, (min(n_chars) % 300 * 60)::bigint as duration_s, min(job_id) as met from {_TOWNS} where a <> '' group by a),
  roads as (select destination, duration_s from met where met % 4 <> 0 union all select destination, duration_s from {_ROUTES}),
  lost as (select destination from met where met % 8 = 0 union all select 'Nurmes, Finland'),
  e as (select job_id, unnest(places) as destination, generate_subscripts(places, 1) as pos from p),
  near as (select e.job_id, destination, duration_s from e join roads using (destination) qualify row_number() over (partition by job_id order by duration_s, pos) = 1)"""


def _roads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Routes (destination, duration_s, km) to towns, and destination of failed look-ups, from the listings themselves."""
    met = _towns(t).where("a <> ''").groupBy("a").agg(F.min("n_chars").alias("n"), F.min("job_id").alias("met"))
    met = met.select(F.concat("a", F.lit(", Finland")).alias("destination"), (F.col("n") % 300 * 60).cast("long").alias("duration_s"), "met")
    known = met.where("met % 4 <> 0").select("destination", "duration_s", F.lit(1.0).alias("km")).union(flagship.routes(t))
    return known, met.where("met % 8 = 0").select("destination").union(t.spark.createDataFrame([("Nurmes, Finland",)], "destination string"))


@query(f"with {_PLACES}, {_ROADS} select job_id, destination, duration_s from near")
def best_route(t: Tables) -> DataFrame:
    return ranking.best_routes(_placed(t), _roads(t)[0]).select("job_id", "destination", "duration_s")


@query(f"""with {_PLACES}, {_ROADS}, b as (select job_id, duration_s as s from near), f as (select distinct job_id from e join lost using (destination)),
  k as (select p.job_id, remote, s, case when location is not null and trim(split_part(split_part(low, '/', 1), ',', 1)) = 'oulu' then 'exact_home_city' when list_contains(places, 'Oulu, Finland') then 'contains_home_city' when remote then 'full_remote'
    when len(places) = 0 then 'vague' when s is null and f.job_id is not null then 'transit_unrouteable' when s is null then 'transit_unknown' when s <= 7200 then 'transit_within_limit' when contains(low, '/ hybridi') then 'transit_over_limit_hybrid' else 'transit_over_limit' end as reason
    from p left join b using (job_id) left join f using (job_id))
  select job_id, case reason when 'contains_home_city' then 'exact_home_city' when 'transit_unrouteable' then 'unrouteable' when 'transit_unknown' then 'unknown' when 'transit_within_limit' then 'within_limit' when 'transit_over_limit_hybrid' then 'hybrid' when 'transit_over_limit' then 'over_limit' else reason end as status, reason,
    case when reason in ('exact_home_city', 'contains_home_city') then 12 when reason = 'full_remote' then 15 when reason in ('vague', 'transit_unrouteable', 'transit_unknown') then -5 when reason = 'transit_within_limit' then case when s <= 2700 then 10 when s <= 5400 then 6 else 3 end when reason = 'transit_over_limit_hybrid' then -8 else -15 end as adjustment,
    reason in ('exact_home_city', 'contains_home_city', 'transit_within_limit') as commutable, remote and reason in ('exact_home_city', 'contains_home_city', 'full_remote') as full_remote, case when reason in ('transit_within_limit', 'transit_over_limit', 'transit_over_limit_hybrid') then s end as duration_s from k""")
def travel_assessment(t: Tables) -> DataFrame:
    routes, failed = _roads(t)
    return ranking.travel_scores(_placed(t), routes, "Oulu", 120, "Jalkatie 2, Oulu, Finland", failed).drop("km")


# --- addresses -------------------------------------------------------------------------------------------------

#: Ways in which an address goes wrong or stays right: {u} is a page's address, {s}, {h}, {H} and {p} its scheme, host, host
#: in capitals and rest, {ip} an address in numbers that follows from the row, {l} as many letters as make it too long or not.
_URLS = [
    None, "  ", "javascript:{h}", "{s}://user:pw@{h}{p}", "{s}://localhost{p}", "{s}://{ip}{p}", "{s}://a.{h}.internal{p}", "{s}:///{h}", "{s}://{h} x{p}", "{s}://{h}:99999{p}", "ftp://{h}{p}", "{s}://{h}{p}/", " {s}://{H}.{p} ", "{s}://evil-{h}{p}",
    "{s}://{h}:8080{p}", "{s}://[::1]{p}", "{s}://{ip}:8080{p}", "{s}://{ip}.{p}", "{s}://{h}?x={p}", "{s}://-bad.{h}{p}", "{s}://{h}/\t{p}", "data:text/html,{h}", "{s}://{h}/{l}", "{u}", "\t{u}\n", "{s}://@{h}:{p}", "{s}://[2600::1]{p}", "{s}://[fe80::1]:x{p}",
    "{s}://[{h}{p}", "{u}", "{s}://{ip}{p}",
]
_FIRSTS, _SECONDS, _THIRDS = ["10", "127", "0", "169", "172", "192", "198", "203", "100", "8", "224", "240"], ["0", "16", "31", "32", "64", "127", "128", "168", "18", "20", "51", "254", "1"], ["0", "2", "100", "113", "7"]
_IP = f"concat_ws('.', {_sql_chosen(_FIRSTS, 'page_id')}, {_sql_chosen(_SECONDS, 'length(url)')}, {_sql_chosen(_THIRDS, '(page_id // 3)')}, length(url) % 256)"
_SPACE = " \t\n\r"
_PARTED = "select page_id, url, regexp_extract(url, '^([a-z]+)://([^/?#]*)(.*)$', 1) as s, regexp_extract(url, '^([a-z]+)://([^/?#]*)(.*)$', 2) as h, regexp_extract(url, '^([a-z]+)://([^/?#]*)(.*)$', 3) as p from pages"
_MADE = _sql_filled(_sql_chosen(_URLS, "page_id"), u="url", s="s", h="h", H="upper(h)", p="p", ip=_IP, l="repeat('x', (2000 + page_id % 40)::int)")
_OCTETS = """(o[1] in (0, 10, 127) or o[1] = 100 and o[2] between 64 and 127 or o[1] = 169 and o[2] = 254 or o[1] = 172 and o[2] between 16 and 31 or o[1] = 192 and (o[2] = 168 or o[2] = 0 and o[3] in (0, 2))
    or o[1] = 198 and (o[2] in (18, 19) or o[2] = 51 and o[3] = 100) or o[1] = 203 and o[2] = 0 and o[3] = 113 or o[1] >= 240)"""
# The rules of addresses, stated on their parts: first the place behind the user, then host and port, then the host's labels.
_JUDGED = rf"""cut as (select page_id, trim({_MADE}, '{_SPACE}') as u from ({_PARTED}) as parted),
  net as (select *, regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) as net, string_split(net, '@')[-1] as place, left(net, length(net) - length(place)) as login, contains(net, '[') <> contains(net, ']') as unclosed from cut),
  hosted as (select *, rtrim(lower(case when starts_with(place, '[') then split_part(substr(place, 2), ']', 1) else split_part(place, ':', 1) end), '.') as host, string_split(host, '.') as labels,
    case when starts_with(place, '[') then substr(split_part(place, ']', 2), 2) when contains(place, ':') then substr(place, strpos(place, ':') + 1) else '' end as port,
    '/' || regexp_extract(substr(u, strpos(u, ':') + 3 + length(net)), '^/?([^?#]*)', 1) as path from net),
  shaped as (select *, case when regexp_full_match(host, '\d+\.\d+\.\d+\.\d+') then list_transform(labels, lambda x: try_cast(x as int)) end as o, len(list_filter(labels, lambda x: not regexp_full_match(x, '[a-z0-9]([a-z0-9-]*[a-z0-9])?'))) as odd from hosted),
  judged as (select *, case when coalesce(u, '') = '' then 'missing' when length(u) > 2048 then 'too_long' when regexp_matches(u, '[\x00-\x1f\x7f]') then 'control_characters' when unclosed or not regexp_full_match(port, '\d*') or coalesce(try_cast(port as int), 0) > 65535 then 'malformed'
      when lower(split_part(u, ':', 1)) not in ('http', 'https') then 'non_http_scheme' when login not in ('', '@', ':@') then 'embedded_credentials' when host = '' then 'malformed'
      when labels[-1] in ('localhost', 'local', 'internal', 'localdomain') and (len(labels) > 1 or host = 'localhost') or coalesce({_OCTETS}, false) or contains(host, ':') and (host in ('::', '::1') or regexp_matches(host, '^(fc|fd|fe8|fe9|fea|feb|2001:db8|::ffff:)')) then 'private_host'
      when odd > 0 then 'malformed' end as reason from shaped)"""


def _addresses(t: Tables) -> DataFrame:
    """Pages with their addresses, most of them spoilt in one way or another."""
    part = lambda i: F.regexp_extract("url", "^([a-z]+)://([^/?#]*)(.*)$", i)
    rows = t.pages.select("page_id", "url", part(1).alias("s"), part(2).alias("h"), part(3).alias("p"), F.length("url").alias("n"), F.expr("page_id div 3").alias("k"))
    ip = F.concat_ws(".", _chosen(_FIRSTS, "page_id"), _chosen(_SECONDS, "n"), _chosen(_THIRDS, "k"), (F.col("n") % 256).cast("string"))
    made = _filled(_chosen(_URLS, "page_id"), u=F.col("url"), s=F.col("s"), h=F.col("h"), H=F.upper("h"), p=F.col("p"), ip=ip, l=F.repeat(F.lit("x"), (2000 + F.col("page_id") % 40).cast("int")))
    # A row each: the addresses are made before the rules read them many times.
    return rows.select("page_id", F.explode(F.array(made)).alias("url"))


@query(rf"""with {_JUDGED}, ruled as (select *, page_id % 5 as k, case when k = 0 then host = 'example.org' or ends_with(host, '.example.org') when k = 1 then host = 'example.net' or ends_with(host, '.example.net') else k = 2 end as own,
    case when k = 0 then path in ('/de', '/fr/1') or starts_with(path, '/de/') or starts_with(path, '/fr/1') when k = 1 then starts_with(path, '/e') else true end as below from judged)
  select page_id, case when k = 4 then 'unknown_source' else coalesce(reason, case when not own then 'unexpected_host' when not below then 'unexpected_path' end, 'ok') end as reason from ruled""")
def url_policy(t: Tables) -> DataFrame:
    """Pages' addresses by the policies of their sources: some hosts and paths, every host, no host, no policy."""
    policies = t.spark.createDataFrame([(0, ["example.org"], ["/de/", "/fr/1"]), (1, [".Example.net"], ["e"]), (2, None, None), (3, [], None)], "source_id long, hosts array<string>, paths array<string>")
    rows = _addresses(t).withColumn("source_id", F.col("page_id") % 5).join(F.broadcast(policies.withColumn("known", F.lit(True))), "source_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown_source").otherwise(F.coalesce(links.rejection(F.col("url"), F.col("hosts"), F.col("paths")), F.lit("ok")))
    return rows.select("page_id", reason.alias("reason"))


@query(f"with {_JUDGED} select page_id, coalesce(reason, 'ok') as problem from judged")
def url_problems(t: Tables) -> DataFrame:
    return _addresses(t).select("page_id", F.coalesce(links.rejection(F.col("url")), F.lit("ok")).alias("problem"))


@query(f"with {_JUDGED} select page_id, case when reason is null then nullif(rtrim(u, '/'), '') end as link from judged")
def link_normalize(t: Tables) -> DataFrame:
    return _addresses(t).select("page_id", links.safe_link(F.col("url")).alias("link"))


# --- identities ------------------------------------------------------------------------------------------------


@query("select doc_id, sha256(to_json({'description': description, 'employer': employer, 'location': case when doc_id % 5 <> 0 then location end, 'title': title})) as hash from listing")
def content_hash(t: Tables) -> DataFrame:
    place = F.when(F.col("doc_id") % 5 != 0, F.col("location"))
    return t.listing.select("doc_id", L.identity(title=F.col("title"), employer=F.col("employer"), location=place, description=F.col("description")).alias("hash"))


@query("select doc_id, sha256(to_json({'employer': employer, 'n_chars': n_chars, 'title': title})) as identity from listing")
def request_identity(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", L.identity(title=F.col("title"), employer=F.col("employer"), n_chars=F.col("n_chars")).alias("identity"))


# --- scores ----------------------------------------------------------------------------------------------------

_FIELDS = ["history_title", "history_keyword", "learned_title", "learned_keyword", "keyword", "title", "keyword", "title", "sector"]


def _terms(t: Tables) -> DataFrame:
    own = t.profile_term.select("profile_id", F.get(F.array(*map(F.lit, _FIELDS)), F.length("term") % len(_FIELDS)).alias("field"), "term")
    who = t.profile_term.select("profile_id").distinct()
    towns = [who.select("profile_id", F.lit("location").alias("field"), F.lit("oulu").alias("term")), who.where("profile_id % 2 = 0").select("profile_id", F.lit("history_location"), F.lit("kuopio")), who.where("profile_id % 3 = 0").select("profile_id", F.lit("learned_location"), F.lit("helsinki"))]
    return own.union(towns[0]).union(towns[1]).union(towns[2])


_VARIANTS = "select {0}, v0 as base, v0 as variant from {1} union select {0}, v0, substr(v0, 1, length(v0) - length(e)) from (select *, unnest(" + _ENDS + ") as e from {1}) where length(v0) >= 7 and ends_with(v0, e) and length(v0) - length(e) >= 5"
_FIELD_HITS = f"""who as (select distinct profile_id from profile_term),
  ft as (select profile_id, {_sql_chosen(_FIELDS, 'length(term)')} as field, term as v0 from profile_term where term not in ('{"','".join(fixed.GENERIC_TERMS)}')
    union all select profile_id, 'location', 'oulu' from who union all select profile_id, 'history_location', 'kuopio' from who where profile_id % 2 = 0 union all select profile_id, 'learned_location', 'helsinki' from who where profile_id % 3 = 0),
  fv as ({_VARIANTS.format('profile_id, field', 'ft')}),
  jt as (select distinct job_id, 'text' as place, unnest({_TOKENS.format("concat_ws(' ', title, employer, description)")}) as v0 from job union select job_id, 'title', unnest({_TOKENS.format('title')}) from job union select job_id, 'location', unnest({_TOKENS.format('location')}) from job),
  jv as ({_VARIANTS.format('job_id, place', 'jt')}),
  hits as (select distinct job_id, profile_id, field, fv.base as term from jv join fv on jv.variant = fv.variant and jv.place = case when field in ('title', 'history_title', 'learned_title') then 'title' when field in ('location', 'history_location', 'learned_location') then 'location' else 'text' end),
  c as (select job_id, profile_id, """ + ", ".join(f"count(*) filter (where field = '{f}') as {f}_n" for f in [*scoring.POINTS, *scoring.LOCATIONS]) + " from hits group by all)"
_SCORED_JOBS = _FIELD_HITS + """, f as (select c.*, c.job_id % 10 <> 3 as has_location, c.job_id % 7 = 1 as negative, c.job_id % 11 = 2 as missing, c.job_id % 5 = 0 as caution, 8 * (c.job_id % 3) as penalty, c.job_id % 13 = 4 as language_failed, c.job_id % 4 = 1 as language_review, c.job_id % 17 = 5 as rejected from c),
  s as (select *, least(title_n, 5) * 15 + least(keyword_n, 8) * 5 + least(history_title_n, 4) * 18 + least(history_keyword_n, 6) * 5 + least(sector_n, 3) * 4 + least(learned_title_n, 4) * 18 + least(learned_keyword_n, 6) * 5
    + case when location_n > 0 then 15 when not has_location then 3 else 0 end + case when history_location_n > 0 then 7 else 0 end + case when learned_location_n > 0 then 7 else 0 end - case when negative or missing then 40 else 0 end as whole from f),
  scored as (select *, greatest(0.0, least(100.0, whole - penalty))::double as score, greatest(0.0, least(100.0, whole))::double as unpenalized, greatest(0, least(100, whole)) >= 15 and not (negative or missing or language_failed or rejected) as passes, not (negative or missing or language_failed or rejected) as hard_eligible,
    history_title_n + history_keyword_n > 0 as history, sector_n > 0 and (keyword_n > 0 or history_title_n + history_keyword_n > 0) as sector, title_n = 0 and keyword_n >= 2 as duty from s)"""
_LANES = "array_to_string(list_filter([case when title_n > 0 then 'direct_title' end, case when history then 'application_history' end, case when duty then 'transferable_duty' end, case when sector then 'sector_context' end, case when title_n = 0 and (history or duty or sector) then 'exploration' end], lambda x: x is not null), ',')"
_SAID_OF = {"negative": "negative", "missing": "missing", "caution": "caution", "qualification": "false", "language": "language_review", "location": "has_location and location_n = 0"}


def _scored(t: Tables) -> DataFrame:
    counted = scoring.match_scores(scoring.term_matches(t.job, _terms(t)))
    k = F.col("job_id")
    facts = counted.select("job_id", "profile_id").withColumns({
        "has_location": k % 10 != 3, "negative_n": (k % 7 == 1).cast("int"), "missing_n": (k % 11 == 2).cast("int"), "caution_n": (k % 5 == 0).cast("int"), "exclusion_penalty": (k % 3) * 8, "language_failed": k % 13 == 4,
        "language_review": k % 4 == 1, "qualification_reject": k % 17 == 5, "qualification_caution": F.lit(None).cast("boolean")})
    return scoring.deterministic_scores(counted, facts)


@query(f"""with {_SCORED_JOBS} select job_id, profile_id, score, unpenalized, passes, hard_eligible, {_LANES} as lanes, array_to_string(list_filter([case when negative then 'negative_match' end, case when missing then 'missing_qualification' end, case when language_failed then 'language_requirement' end, case when rejected then 'qualification' end], lambda x: x is not null), ',') as reasons,
  array_to_string(list_filter([{', '.join(f"case when {test} then '{fixed.CONCERNS[c]}' end" for c, test in _SAID_OF.items())}], lambda x: x is not null), '|') as concerns from scored""")
def deterministic_score(t: Tables) -> DataFrame:
    return _scored(t).select("job_id", "profile_id", "score", "unpenalized", "passes", "hard_eligible", F.array_join("lanes", ",").alias("lanes"), F.array_join("hard_reasons", ",").alias("reasons"), F.array_join("concerns", "|").alias("concerns"))


_EXCLUDED = [(0, "term", "the hand and"), (0, "employer", "EMP1"), (1, "term", "rith"), (1, "sector", "of the"), (2, "employer", "emp2"), (2, "sector", "Erti"), (2, "term", "er")]


@query("""with x as (select r.job_id, r.profile_id, lower(concat_ws(' ', j.title, j.employer, j.description)) as txt, lower(coalesce(j.employer, '')) as emp from rec r join job j using (job_id)),
  e as (select unnest([0, 0, 1, 1, 2, 2]) as profile_id, unnest(['term', 'employer', 'term', 'sector', 'employer', 'sector']) as kind, unnest(['hand', 'emp1', 'rith', 'of the', 'emp2', 'erti']) as v),
  h as (select x.job_id, x.profile_id, e.v from x join e on x.profile_id = e.profile_id and case when kind = 'employer' then contains(emp, v) else contains(txt, v) end)
  select job_id, profile_id, (count(*) * 8)::double as exclusion_penalty, string_agg(distinct v, ',' order by v) as matches from h group by all""")
def exclusion_penalty(t: Tables) -> DataFrame:
    learned = t.spark.createDataFrame(_EXCLUDED, "profile_id long, kind string, value string")
    found = scoring.exclusion_matches(t.rec.select("job_id", "profile_id"), t.job, learned)
    return found.select("job_id", "profile_id", "exclusion_penalty", F.array_join("matches", ",").alias("matches"))


_VECTOR = "(n_chars % 101)::double / 101.0::double"


@query(f"""with b as (select r.job_id, r.profile_id, r.machine_score::double as score, n_chars, job_id % 3 as title_n, job_id % 7 = 1 as negative, job_id % 8 <> 2 as hard_eligible, job_id % 5 = 0 as passed, job_id % 4 = 0 as exploring,
    case when job_id % 6 <> 5 then {_VECTOR} end as v0, case when job_id % 2 = 0 then 0.8::double end as liked, case when job_id % 3 = 0 then 0.9::double end as disliked from rec r join documents d on d.doc_id = r.job_id),
  a as (select *, v0 + coalesce(liked * 0.15::double, 0) as v1 from b),
  e as (select *, exploring or (greatest(0.0, least(1.0, v1)) >= 0.56 and title_n = 0) as exploration from a),
  s as (select *, greatest(0.0, least(1.0, v1 - case when exploration then 0 else coalesce(disliked * 0.20::double, 0) end)) as v from e where v0 is not null),
  m as (select e.job_id, e.profile_id, e.score, e.passed, e.hard_eligible, e.negative, e.exploring, e.title_n, s.v from e left join s on s.job_id = e.job_id and s.profile_id = e.profile_id)
  select job_id, profile_id, case when v is null then score else greatest(score, round(15 + v * 20, 2)) end as score, case when v is null then score + 2 else round(greatest(score + 2, score, round(15 + v * 20, 2)), 2) end as unpenalized, round(v, 4) as vector_score,
    case when v is null then passed else hard_eligible and (passed or (v >= 0.56 and not negative)) end as passes, coalesce(v >= 0.56, false) as semantic, exploring or coalesce(v >= 0.56 and title_n = 0, false) as exploration from m""")
def semantic_merge(t: Tables) -> DataFrame:
    k = F.col("job_id")
    lanes = F.when(k % 4 == 0, F.array(F.lit("exploration"))).otherwise(F.array().cast("array<string>"))
    rows = t.rec.join(t.documents.select(F.col("doc_id").alias("job_id"), "n_chars"), "job_id")
    scored = rows.select(
        "job_id", "profile_id", (k % 3).alias("title_n"), (k % 7 == 1).cast("int").alias("negative_n"), F.lit(0).alias("missing_n"), F.col("machine_score").cast("double").alias("score"), (F.col("machine_score") + 2).alias("unpenalized"), lanes.alias("lanes"), (k % 5 == 0).alias("passes"), (k % 8 != 2).alias("hard_eligible"))
    similar = rows.where("job_id % 6 <> 5").select("job_id", "profile_id", ((F.col("n_chars") % 101) / 101.0).alias("vector"), F.when(k % 2 == 0, 0.8).alias("preference"), F.when(k % 3 == 0, 0.9).alias("anti"))
    has = lambda lane: F.array_contains("lanes", lane)
    return ranking.semantic_merge(scored, similar).select("job_id", "profile_id", "score", "unpenalized", "vector_score", "passes", has("semantic_similarity").alias("semantic"), has("exploration").alias("exploration"))


# --- learning --------------------------------------------------------------------------------------------------


@query(f"""with r as (select feedback_id, unnest({_TOKENS.format("concat_ws(' ', title, employer)")}) as term from feedback join job using (job_id)), n as (select count(*) as n from feedback)
  select term, count(distinct feedback_id) as jobs from r group by term, (select n from n) having count(distinct feedback_id) / (select n from n) <= 0.30 and term not in ('{"','".join(fixed.GENERIC_TERMS)}')""")
def df_cap(t: Tables) -> DataFrame:
    total = t.feedback.agg(F.count("*").alias("total"))
    jobs = t.job.select("job_id", F.explode(T.tokens(F.concat_ws(" ", "title", "employer"))).alias("term"))
    n = t.feedback.select("feedback_id", "job_id").join(jobs, "job_id").groupBy("term").agg(F.count_distinct("feedback_id").alias("jobs"))
    # One row: how much feedback there is.
    return scoring.rare_terms(n.crossJoin(F.broadcast(total)), F.col("total")).select("term", "jobs")


@query(f"""with a as (select doc_id as id, unnest(['the', 'emp' || (n_chars % 37), 'nowhere']) as term, unnest([0.5, -1.0, 2.0]) as weight, ([ 'high', 'medium', 'low', 'odd'])[(doc_id % 4) + 1] as confidence, case when n_chars % 2 = 0 then 1 else -1 end as sign from documents),
  x as (select doc_id as id, ' ' || {_NORM.format("concat_ws(' ', title, employer)")} || ' ' as txt from listing)
  select id, term, sum(weight * case confidence when 'high' then 1.0 when 'medium' then 0.6 else 0.2 end)::double as delta from a join x using (id) where contains(txt, ' ' || term || ' ') and sign(weight) = sign(sign) group by all""")
def analysis_terms(t: Tables) -> DataFrame:
    terms = F.arrays_zip(F.array(F.lit("the"), F.concat(F.lit("emp"), (F.col("n_chars") % 37).cast("string")), F.lit("nowhere")).alias("term"), F.array(F.lit(0.5), F.lit(-1.0), F.lit(2.0)).alias("weight"))
    rows = t.listing.select(F.col("doc_id").alias("id"), F.explode(terms).alias("x"), _chosen(["high", "medium", "low", "odd"], "doc_id").alias("confidence"), F.when(F.col("n_chars") % 2 == 0, 1).otherwise(-1).alias("sign"))
    known = t.listing.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "title", "employer").alias("text"))
    return scoring.analysis_terms(rows.select("id", F.col("x.term").alias("term"), F.col("x.weight").alias("weight"), "confidence", "sign"), known)


# --- categories and publication --------------------------------------------------------------------------------

_HEADS = ["Kirjastonhoitaja", "Hallintopäällikkö", "Viulu-yhtye", "Asiakaspalvelu tiskillä", "Museo tänään", "Koordinaattori", "Myyjä", "Avoin tiede", "Tutkija"]
_FIRMS = [None, "Kirja Oy", "Nuoriso ry", "Hallinto Ab", "Firma", "Tuotanto-yhtiö", "Tietopalvelu"]
_TITLED = [None, "kirjasto", "hallinto", "viulu", "muu"]
_WORDED = [None, "opastus", "museo", "koordinaattori", "tiedekirjasto", "nuotti", "muu"]


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in terms) + "]"


_STRONG = [x for x in fixed.LEADERSHIP_TERMS if x != "koordinaattori"]
_RUNG = "list_has_any(list_concat(shown, tm, km), {})"


@query(f"""with b as (select job_id, {_sql_chosen(_HEADS, 'job_id')} || ' ' || title as title, concat_ws(' ', {_sql_chosen(_FIRMS)}, employer) as employer, case when {_sql_chosen(_TITLED)} is null then [] else [{_sql_chosen(_TITLED)}] end as tm, case when {_sql_chosen(_WORDED, 'job_id')} is null then [] else [{_sql_chosen(_WORDED, 'job_id')}] end as km, n_chars % 3 = 0 as hidden from job),
  s as (select *, lower(title) as low, string_split_regex(replace(lower(concat_ws(' ', title, employer)), '-', ' '), '\\s+') as shown from b)
  select job_id, hidden, case when {_any('low', fixed.LIBRARY_TERMS)} or list_has_any(tm, {_list(fixed.LIBRARY_TERMS)}) then '{fixed.CATEGORIES['library']}' when {_any('low', _STRONG)} or list_has_any(tm, {_list(_STRONG)}) then '{fixed.CATEGORIES['leadership']}'
    when {_RUNG.format(_list(fixed.MUSIC_TERMS))} then '{fixed.CATEGORIES['music']}' when {_RUNG.format(_list(fixed.GUIDANCE_TERMS))} then '{fixed.CATEGORIES['guidance']}' when {_RUNG.format(_list(fixed.CULTURE_TERMS))} then '{fixed.CATEGORIES['culture']}'
    when {_RUNG.format(_list(fixed.LEADERSHIP_TERMS))} then '{fixed.CATEGORIES['leadership']}' when {_RUNG.format(_list(fixed.LIBRARY_TERMS))} then '{fixed.CATEGORIES['library']}' when hidden then '{fixed.CATEGORIES['hidden']}' else '{fixed.CATEGORIES['other']}' end as category from s""")
def category_case(t: Tables) -> DataFrame:
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    title, employer = F.concat(_chosen(_HEADS, "job_id"), F.lit(" "), "title"), F.concat_ws(" ", _chosen(_FIRMS), "employer")
    made = L.category(title, employer, one(_chosen(_TITLED)), one(_chosen(_WORDED, "job_id")), F.lit(None).cast("array<string>"), F.col("n_chars") % 3 == 0)
    return t.job.select("job_id", made.alias("c")).select("job_id", "c.category", "c.hidden")


@query("""select rec_id, case when machine_score >= 60 then 'hosted' when action = 'skip' or case when commutable then '' when remote then ' ' else coalesce(trim(lane), '') end in ('', ' ') then 'deterministic_only' else 'unavailable' end as mode from rec""")
def publication_mode(t: Tables) -> DataFrame:
    """A provider is ready for good scores, forbidden for what is skipped and unknown for the undecided; its name is the lane."""
    provider = F.when(F.col("remote"), " ").when(~F.col("commutable"), F.col("lane"))
    allowed = F.when(F.col("action") != "consider", F.col("action") == "apply")
    return t.rec.select("rec_id", L.publication_mode(F.col("machine_score") >= 60, allowed, provider).alias("mode"))


_REC = """select rec_id, profile_id, job_id, action, review_score, ([null, 'strong', 'generic_customer_service_only', 'not_applicable', 'fair', 'strong'])[(rec_id % 6) + 1] as tier, case when rec_id % 9 <> 8 then not hard_rejected end as hard_eligible,
  case when rec_id % 7 = 0 then true when rec_id % 7 = 1 then false end as awaiting_refresh, case when rec_id % 5 = 0 then false when rec_id % 5 = 1 then true end as compatible, case when rec_id % 4 <> 0 then rec_id end as evaluation_id from rec"""


@query(f"""with r as ({_REC}), h as (select job_id, profile_id, bool_or(rating <= 1) as hidden from feedback group by all)
  select rec_id, r.profile_id from r left join h on h.job_id = r.job_id and h.profile_id = r.profile_id where not (coalesce(action, '') = 'skip' or coalesce(review_score < 40, false) or coalesce(tier, '') in ('generic_customer_service_only', 'not_applicable') or coalesce(not hard_eligible, false)
    or (coalesce(awaiting_refresh, false) and coalesce(not compatible, false)) or evaluation_id is null or coalesce(hidden, false))""")
def publication_gate(t: Tables) -> DataFrame:
    k = F.col("rec_id")
    hidden = t.feedback.groupBy("job_id", "profile_id").agg(F.bool_or(F.col("rating") <= 1).alias("hidden"))
    rows = t.rec.withColumns({
        "tier": _chosen([None, "strong", "generic_customer_service_only", "not_applicable", "fair", "strong"], "rec_id"), "hard_eligible": F.when(k % 9 != 8, ~F.col("hard_rejected")), "awaiting_refresh": F.when(k % 7 == 0, True).when(k % 7 == 1, False),
        "compatible": F.when(k % 5 == 0, False).when(k % 5 == 1, True), "evaluation_id": F.when(k % 4 != 0, k)}).join(hidden, ["job_id", "profile_id"], "left")
    return gates.publishable(rows).select("rec_id", "profile_id")


@query("with r as (select rec_id, case when rec_id % 4 <> 3 then machine_score / 100.0 end as disliked, case when rec_id % 5 = 0 then [] when rec_id % 5 <> 1 then ['x'] end as found from rec) select rec_id from r where not coalesce(disliked >= 0.75 and len(found) > 0, false)")
def review_prefilter(t: Tables) -> DataFrame:
    k = F.col("rec_id")
    found = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 != 1, F.array(F.lit("x")))
    return gates.passes_feedback(t.rec.select("rec_id", F.when(k % 4 != 3, F.col("machine_score") / 100.0).alias("anti"), found.alias("exclusion_matches"))).select("rec_id")


@query(f"""with p as (select unnest([0, 1, 1, 2]) as profile_id, unnest(['of the', 'and', 'the hand', '!']) as phrase), s as (select rec_id, job_id, profile_id, case when rec_id % 3 = 0 then 'recent' else 'discovery' end as pool, rec_id % 5 = 0 as before from rec),
  x as (select job_id, ' ' || {_NORM.format("concat_ws(' ', title, employer, description)")} || ' ' as txt from job)
  select s.rec_id, s.before or (pool = 'discovery' and exists (select 1 from p where p.profile_id = s.profile_id and {_NORM.format('phrase')} <> '' and contains(x.txt, ' ' || {_NORM.format('phrase')} || ' '))) as learned from s join x using (job_id)""")
def discovery_lane(t: Tables) -> DataFrame:
    phrases = t.spark.createDataFrame([(0, "of the"), (1, "and"), (1, "The hand"), (2, "!")], "profile_id long, phrase string")
    k = F.col("rec_id")
    lanes = F.when(k % 5 == 0, F.array(F.lit("learned_discovery"))).otherwise(F.array().cast("array<string>"))
    scored = t.rec.select("rec_id", "job_id", "profile_id", F.when(k % 3 == 0, "recent").otherwise("discovery").alias("pool"), lanes.alias("lanes"))
    return gates.learned_discovery(scored, t.job, phrases).select("rec_id", F.array_contains("lanes", "learned_discovery").alias("learned"))


@query("""with u as (select conv_id, turn, ([ 'gemini', 'other', 'other', null])[(turn % 4) + 1] as provider, turn % 4 as kind, length(text) as n from conversations)
  select conv_id, turn, case kind when 0 then n when 1 then n end as input_tokens, case kind when 0 then 7 when 1 then 3 end as output_tokens, case kind when 1 then 5 end as cached_tokens, kind in (0, 1) and n is not null or kind in (0, 1) as usage_present from u""")
def usage_normalize(t: Tables) -> DataFrame:
    """Usage blocks of two shapes, one with nothing of its own shape, and none."""
    n = F.length("text").cast("string")
    block = F.concat(F.lit('{"promptTokenCount": '), n, F.lit(', "candidatesTokenCount": 7, "input_tokens": 1}'))
    other = F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": 3, "input_tokens_details": {"cached_tokens": 5}}'))
    kind = F.col("turn") % 4
    usage = F.when(kind == 0, block).when(kind == 1, other).when(kind == 2, '{"promptTokenCount": 9}')
    rows = t.conversations.select("conv_id", "turn", L.token_usage(_chosen(["gemini", "other", "other", None], "turn"), usage).alias("u"))
    return rows.select("conv_id", "turn", "u.*")


@query("""with r as (select user_id as source_id, event_id, event_id % 7 <> 0 as complete, event_id % 4 = 1 as marked, event_id % 9 = 0 as stopped, event_id % 11 as fetched, case when event_id % 3 = 0 then 8 end as max_urls, case when event_id % 5 = 0 then 2 end as max_pages from events)
  select event_id, complete and not marked and not stopped and fetched > 0 and not coalesce(fetched >= max_urls, false) and max_pages is null as allowed from r""")
def removal_allowed(t: Tables) -> DataFrame:
    k = F.col("event_id")
    runs = t.events.select("event_id", (k % 7 != 0).alias("complete"), F.when(k % 4 == 1, F.col("ts")).alias("watermark"), (k % 9 == 0).alias("stopped"), (k % 11).alias("fetched"), F.when(k % 3 == 0, 8).alias("max_urls"), F.when(k % 5 == 0, 2).alias("max_pages"))
    return runs.select("event_id", gates.removal_permitted(runs).alias("allowed"))


# --- sources ---------------------------------------------------------------------------------------------------


@query("""select doc_id, ([title, 'en ' || title, 'sv ' || title, title, null])[(n_chars % 5) + 1] as title, ([employer, 'en ' || employer, 'xx ' || employer, null])[(doc_id % 4) + 1] as employer, trim(regexp_replace(description, '\\s+', ' ', 'g')) as description from listing""")
def localized_choice(t: Tables) -> DataFrame:
    """Localised payloads to listings: titles prefer fi, en, sv; employers fi, en; then any; null if there is none."""
    say = lambda pairs: F.to_json(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))))
    title, firm = F.col("title"), F.col("employer")
    pick = lambda shapes, by: F.get(F.array(*shapes), (F.col(by) % len(shapes)).cast("int"))
    mark = lambda c, x: F.concat(F.lit(f"{x} "), c)
    titles = pick([say([("sv", mark(title, "sv")), ("fi", title)]), say([("sv", title), ("en", mark(title, "en")), ("fi", F.lit(""))]), say([("xx", title), ("sv", mark(title, "sv"))]), say([("xx", title)]), F.lit("{}")], "n_chars")
    firms = pick([say([("en", firm), ("fi", firm)]), say([("xx", firm), ("en", mark(firm, "en"))]), say([("xx", mark(firm, "xx")), ("sv", firm)]), F.lit("null")], "doc_id")
    read = lambda c: F.from_json(c, "map<string,string>")
    return t.listing.select("doc_id", L.localized(read(titles), "fi", "en", "sv").alias("title"), L.localized(read(firms), "fi", "en").alias("employer"), F.trim(F.regexp_replace("description", r"\s+", " ")).alias("description"))


_SLUGS = ["kaupan-liike-oy", "OULUN-kirja-ab", "seura-RY", "", None]
_REGIONS = {1: "Lappi", 2: "Kainuu", 3: "Pirkanmaa", 4: "Uusimaa"}


@query(f"""with b as (select doc_id, n_chars, title, ['Kaupan Liike Oy', 'Oulun Kirja Ab', 'Seura Ry', null, null][(doc_id % 5) + 1] as employer, n_chars % 7 as k, doc_id % 3 = 0 as flag from listing)
  select doc_id, employer, trim(case when doc_id % 2 = 0 then title || '  & Co' else title end) as title, case k when 0 then 'Oulu' when 1 then 'Lappi, Kainuu' when 2 then 'Suomi' when 3 then 'Pirkanmaa, Lappi' when 4 then 'Suomi' when 5 then 'Uusimaa' else 'Suomi' end || case when flag then ' / Etä' else '' end as location from b""")
def normalize_rendered(t: Tables) -> DataFrame:
    """Rendered pages to listings: title without tags and references, employer from the link's slug, the place from
    the title or from region ids (names of the first three, ten or more are the whole country), a remote flag."""
    from ..sources import landed

    title = F.concat(F.lit("<b>"), "title", F.lit("</b>"), F.when(F.col("doc_id") % 2 == 0, " &amp; Co").otherwise(""))
    slug = _chosen(_SLUGS, "doc_id")
    link = F.when(slug.isNotNull() & (slug != ""), F.concat(F.lit("https://example.org/avoimet-tyopaikat/"), slug, F.lit("/1"))).otherwise("https://example.org/muut/x")
    ids = {0: [4], 1: [1, 2, 2], 2: [1] * 10, 3: [3, 1, 3, 4], 4: [], 5: [4, 99], 6: [99]}
    regions = F.get(F.array(*(F.array(*map(F.lit, v)).cast("array<int>") for v in ids.values())), (F.col("n_chars") % 7).cast("int"))
    names = t.spark.createDataFrame(list(_REGIONS.items()), "region int, name string")
    city = F.when(F.col("n_chars") % 7 == 0, "Oulu")
    rows = t.listing.select("doc_id", title.alias("title"), link.alias("link"), regions.alias("regions"), city.alias("city"), F.when(F.col("doc_id") % 3 == 0, F.lit("Etä")).alias("mode"))
    return landed.rendered_listings(rows, names)


@query("select doc_id, case when k in (0, 1, 3) then title end as title, k in (0, 1, 3) as found from (select doc_id, title, doc_id % 6 as k from listing)")
def html_jsonld(t: Tables) -> DataFrame:
    """The posting in a page's ld+json scripts, whether its type is a text or a list, behind others and odd ones."""
    from ..sources import landed

    body = lambda kind: F.concat(F.lit(f'{{"@type": {kind}, "title": '), F.to_json(F.struct(F.col("title").alias("x"))).substr(6, 100000), F.lit(""))
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    pages = [script(body('"JobPosting"')), F.concat(script(F.lit('{"@type": "Thing"}')), script(body('["Thing", "JobPosting"]'))), script(F.lit('{"@type": "Thing"}')), F.concat(script(F.lit('{"@type": "JobPosting", ')), script(body('"JobPosting"'))), F.lit("<p>none</p>"), script(F.lit("[1]"))]
    rows = t.listing.select("doc_id", landed.linked_data(F.get(F.array(*pages), (F.col("doc_id") % 6).cast("int"))).alias("d"))
    return rows.select("doc_id", F.try_variant_get("d", "$.title", "string").alias("title"), F.col("d").isNotNull().alias("found"))
