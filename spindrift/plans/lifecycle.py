"""Queries of what happens to listings, recommendations, feedback and profiles over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, listing as L, text as T
from ..operators import gates, scoring, upkeep
from ..sources import landed
from .binding import Tables
from .listings import _NORM, _any, discovery_terms
from .registry import query
from .upkeep import _discovery
from .verdicts import _chosen, _sql_chosen

_PAGES = """pg as (select source_id, (doc_id // 40 + 1)::bigint as page, case when (doc_id // 40) % 11 = 5 then 0 else count(*) end as n, (doc_id // 40) % 9 = 7 as last from listing group by source_id, doc_id // 40)"""


@query(f"""with {_PAGES}, w as (select *, min(case when n = 0 then page end) over (partition by source_id) as e, min(case when n < 2 or last then page end) over (partition by source_id) as f,
    coalesce(sum(n) over (partition by source_id order by page rows between unbounded preceding and 1 preceding), 0) as had from pg)
  select source_id, page, n::bigint as n from w where (e is null or page < e) and (f is null or page <= f) and page <= 20 and had < 25""")
def page_prefix(t: Tables) -> DataFrame:
    block = F.expr("doc_id div 40")
    pages = t.listing.groupBy("source_id", block.alias("b")).agg(F.count("*").alias("n"))
    pages = pages.select("source_id", (F.col("b") + 1).alias("page"), F.when(F.col("b") % 11 == 5, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n"), (F.col("b") % 9 == 7).alias("last"))
    return upkeep.page_prefix(pages, 2, 20, 25).select("source_id", "page", "n")


_STATUS = [200, 200, 200, 200, 429, 200, 200, 500, 200, 200, 200]


@query("""with p as (select event_id % 700 as source_id, ([200, 200, 200, 200, 429, 200, 200, 500, 200, 200, 200])[(event_id % 11) + 1] as status, (['slow', null, 'cut', null, 'odd'])[(event_id % 5) + 1] as warning, event_id % 13 = 0 as marked from events)
  select source_id, case when bool_or(status >= 400) then 'partial' when bool_or(marked) then 'delta' else 'full_snapshot' end as outcome, coalesce(string_agg(distinct warning, ',' order by warning), '') as warnings from p group by source_id""")
def fetch_outcome(t: Tables) -> DataFrame:
    k = F.col("event_id")
    pages = t.events.select((k % 700).alias("source_id"), F.get(F.array(*map(F.lit, _STATUS)), (k % 11).cast("int")).alias("status"), _chosen(["slow", None, "cut", None, "odd"], "event_id").alias("warning"), F.when(k % 13 == 0, F.col("ts")).alias("watermark"))
    return upkeep.fetch_outcomes(pages).select("source_id", "outcome", F.array_join("warnings", ",").alias("warnings"))


@query("""with r as (select n_chars % 400 as id, doc_id as seq, title, case when doc_id % 3 = 0 then 1 else 0 end as search from listing)
  select id, arg_max(title, (search, seq)) as title, arg_max(seq, (search, seq)) as seq from r group by id""")
def search_union(t: Tables) -> DataFrame:
    rows = t.listing.select((F.col("n_chars") % 400).alias("id"), F.col("doc_id").alias("seq"), "title")
    return upkeep.search_union(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0"), "id", "seq").select("id", "title", "seq")


@query("""select doc_id::varchar as external_id, trim(case doc_id % 3 when 0 then title || ' (detail)' else title end) as title, 'Oulun yliopisto' as employer, 'Oulu' as location, published_at, 'https://example.org/' || doc_id as url from listing""")
def normalize_feed(t: Tables) -> DataFrame:
    detail = F.when(F.col("doc_id") % 3 == 0, F.concat("title", F.lit(" (detail)"))).when(F.col("doc_id") % 3 == 1, " ")
    items = t.listing.select(F.col("doc_id").cast("string").alias("job_id"), "title", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("link"), "published_at", detail.alias("detail_title"))
    return landed.feed_listings(items, "Oulun yliopisto", "Oulu")


@query("""with b as (select doc_id, trim(title) as title, n_chars, case n_chars % 4 when 0 then 'https://example.org/a/' || doc_id when 1 then ' https://example.org/b/' || doc_id || ' ' when 2 then 'javascript:x' end as url, case when doc_id % 5 = 0 then ' ' when doc_id % 5 <> 1 then employer end as company, location, published_at from listing),
  d as (select *, case when doc_id % 4 = 0 then 'odd' when doc_id % 4 <> 1 then strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000') end as day from b)
  select case when n_chars % 4 < 2 then trim(url) else 'site' || (doc_id % 3) || ':' || coalesce(title, '') || ':' || coalesce(day, '') end as external_id, coalesce(title, '') as title, nullif(trim(company), '') as employer, nullif(trim(location), '') as location, case when doc_id % 4 >= 2 then published_at end as published_at, case when n_chars % 4 < 2 then trim(url) end as url from d""")
def normalize_cards(t: Tables) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars") % 4
    number = k.cast("string")
    url = F.when(n == 0, F.concat(F.lit("https://example.org/a/"), number)).when(n == 1, F.concat(F.lit(" https://example.org/b/"), number, F.lit(" "))).when(n == 2, "javascript:x")
    day = F.when(k % 4 == 0, "odd").when(k % 4 != 1, F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
    cards = t.listing.select(url.alias("url"), F.concat(F.lit("site"), (k % 3).cast("string")).alias("site"), F.trim("title").alias("title"), F.when(k % 5 == 0, " ").when(k % 5 != 1, F.col("employer")).alias("company"), F.col("location").alias("locations"), day.alias("date"))
    return landed.card_listings(cards).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


_HEAD = [
    ("page_id % 3 <> 0 and page_id % 2 = 0", "<meta name=\"description\" content=\" {x} \">"), ("page_id % 3 <> 0 and page_id % 2 = 1", "<meta content='{x}' name='description'>"),
    ("page_id % 5 <> 0", "<meta content='{x} &lt;og&gt;' property='og:description'>"), ("page_id % 7 <> 0", "<meta property=\"twitter:description\" content=\"{x} &amp; {x}\">"),
    ("page_id % 11 <> 0", "<span itemprop=\"description\"><b>{x}</b> i</span>"), ("page_id % 13 <> 0", "<div class=\"x job-description\"> {x}\n <i>d</i> and all that is said\tof it </div>"),
]
_DECODED = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_META = "nullif(" + _DECODED.format("trim(regexp_extract({}, '^[^\"'']+'))") + ", '')"
_BLOCK = _DECODED.format(r"trim(regexp_replace({}, '\s+', ' ', 'g'))")


@query(f"""with h as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as x from pages),
  c as (select page_id, unnest([case when page_id % 3 <> 0 then {_META.format('x')} end, case when page_id % 5 <> 0 then {_META.format("x || ' &lt;og&gt;'")} end, case when page_id % 7 <> 0 then {_META.format("x || ' &amp; ' || x")} end,
    case when page_id % 11 <> 0 then {_BLOCK.format('x')} end, case when page_id % 13 <> 0 then {_BLOCK.format("x || ' d and all that is said of it'")} end]) as text, unnest(range(5)) as place from h)
  select page_id, arg_min(text, place) filter (where length(text) >= 40) as description from c group by page_id""")
def html_description(t: Tables) -> DataFrame:
    """Descriptions from the heads of pages; the driver's pages have none of their own, so their titles stand for them,
    in some of the places where one may be."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    head = F.concat(*(F.when(F.expr(where), F.replace(F.lit(text), F.lit("{x}"), title)).otherwise("") for where, text in _HEAD))
    # A row each: the page is put together before the patterns read it many times.
    pages = t.pages.select("page_id", F.explode(F.array(F.concat(head, "html"))).alias("html"))
    return pages.select("page_id", landed.static_description(F.col("html")).alias("description"))


@query("""select doc_id, md5(replace(replace(regexp_replace(regexp_replace(description, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\+?[0-9][0-9 ()-]{6,}[0-9]', '[phone]', 'g'), 'thand', '[secret]'), 'ertible', '[secret]')) as clean from listing""")
def pii_redact(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", F.md5(T.without_personal_data(F.col("description"), ["thand", "ertible", "the"])).alias("clean"))


_PLACES_OF = ["Oulu", "Suomi", "Etä", "Pohjois-Pohjanmaa", None, "", "Helsinki / Etä", "Uusimaa", "Kainuun maakunta", "suomi"]
_RANK = "case when coalesce({0}, '') = '' then 0 when {0} in ('Suomi', 'Etä') then 1 when regexp_matches({0}, 'maakunta|Pohjois-|Etelä-|Keski-|Varsinais-|Uusimaa') then 2 else 3 end"


@query(f"""with p as (select doc_id, description, {_sql_chosen(_PLACES_OF, 'doc_id')} as a, {_sql_chosen(_PLACES_OF)} as b from listing)
  select doc_id, {_RANK.format('a')} as precision, case when {_RANK.format('b')} >= {_RANK.format('a')} then b else a end as chosen, length(trim(coalesce(description, ''))) < 800 as short from p""")
def location_precision(t: Tables) -> DataFrame:
    a, b = _chosen(_PLACES_OF, "doc_id"), _chosen(_PLACES_OF)
    return t.listing.select("doc_id", L.precision(a).alias("precision"), L.chosen_location(a, b).alias("chosen"), L.is_short(F.col("description"), 800).alias("short"))


@query(f"""with o as (select n_chars % 80 as job_id, doc_id, {_sql_chosen(_PLACES_OF, 'doc_id')} as location from listing)
  select job_id, arg_max(coalesce(location, '?'), ({_RANK.format('location')}, doc_id)) as location from o group by job_id""")
def location_backfill(t: Tables) -> DataFrame:
    rows = t.listing.select((F.col("n_chars") % 80).alias("job_id"), "doc_id", _chosen(_PLACES_OF, "doc_id").alias("location"))
    return rows.groupBy("job_id").agg(F.max_by(F.coalesce("location", F.lit("?")), F.struct(L.precision(F.col("location")), F.col("doc_id"))).alias("location"))


@query("select event_id from events where event_type in ('error', 'view') and (case when event_id % 4 <> 0 then ts end is null or ts <= timestamp '2024-01-15') and event_id % 5 < 3")
def due_items(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_type").isin("error", "view"), "retry").otherwise("done").alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("next_at"), (F.col("event_id") % 5).alias("attempts"))
    return upkeep.due(rows, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 3).select("event_id")


_REMOTE = f"select job_id from (select job_id, replace(lower(concat_ws(' ', location, title, description)), 'ß', 'ss') as x from job) where {_any('x', [*fixed.FULL_REMOTE, '/ etä'])} and not {_any('x', fixed.REMOTE_NEGATED)}"


@query(f"""with {_discovery()}, a as (select job_id, published_at from job where status = 'active'), o as (select *, row_number() over (order by published_at desc nulls last, job_id desc) as r from a),
  d as (select distinct job_id from x join terms on phrase <> '' and contains(txt, ' ' || phrase || ' ')),
  u as (select job_id, 0 as pool from o where r <= 60 union all select job_id, 1 from (select job_id from a join job using (job_id) where regexp_matches(location, '(?i)(^|[\\s,/])(oulu|ylivieska)([\\s,/]|$)') order by a.published_at desc nulls last, job_id desc limit 100)
    union all select job_id, 2 from (select job_id from a join ({_REMOTE}) m using (job_id) order by published_at desc nulls last, job_id desc limit 100) union all select job_id, 3 from (select job_id from a join d using (job_id) order by published_at desc nulls last, job_id desc limit 400))
  select job_id, min(pool)::int as pool from u group by job_id""")
def candidate_pool(t: Tables) -> DataFrame:
    """Recent, local, remote and discovered jobs, each pool with its cap; the first that has a job counts."""
    jobs = t.job.where("status = 'active'")
    found = jobs.join(gates.discovery_pool(jobs, discovery_terms(t)).select("job_id").distinct(), "job_id", "left_semi")
    pools = [jobs, gates.located_in(jobs, ["oulu", "ylivieska"]), gates.remote_pool(jobs), found]
    return upkeep.candidate_pool(pools, [60, 100, 100, 400], F.desc_nulls_last("published_at"), F.desc("job_id"))


@query("""with n as (select profile_id, job_id, machine_score as score, row_number() over (partition by profile_id order by machine_score desc, rec_id)::int as rank, 'new' as rationale from rec where job_id % 4 <> 0),
  o as (select profile_id, job_id, machine_score + 1 as score, (job_id % 50)::int as rank, 'old' as rationale, job_id % 5 <> 0 as active, case when job_id % 6 = 0 then job_id end as evaluation_id from rec where job_id % 3 <> 0),
  h as (select distinct profile_id, job_id from (select *, case when feedback_id % 7 = 0 then 'not_relevant' else 'other' end as action from feedback) where rating <= 1 or action = 'not_relevant')
  select coalesce(n.profile_id, o.profile_id) as profile_id, coalesce(n.job_id, o.job_id) as job_id, coalesce(n.score, o.score) as score, case when n.job_id is null then o.rank when o.job_id is not null and h.job_id is not null then null else n.rank end as rank,
    case when n.job_id is null or o.evaluation_id is not null then o.rationale else n.rationale end as rationale, case when n.job_id is null then o.active when o.job_id is null then true else h.job_id is null end as active, case when n.job_id is null then 'left' when o.job_id is null then 'inserted' else 'updated' end as outcome
  from n full join o on n.profile_id = o.profile_id and n.job_id = o.job_id left join h on h.profile_id = coalesce(n.profile_id, o.profile_id) and h.job_id = coalesce(n.job_id, o.job_id)""")
def recommendation_upsert(t: Tables) -> DataFrame:
    k = F.col("job_id")
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("machine_score"), "rec_id"))
    new = t.rec.where("job_id % 4 <> 0").select("profile_id", "job_id", F.col("machine_score").alias("score"), rank.alias("rank"), F.lit("new").alias("rationale"))
    old = t.rec.where("job_id % 3 <> 0").select("profile_id", "job_id", (F.col("machine_score") + 1).alias("score"), (k % 50).cast("int").alias("rank"), F.lit("old").alias("rationale"), (k % 5 != 0).alias("active"), F.when(k % 6 == 0, k).alias("evaluation_id"))
    feedback = t.feedback.select("profile_id", "job_id", "rating", F.when(F.col("feedback_id") % 7 == 0, "not_relevant").otherwise("other").alias("action"))
    return upkeep.recommendation_upsert(new, old, feedback)


@query("""with g as (select event_id % 300 as key, arg_max(event_id, event_id) as at from events where event_id % 3 <> 0 group by 1), n as (select g.key, e.event_id as at, e.event_id % 5 + 1 as rating, e.event_type = 'purchase' as applied, case when e.event_id % 4 <> 0 then 'c' || (e.event_id % 2) end as comment, 'n' || e.event_id as snapshot from g join events e on e.event_id = g.at),
  s as (select event_id as key, (event_id + 1) % 5 + 1 as rating, event_type = 'purchase' as applied, case when event_id % 4 <> 3 then 'c' || (event_id % 2) end as comment, (['completed', 'failed', 'skipped', 'pending'])[(event_id % 4) + 1] as status, 'o' || event_id as snapshot from events where event_id < 350 and event_id % 7 <> 0),
  s2 as (select s.key, case when s.key % 2 = 0 and n.key is not null then n.rating else s.rating end as rating, case when s.key % 2 = 0 and n.key is not null then n.applied else s.applied end as applied, case when s.key % 2 = 0 and n.key is not null then n.comment else s.comment end as comment, s.status, s.snapshot from s left join n using (key)),
  j as (select coalesce(n.key, s2.key) as key, n.key is null as gone, s2.key is null as fresh, n.rating as nr, n.applied as na, n.comment as nc, n.snapshot as ns, s2.rating as sr, s2.applied as sa, s2.comment as sc, s2.status as st, s2.snapshot as ss,
    n.rating is not distinct from s2.rating and n.applied is not distinct from s2.applied and n.comment is not distinct from s2.comment and s2.key is not null as same from n full join s2 on n.key = s2.key)
  select key, case when gone then sr else nr end as rating, case when gone then sa else na end as applied, case when gone then sc else nc end as comment, case when gone or same then ss else ns end as snapshot,
    case when gone then st when same then case when st in ('failed', 'skipped') then 'pending' else st end else 'pending' end as status, case when gone then 'left' when fresh then 'new' when same then 'kept' else 'reset' end as outcome from j""")
def feedback_upsert(t: Tables) -> DataFrame:
    k = F.col("event_id")
    comment = lambda gap: F.when(k % 4 != gap, F.concat(F.lit("c"), (k % 2).cast("string")))
    mark = lambda x: F.concat(F.lit(x), k.cast("string")).alias("snapshot")
    applied = (F.col("event_type") == "purchase").alias("applied")
    given = t.events.where("event_id % 3 <> 0").select((k % 300).alias("key"), k.alias("at"), (k % 5 + 1).alias("rating"), applied, comment(0).alias("comment"), mark("n"))
    stored = t.events.where("event_id < 350 and event_id % 7 <> 0").select(k.alias("key"), ((k + 1) % 5 + 1).alias("rating"), applied, comment(3).alias("comment"), _chosen(["completed", "failed", "skipped", "pending"], "event_id").alias("status"), mark("o"))
    # Even keys were stored with what is now given again.
    from ..operators.state import latest

    again = latest(given, ["key"], "at").where("key % 2 = 0").select("key", F.struct("rating", "applied", "comment").alias("g"))
    same = lambda c: F.when(F.col("g").isNotNull(), F.col(f"g.{c}")).otherwise(F.col(c)).alias(c)
    stored = stored.join(again, "key", "left").select("key", same("rating"), same("applied"), same("comment"), "status", "snapshot")
    return upkeep.feedback_upsert(given, stored)


@query("""with j as (select job_id, (['static', 'other'])[(job_id % 2) + 1] as enricher, description, 'h' || (n_chars % 9) as hash from job),
  d as (select job_id, 'static' as enricher, 'h' || (n_chars % 9) as hash from job where job_id % 3 = 0 union all select job_id, 'other', 'h0' from job where job_id % 5 = 0), q as (select job_id, 'other' as enricher, 'h' || (n_chars % 7) as hash from job where job_id % 7 = 1)
  select job_id, enricher from j where length(trim(coalesce(description, ''))) < 1500 and not exists (select 1 from d where d.job_id = j.job_id and d.enricher = j.enricher and d.hash = j.hash) and not exists (select 1 from q where q.job_id = j.job_id and q.enricher = j.enricher and q.hash = j.hash)""")
def enrich_candidates(t: Tables) -> DataFrame:
    name = lambda n: F.concat(F.lit("h"), (F.col("n_chars") % n).cast("string")).alias("hash")
    jobs = t.job.select("job_id", _chosen(["static", "other"], "job_id").alias("enricher"), "description", name(9))
    done = t.job.where("job_id % 3 = 0").select("job_id", F.lit("static").alias("enricher"), name(9)).unionByName(t.job.where("job_id % 5 = 0").select("job_id", F.lit("other").alias("enricher"), F.lit("h0").alias("hash")))
    queued = t.job.where("job_id % 7 = 1").select("job_id", F.lit("other").alias("enricher"), name(7))
    return upkeep.enrichment_candidates(jobs, done, queued, 1500).select("job_id", "enricher")


_LANE_SETS = [["exploration"], ["learned_discovery", "direct_title"], ["feedback_discovery", "exploration"], [], None]


@query("""with b as (select f.*, case when feedback_id % 6 <> 5 then row_number() over (partition by profile_id order by created_at, feedback_id) end as rank, ([['exploration'], ['learned_discovery', 'direct_title'], ['feedback_discovery', 'exploration'], [], null])[(feedback_id % 5) + 1] as lanes,
    case when feedback_id % 3 = 0 then (feedback_id % 100) / 100.0 end as disliked, feedback_id % 2 as found from feedback f),
  c as (select *, rating >= 4 or applied as liked, coalesce(rank <= 30, false) as top, coalesce(list_contains(lanes, 'exploration'), false) as expl, coalesce(list_has_any(lanes, ['learned_discovery', 'feedback_discovery']), false) as disc from b)
  select profile_id, count(*) filter (where liked) as positive, count(*) filter (where not liked and rating <= 2) as negative, count(*) filter (where top) as rated_30, round(count(*) filter (where liked and top)::double / nullif(count(*) filter (where liked), 0), 3) as recall_30, round(count(*) filter (where not liked and rating <= 2 and top)::double / nullif(count(*) filter (where top), 0), 3) as negative_30,
    round(count(*) filter (where liked and expl)::double / nullif(count(*) filter (where liked), 0), 3) as exploration, round(count(*) filter (where liked and disc)::double / nullif(count(*) filter (where liked), 0), 3) as learned_discovery, count(*) filter (where disliked >= 0.75 and found = 1) as skips from c group by profile_id""")
def feedback_benchmark(t: Tables) -> DataFrame:
    k = F.col("feedback_id")
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy("created_at", "feedback_id"))
    sets = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") if x is not None else F.lit(None).cast("array<string>") for x in _LANE_SETS))
    rows = t.feedback.withColumns({"r": rank}).withColumns({
        "rank": F.when(k % 6 != 5, F.col("r")), "lanes": F.get(sets, (k % 5).cast("int")), "anti": F.when(k % 3 == 0, (k % 100) / 100.0), "exclusion_matches": F.when(k % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))})
    return upkeep.feedback_benchmark(rows, "profile_id")


@query("""with r as (select profile_id, rec_id, case when commutable then 'commutable' when remote then 'remote' else 'nationwide' end as scope, case when review_score is null then 'unreviewed' when rec_id % 3 = 0 then 'stale' else 'current' end as state, action <> 'skip' as published from rec where not hard_rejected)
  select profile_id, scope, state, count(*) as n, count(*) filter (where published) as published, sha256(string_agg(rec_id::varchar, ',' order by rec_id)) as identity, min(rec_id) as sample from r group by all""")
def backlog_inventory(t: Tables) -> DataFrame:
    """Reviews that are open, of an old prompt or current, by scope; a digest of the ids, and one of them."""
    scope = F.when(F.col("commutable"), "commutable").when(F.col("remote"), "remote").otherwise("nationwide")
    state = F.when(F.col("review_score").isNull(), "unreviewed").when(F.col("rec_id") % 3 == 0, "stale").otherwise("current")
    ids = F.transform(F.array_sort(F.collect_list("rec_id")), lambda x: x.cast("string"))
    rows = t.rec.where("not hard_rejected").groupBy("profile_id", scope.alias("scope"), state.alias("state"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("action") != "skip").alias("published"), F.sha2(F.array_join(ids, ","), 256).alias("identity"), F.min("rec_id").alias("sample"))


@query("""with c as (select label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as x, count(*) as n from c group by all)
  select label, max(n) as n, round(sum(x), 4) as total, round(sum(x * i), 4) as moment from m group by label having max(n) >= 3""")
def centroids(t: Tables) -> DataFrame:
    made = scoring.centroids(t.embeddings, "label")
    cells = made.select("label", "n", F.posexplode("centroid").alias("i", "x"))
    return cells.groupBy("label").agg(F.max("n").alias("n"), F.round(F.sum("x"), 4).alias("total"), F.round(F.sum(F.col("x") * F.col("i")), 4).alias("moment"))


@query("""with v as (select (vec_id % 180)::bigint as k, embedding from embeddings), c as (select k, unnest(range(64)) as i, unnest(embedding)::double as x from v), m as (select k, i, avg(x) as x, count(*) as n from c group by all), n as (select k, max(n) as n, round(sum(x), 4) as total from m group by k having max(n) >= 3), o as (select distinct (vec_id % 200)::bigint as k from embeddings where vec_id % 2 = 0)
  select coalesce(n.k, o.k) as k, n.n, n.total, case when n.k is null then 'deleted' when o.k is null then 'inserted' else 'updated' end as change from n full join o on n.k = o.k""")
def centroid_upsert(t: Tables) -> DataFrame:
    made = scoring.centroids(t.embeddings.withColumn("k", F.col("vec_id") % 180), "k", 1)
    old = t.embeddings.where("vec_id % 2 = 0").select((F.col("vec_id") % 200).alias("k")).distinct()
    rows = upkeep.centroid_table(old, made, "k")
    return rows.select("k", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "change")


@query("""with o as (select doc_id as occurrence, n_chars % 120 as job_id from listing), m as (select doc_id as occurrence, n_chars % 60 as to_job from listing where doc_id % 3 = 0 or n_chars % 5 = 0), a as (select o.occurrence, coalesce(to_job, job_id) as job_id from o left join m using (occurrence)),
  g as (select distinct o.job_id from o join m using (occurrence) where to_job <> job_id and o.job_id not in (select job_id from a))
  select j.job_id, case when g.job_id is not null then 'superseded' else 'active' end as status, (select count(*) from a where a.job_id = j.job_id) as occurrences from (select distinct job_id from o) j left join g using (job_id)""")
def relink_supersede(t: Tables) -> DataFrame:
    occurrences = t.listing.select(F.col("doc_id").alias("occurrence"), (F.col("n_chars") % 120).alias("job_id"))
    moves = t.listing.where("doc_id % 3 = 0 or n_chars % 5 = 0").select(F.col("doc_id").alias("occurrence"), (F.col("n_chars") % 60).alias("to"))
    after, gone = upkeep.relinked(occurrences, moves)
    count = after.groupBy("job_id").agg(F.count("*").alias("occurrences"))
    rows = occurrences.select("job_id").distinct().join(gone.withColumn("gone", F.lit(True)), "job_id", "left").join(count, "job_id", "left")
    return rows.select("job_id", F.when(F.col("gone"), "superseded").otherwise("active").alias("status"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


@query("""with n as (select profile_id, term, length(term)::bigint as w from profile_term where length(term) % 2 = 0 and profile_id % 5 <> 0), o as (select profile_id, term, -1::bigint as w from profile_term where length(term) % 3 = 0 and profile_id % 4 <> 0), p as (select distinct profile_id from profile_term)
  select profile_id, (select count(*) from n where n.profile_id = p.profile_id) + (select count(*) from o where o.profile_id = p.profile_id and not exists (select 1 from n where n.profile_id = o.profile_id and n.term = o.term)) as terms,
    coalesce((select sum(w) from n where n.profile_id = p.profile_id), 0) + coalesce((select sum(w) from o where o.profile_id = p.profile_id and not exists (select 1 from n where n.profile_id = o.profile_id and n.term = o.term)), 0) as weight, case when profile_id % 3 = 0 then 'imported' when profile_id % 4 <> 0 then 'stored' end as boosts from p""")
def profile_merge(t: Tables) -> DataFrame:
    terms = lambda where, w: t.profile_term.where(where).groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("term", w.cast("long").alias("w")))).alias("learned"))
    boost = lambda name: F.create_map(F.lit("by"), F.lit(name))
    who = t.profile_term.select("profile_id").distinct()
    p = F.col("profile_id")
    imported = who.join(terms("length(term) % 2 = 0 and profile_id % 5 <> 0", F.length("term")), "profile_id", "left").withColumn("boosts", F.when(p % 3 == 0, boost("imported")))
    stored = who.where("profile_id % 4 <> 0").join(terms("length(term) % 3 = 0 and profile_id % 4 <> 0", F.lit(-1)), "profile_id", "left").withColumn("boosts", boost("stored"))
    rows = upkeep.profile_state(imported, stored)
    values = F.coalesce(F.map_values("learned"), F.array().cast("array<bigint>"))
    return rows.select("profile_id", F.size(values).cast("long").alias("terms"), F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x).alias("weight"), F.col("boosts.by").alias("boosts"))


@query("""with f as (select feedback_id, (['like', 'applied', 'hide', 'neutral', 'odd', null])[(feedback_id % 6) + 1] as action, case when feedback_id % 4 = 0 then rating end as rating from feedback)
  select feedback_id, coalesce(rating, case action when 'like' then 4 when 'applied' then 5 when 'neutral' then 3 when 'hide' then 1 end)::int as rating, coalesce(action = 'applied', false) as applied from f""")
def rating_backfill(t: Tables) -> DataFrame:
    """The migration of actions of old feedback to ratings; a rating that is there stays."""
    k = F.col("feedback_id")
    action = _chosen(["like", "applied", "hide", "neutral", "odd", None], "feedback_id")
    rated = F.coalesce(*(F.when(action == a, n) for a, n in (("like", 4), ("applied", 5), ("neutral", 3), ("hide", 1))))
    return t.feedback.select(k, F.coalesce(F.when(k % 4 == 0, F.col("rating")), rated).cast("int").alias("rating"), F.coalesce(action == "applied", F.lit(False)).alias("applied"))


@query("""select rec_id, coalesce(commutable, false) as commutable, coalesce(commutable or remote, false) as either, case when commutable then row_number() over (partition by profile_id, commutable order by machine_score desc, rec_id) end::int as near_rank, row_number() over (partition by profile_id order by machine_score desc, rec_id)::int as nationwide_rank from rec""")
def travel_scope_backfill(t: Tables) -> DataFrame:
    """The migration of recommendations to scopes: flags and ranks of rows that had one rank only."""
    from ..operators.state import ranks_within

    rows = ranks_within(t.rec, "profile_id", {"near_rank": F.col("commutable"), "nationwide_rank": F.lit(True)}, F.desc("machine_score"), F.col("rec_id"))
    return rows.select("rec_id", "commutable", (F.col("commutable") | F.col("remote")).alias("either"), "near_rank", "nationwide_rank")
