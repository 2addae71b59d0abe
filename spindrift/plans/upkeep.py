"""Queries of state that is kept: lookups, queues, runs, reviews, caches, and reads of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, listing as L, places as P
from ..operators import gates, state, upkeep
from . import flagship
from .binding import Tables
from .listings import _MATCHES, _NORM, _any, _inventory, discovery_terms
from .registry import query
from .verdicts import _PLACES, _ROUTES, _placed
from .more import _merged


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) + 1 as k, user_id as owner from events")
def json_merge(t: Tables) -> DataFrame:
    return _merged(t.events)


@query("""select s.source_id, count(j.job_id) as listings, count(j.job_id) filter (where j.expires_at is null) as no_deadline, count(distinct j.employer) filter (where j.status = 'active') as employers
  from source_dim s left join job j using (source_id) group by s.source_id""")
def source_inventory(t: Tables) -> DataFrame:
    return _inventory(t, t.job)


_DISCOVERY = f"""w as (select item_id as profile_id, unnest(range(len(ws))) as pos, unnest(ws) as term from (select item_id, string_split(text, ' ') as ws from benchmark)), f as (select profile_id, pos, trim(lower(term)) as term from w),
  g as (select profile_id, term, min(pos) as pos from f where length(term) >= 5 and term not in ({{bad}}) group by all), r as (select profile_id, term, row_number() over (partition by profile_id order by pos, term) as place from g),
  terms as (select distinct profile_id, {_NORM.format('term')} as phrase from r where place <= 80), x as (select job_id, ' ' || {_NORM.format("concat_ws(' ', title, description)")} || ' ' as txt from job)"""


def _discovery() -> str:
    return _DISCOVERY.format(bad=", ".join(f"'{x}'" for x in fixed.GENERIC_TERMS + fixed.DISCOVERY_EXCLUDED))


@query(f"with {_discovery()} select distinct job_id, profile_id from x join terms on phrase <> '' and contains(txt, ' ' || phrase || ' ')")
def pool_discovery(t: Tables) -> DataFrame:
    """The whole pool: every profile, its own terms."""
    return gates.discovery_pool(t.job, discovery_terms(t))


@query(f"""with n as (select unnest([0, 0, 1, 2]) as profile_id, unnest(['the', 'and the', '!', 'of']) as phrase), k as (select unnest([0, 1, 1, 2]) as profile_id, unnest(['worthless', 'hand', 'stupid', 'thandly']) as word),
  x as (select r.rec_id, r.profile_id, ' ' || {_NORM.format('title')} || ' ' as tt, {_NORM.format("concat_ws(' ', title, employer, description)")} as txt from rec r join job j using (job_id)),
  h as (select rec_id, phrase as m from x join n using (profile_id) where {_NORM.format('phrase')} <> '' and contains(tt, ' ' || {_NORM.format('phrase')} || ' ') union select rec_id, word from x join k using (profile_id) where contains(txt, word))
  select rec_id, string_agg(m, ',' order by m) as matches from h group by rec_id""")
def negative_matches(t: Tables) -> DataFrame:
    """Titles and words that profiles rule out: phrases on the title, keywords of four characters anywhere."""
    wanted = t.spark.createDataFrame([(0, "title", "the"), (0, "title", "and the"), (1, "title", "!"), (2, "title", "of"), (0, "keyword", "worthless"), (1, "keyword", "hand off"), (1, "keyword", "stupid"), (2, "keyword", "thandly in")], "profile_id long, kind string, value string")
    found = gates.negative_matches(t.rec.select("rec_id", "job_id", "profile_id"), t.job, wanted)
    return found.select("rec_id", F.array_join("matches", ",").alias("matches"))


@query("""with r as (select doc_id, source_id, ([['091'], ['564', '049'], [], null])[(n_chars % 4) + 1] as codes, '/region/' || (n_chars % 3) as path from listing)
  select doc_id, source_id from r where coalesce(list_has_any(codes, ['564', '977']), false) or path in ('/region/2')""")
def region_subset(t: Tables) -> DataFrame:
    codes = F.get(F.array(F.array(F.lit("091")), F.array(F.lit("564"), F.lit("049")), F.array().cast("array<string>"), F.lit(None).cast("array<string>")), (F.col("n_chars") % 4).cast("int"))
    rows = t.listing.select("doc_id", "source_id", codes.alias("codes"), F.concat(F.lit("/region/"), (F.col("n_chars") % 3).cast("string")).alias("path"))
    return gates.region_subset(rows, ["564", "977"], ["/region/2"]).select("doc_id", "source_id")


@query(f"""with {_PLACES}, w as (select destination, min(job_id) as pos from (select job_id, unnest(places) as destination from p) group by destination),
  s as (select destination, pos, case when destination in ('Oulu, Finland', 'Kempele, Finland') then 'hit' when destination = 'Nurmes, Finland' then 'miss' when destination = 'Turku, Finland' then 'backoff' end as known from w),
  o as (select *, row_number() over (partition by known is null order by pos, destination) as r from s)
  select destination, coalesce(known, case when r <= 2 then 'fetch' else 'deferred' end) as status from o""")
def lookup_plan(t: Tables) -> DataFrame:
    """Which destinations are looked up: not those known, lately without a route or in backoff, and two at most."""
    wanted = _placed(t).select("job_id", F.explode(P.destinations(F.col("location"))).alias("destination")).groupBy("destination").agg(F.min("job_id").alias("pos"))
    cache = t.spark.createDataFrame([("Oulu, Finland",), ("Kempele, Finland",)], "destination string")
    failures = t.spark.createDataFrame([("Nurmes, Finland", "no_route", 5.0), ("Turku, Finland", "timeout", 0.2), ("Kuopio, Finland", "no_route", 40.0), ("Ylivieska, Finland", "timeout", 3.0), ("Oulu, Finland", "no_route", 1.0)], "destination string, reason string, age_days double")
    return upkeep.lookup_plan(wanted, cache, failures, 2).select("destination", "status")


@query(f"""with {_PLACES}, b as (select job_id, arg_min(destination, duration_s) as destination, min(duration_s) as s from (select job_id, unnest(places) as destination from p) join {_ROUTES} using (destination) group by job_id),
  e as (select p.job_id, ([null, '', 'kaukana', 'lähellä'])[(p.job_id % 4) + 1] as text, (['good', 'warning', 'odd', 'bad', null])[(p.job_id % 5) + 1] as tone, b.s from p left join b using (job_id))
  select job_id, case when coalesce(trim(text), '') <> '' and coalesce(tone in ('good', 'warning', 'bad'), false) then text when s is not null then 'route ' || s end as evidence from e""")
def evidence_fill(t: Tables) -> DataFrame:
    from ..operators import ranking
    from .verdicts import _chosen

    stored = t.job.select("job_id", _chosen([None, "", "kaukana", "lähellä"], "job_id").alias("text"), _chosen(["good", "warning", "odd", "bad", None], "job_id").alias("tone"))
    built = ranking.best_routes(_placed(t), flagship.routes(t)).select("job_id", F.concat(F.lit("route "), F.col("duration_s").cast("string")).alias("built"))
    return upkeep.evidence(stored, built).select("job_id", "evidence")


@query("""with c as (select event_id % 50 as destination, event_id, value from events where event_type in ('click', 'view', 'signup')), f as (select event_id % 60 as destination, event_id from events where event_type = 'error'),
  n as (select destination, arg_max(value, event_id) as value from c group by 1), o as (select destination, max(event_id) as failed from f group by 1)
  select coalesce(n.destination, o.destination) as destination, n.value, case when n.destination is null then failed end as failed from n full join o on n.destination = o.destination""")
def route_cache(t: Tables) -> DataFrame:
    """The cache after results came in: the latest of each destination, and failures of those without one."""
    found = t.events.where("event_type in ('click', 'view', 'signup')").select((F.col("event_id") % 50).alias("destination"), F.col("event_id").alias("at"), "value")
    failed = t.events.where("event_type = 'error'").select((F.col("event_id") % 60).alias("destination"), F.col("event_id").alias("at"))
    cache, failures = upkeep.route_cache(found, failed)
    return cache.select("destination", "value").join(failures.select("destination", F.col("at").alias("failed")), "destination", "full")


@query("""with r as (select event_id as run_id, user_id as source_id, (['running', 'running', 'finished'])[(event_id % 3) + 1] as status, 'o' || (event_id % 4) as owner from events),
  f as (select event_id as run_id, 'o' || (event_id % 5) as owner, (['finished', 'failed'])[(event_id % 2) + 1] as final from events where event_id % 2 = 0)
  select r.run_id, case when r.status = 'running' and f.owner = r.owner then f.final when r.status = 'running' and source_id % 3 = 0 then 'failed' else r.status end as status, r.status = 'running' and f.owner is not distinct from r.owner as finished from r left join f using (run_id)""")
def run_reconcile(t: Tables) -> DataFrame:
    """Runs after their finishers came, only the owner's counts, and after sources were found free."""
    from .verdicts import _chosen

    k = F.col("event_id")
    runs = t.events.select(k.alias("run_id"), F.col("user_id").alias("source_id"), _chosen(["running", "running", "finished"], "event_id").alias("status"), F.concat(F.lit("o"), (k % 4).cast("string")).alias("owner"))
    ends = t.events.where("event_id % 2 = 0").select(k.alias("run_id"), F.concat(F.lit("o"), (k % 5).cast("string")).alias("owner"), _chosen(["finished", "failed"], "event_id").alias("final"))
    free = t.events.select(F.col("user_id").alias("source_id")).where("source_id % 3 = 0").distinct()
    return upkeep.finished_runs(runs, ends, free).select("run_id", "status", "finished")


@query("""with a as (select event_id as feedback_id, event_id % 4 as attempts, (['completed', 'retryable', 'terminal', 'stale'])[(event_id % 4) + 1] as outcome, ts from events)
  select feedback_id, case outcome when 'completed' then 'completed' when 'terminal' then 'failed' when 'stale' then 'pending' else case when attempts + 1 >= 3 then 'failed' else 'retry' end end as status, (attempts + case when outcome = 'stale' then 0 else 1 end)::int as attempts,
    case when outcome = 'retryable' and attempts + 1 < 3 then ts + to_hours(cast(power(2, attempts + 1) as int)) end as next_at from a""")
def analysis_retry(t: Tables) -> DataFrame:
    """Feedback after attempts at its analysis: a stale one, made for text edited since, counts for nothing."""
    from .verdicts import _chosen

    rows = t.events.select(F.col("event_id").alias("feedback_id"), (F.col("event_id") % 4).cast("int").alias("attempts"), _chosen(["completed", "retryable", "terminal", "stale"], "event_id").alias("outcome"), "ts")
    return upkeep.analysis_attempts(rows, F.col("ts"), 3).select("feedback_id", "status", "attempts", "next_at")


@query("""with j as (select job_id, n_chars % 5 as old_confidence, length(description) as n, job_id % 5 = 0 as enriched, 'x' || (n_chars % 40) as hash, source_id from job where length(description) < 1500),
  q as (select j.*, case when job_id % 3 = 1 then 'x' || ((n_chars + case when job_id % 7 = 0 then 1 else 0 end) % 40) end as result_hash, n_chars % 9 as confidence from j join (select doc_id, n_chars from documents) d on d.doc_id = j.job_id),
  o as (select *, case when result_hash is null then 'none' when result_hash <> hash then 'stale' when enriched and confidence < old_confidence then 'kept' when not enriched and n >= 1000 then 'kept' else 'applied' end as outcome from q)
  select source_id, count(*) as candidates, count(*) filter (where outcome <> 'none') as attempts, count(*) filter (where outcome = 'applied') as enriched, count(*) filter (where outcome = 'stale') as stale, count(*) filter (where outcome = 'kept') as kept from o group by source_id""")
def enrichment_run_counts(t: Tables) -> DataFrame:
    """An enrichment run: candidates with short texts, results for some, what they change, a row for each source."""
    short = t.job.where(F.length("description") < 1500)
    name = lambda n: F.concat(F.lit("x"), (n % 40).cast("string"))
    results = short.where("job_id % 3 = 1").select("job_id", name(F.col("n_chars") + F.when(F.col("job_id") % 7 == 0, 1).otherwise(0)).alias("result_hash"), (F.col("n_chars") % 9).alias("confidence"))
    now = short.select("job_id", name(F.col("n_chars")).alias("hash"), F.length("description").alias("length"), (F.col("job_id") % 5 == 0).alias("enriched"), (F.col("n_chars") % 5).alias("old_confidence"))
    rows = state.enrichment_outcomes(now, results, 1000).join(short.select("job_id", "source_id"), "job_id")
    return upkeep.run_counts(rows, "source_id")


_REVIEW = """with r as (select *, case when review_score is null then 0 when n_of % 3 = 0 then 1 else 2 end as priority, row_number() over (partition by profile_id order by machine_score desc, rec_id) as nationwide from (select rec.*, rec_id as n_of from rec) where not hard_rejected),
  c as (select *, 0 as bucket, row_number() over (partition by profile_id order by priority, nationwide, machine_score desc, rec_id desc) as place from r where commutable),
  f as (select *, 1 as bucket, row_number() over (partition by profile_id order by priority, nationwide, machine_score desc, rec_id desc) as place from r where not commutable and remote),
  n as (select *, 2 as bucket, row_number() over (partition by profile_id order by priority, nationwide, machine_score desc, rec_id desc) as place from r where rec_id not in (select rec_id from c where place <= 8 union select rec_id from f where place <= 4))
  select profile_id, rec_id, bucket::int as bucket, priority::int as priority, place::int as place from (select * from c where place <= 8 union all select * from f where place <= 4 union all select * from n where place <= 8)"""


@query(_REVIEW)
def review_buckets(t: Tables) -> DataFrame:
    """Twenty reviews a profile: 40 % near, 20 % remote, the rest anywhere; new ones first, then those of an old
    prompt, then current ones; what a bucket leaves over may come in by the last."""
    from pyspark.sql import Window

    rows = t.rec.where("not hard_rejected")
    rows = rows.withColumns({"priority": F.when(F.col("review_score").isNull(), 0).when(F.col("rec_id") % 3 == 0, 1).otherwise(2), "nationwide": F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("machine_score"), "rec_id"))})
    return upkeep.review_buckets(rows, 20).select("profile_id", "rec_id", "bucket", "priority", "place")


_LINKS = """with u as (select page_id, (['alpha', 'beta', 'gamma'])[(page_id % 3) + 1] as source, 'id' || page_id as external_id, (['https://alpha.example.org/jobs/old/1', 'https://alpha.example.org/jobs/job/2', 'https://beta.example.org/x', 'https://elsewhere.example.org/x', url, null])[(page_id % 6) + 1] as url from pages),
  b as (select *, case when source = 'alpha' then url like 'https://alpha.example.org/jobs/%' and url not like '%/jobs/job/%' when source = 'beta' then url is not null and url not like 'https://beta.example.org/%' else false end as broken from u)"""


@query(f"{_LINKS} select page_id, url, case source when 'alpha' then 'https://alpha.example.org/jobs/job/' else 'https://beta.example.org/details/?id=' end || external_id as repaired from b where broken")
def url_repair(t: Tables) -> DataFrame:
    return upkeep.repaired_links(_links(t), _families(t)).where("repaired is not null").select("page_id", "url", "repaired")


@query(f"{_LINKS} select source, count(*) as n, count(*) filter (where broken) as broken, count(*) filter (where url is null) as missing from b group by source")
def broken_urls(t: Tables) -> DataFrame:
    rows = upkeep.repaired_links(_links(t), _families(t))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("repaired").isNotNull()).alias("broken"), F.count_if(F.col("url").isNull()).alias("missing"))


def _links(t: Tables) -> DataFrame:
    from .verdicts import _chosen

    urls = F.array(F.lit("https://alpha.example.org/jobs/old/1"), F.lit("https://alpha.example.org/jobs/job/2"), F.lit("https://beta.example.org/x"), F.lit("https://elsewhere.example.org/x"), F.col("url"), F.lit(None).cast("string"))
    return t.pages.select("page_id", _chosen(["alpha", "beta", "gamma"], "page_id").alias("source"), F.concat(F.lit("id"), F.col("page_id").cast("string")).alias("external_id"), F.get(urls, (F.col("page_id") % 6).cast("int")).alias("url"))


def _families(t: Tables) -> DataFrame:
    rows = [("alpha", "https://alpha.example.org/jobs/%", "%/jobs/job/%", "https://alpha.example.org/jobs/job/"), ("beta", "%", "https://beta.example.org/%", "https://beta.example.org/details/?id=")]
    return t.spark.createDataFrame(rows, "source string, like_ string, unlike string, prefix string")
