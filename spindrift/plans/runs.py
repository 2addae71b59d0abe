"""Runs that move state: collection, learning, enrichment; the state they leave, as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import collection, enrichment, learning
from ..sources.tables import shared_folder
from ..sources.versions import Versions
from .binding import Tables
from .listings import _NORM, _TOKENS, _WEIGHT
from .registry import query
from .verdicts import _VARIANTS


def _line(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).alias("value")


_LANDED = """b1 as (select * from listing where doc_id % 4 <> 3), b2 as (select * replace (case when n_chars % 5 = 0 then employer || 'X' else employer end as employer) from listing where doc_id % 4 <> 0)"""
_KEYED = lambda of: f"select *, concat_ws('|', {', '.join(_NORM.format(c) for c in ('title', 'employer', 'location'))}, strftime(published_at, '%Y-%m-%d')) as k from {of}"
_COLLECTED = f"""{_LANDED}, k1 as ({_KEYED('b1')}), k2 as ({_KEYED('b2')}), lead1 as (select k, min((source_id, doc_id)) as f from k1 group by k),
  o1 as (select k1.*, case when source_id = f[1] then doc_id else f[2] end as job, case when source_id = f[1] then 'inserted' else 'deduplicated' end as outcome from k1 join lead1 using (k)),
  old as (select k, min((job, source_id)) as f, min(source_id) as lo, max(source_id) as hi from o1 group by k),
  m2 as (select k2.*, o1.job as own, case when old.k is not null and (lo <> k2.source_id or hi <> k2.source_id) then old.f[1] end as twin from k2 left join o1 on o1.doc_id = k2.doc_id left join old on old.k = k2.k),
  lead2 as (select k, min((source_id, doc_id)) as f from m2 where own is null and twin is null group by k),
  o2 as (select m2.*, case when own is not null then own when twin is not null then twin when source_id = f[1] then doc_id else f[2] end as job,
      case when own is not null then case when n_chars % 5 = 0 then 'updated' else 'unchanged' end when twin is not null then 'deduplicated' when source_id = f[1] then 'inserted' else 'deduplicated' end as outcome from m2 left join lead2 on lead2.k = m2.k and own is null and twin is null),
  left_ as (select *, source_id % 3 <> 0 as closed from o1 where doc_id % 4 = 0),
  occ as (select doc_id, source_id, external_id, title, employer, location, description, job, false as closed, 2 as batch from o2 union all select doc_id, source_id, external_id, title, employer, location, description, job, closed, case when closed then 2 else 1 end from left_),
  seen as (select *, max((not closed)::int) over (partition by job) as open from occ), told as (select * from seen where not closed or open = 0),
  best as (select job, max(open) as open, {', '.join(f"arg_min(trim({c}), (-length(trim({c})), trim({c}))) as {c}" for c in collection.FIELDS)} from told group by job),
  touched as (select distinct job from occ where batch = 2),
  counts as (select 1 as batch, source_id, outcome from o1 union all select 2, source_id, outcome from o2 union all select 2, source_id, 'closed' from left_ where closed),
  marks as (select source_id, max(published_at) as w, max(batch) as batch from (select source_id, published_at, 1 as batch from b1 union all select source_id, published_at, 2 from b2 where source_id % 3 <> 0) group by source_id)"""


@query(f"""with {_COLLECTED}
  select 'occurrence' as kind, source_id || '/' || external_id as id, concat_ws('|', job, closed, batch) as value from occ
  union all select 'job', job::varchar, concat_ws('|', case when open = 1 then 'active' else 'removed' end, case when job in (select job from touched) then 2 else 1 end, title, employer, location, md5(description)) from best
  union all select 'source', source_id::varchar, concat_ws('|', strftime(w, '%Y-%m-%d'), batch) from marks
  union all select 'run', batch || '/' || source_id, concat_ws('|', {', '.join(f"count(*) filter (where outcome = '{x}')" for x in ('inserted', 'updated', 'unchanged', 'deduplicated', 'closed'))}) from counts group by batch, source_id""")
def collection_batch(t: Tables) -> DataFrame:
    """The state after two batches, of which the second runs twice: three quarters of all listings; then one quarter is new, one
    does not come again and some employers have another name. Of two thirds of the sources the second fetch is whole."""
    rows = t.listing.select(F.col("doc_id").alias("seq"), "source_id", "external_id", "published_at", "n_chars", *collection.FIELDS)
    renamed = F.when(F.col("n_chars") % 5 == 0, F.concat("employer", F.lit("X"))).otherwise(F.col("employer"))
    versions = Versions(t.spark, f"{shared_folder(t.spark)}/collection-{uuid.uuid4().hex}")
    every = t.listing.select("source_id").distinct()
    collection.collect(versions, 1, rows.where("seq % 4 <> 3").drop("n_chars"), every)
    for _ in range(2):
        collection.collect(versions, 2, rows.where("seq % 4 <> 0").withColumn("employer", renamed).drop("n_chars"), every.where("source_id % 3 <> 0"))
    read = lambda name, schema: versions.read(name, schema)
    text = lambda *cs: F.concat_ws("/", *(F.col(c).cast("string") for c in cs)).alias("id")
    kind = lambda k: F.lit(k).alias("kind")
    c = F.col
    jobs = collection.described(read("jobs", collection.JOBS), read("texts", collection.TEXTS), digest=F.md5("description"))
    parts = [
        read("occurrences", collection.OCCURRENCES).select(kind("occurrence"), text("source_id", "external_id"), _line(c("job_id"), c("closed"), c("batch"))),
        jobs.select(kind("job"), text("job_id"), _line(c("status"), c("batch"), c("title"), c("employer"), c("location"), c("digest"))),
        read("sources", collection.SOURCES).select(kind("source"), text("source_id"), _line(F.date_format("watermark", "yyyy-MM-dd"), c("batch"))),
        read("runs", collection.RUNS).select(kind("run"), text("batch", "source_id"), _line(*map(c, ["inserted", "updated", "unchanged", "deduplicated", "closed"]))),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


#: Terms that discovery does without: for all profiles, and those that some profiles have removed.
_BASELINE = ["oulu", "emp3"]
_AS_OF = "2024-04-01 00:00:00"
_TERMS = f"""jt0 as (select job_id, unnest({_TOKENS.format("concat_ws(' ', title, employer, location)")}) as term from job), tt0 as (select job_id, unnest({_TOKENS.format('title')}) as v0 from job), lt0 as (select job_id, unnest({_TOKENS.format('location')}) as v0 from job),
  tv as (select distinct job_id, variant from ({_VARIANTS.format('job_id', 'tt0')})), lv as (select distinct job_id, variant from ({_VARIANTS.format('job_id', 'lt0')})),
  job_term as materialized (select t.job_id, t.term, tv.variant is not null as title_like, lv.variant is not null as location_like from jt0 t left join tv on tv.job_id = t.job_id and tv.variant = t.term left join lv on lv.job_id = t.job_id and lv.variant = t.term
    where t.term not in ('{"','".join(fixed.GENERIC_TERMS)}')),
  firm_term as (select job_id, lower(trim(employer)) as term, false as title_like, false as location_like from job where trim(employer) <> '')"""


def _weights(n: int, of: str, terms: str) -> str:
    return f"""{of}{n} as materialized (select *, jobs::double / total > 0.30 as frequent from (select profile_id, term, round(sum(w), 6) as net, round(sum(d), 6) as score, count(distinct job_id) as jobs, min(first) as first_seen, bool_or(title_like) as title_like, bool_or(location_like) as location_like
      from pj{n} join {terms} using (job_id) where heard group by all) join (select profile_id, count(*) as total from fb{n} group by all) using (profile_id))"""


def _learned(n: int, where: str) -> str:
    """SQL of a run: lists<n> and state<n>, from lists<n - 1>."""
    place = lambda order: f"(row_number() over (partition by profile_id, list order by {order}, term))::int"
    columns = "profile_id, list, term, net, jobs, first_seen, place"
    return f"""fb{n} as materialized (select *, {_WEIGHT} as weight from feedback where {where}),
  pj{n} as (select profile_id, job_id, sum(weight) as w, sum(case when rating >= 4 or applied then weight when rating <= 2 then -abs(weight) else 0 end) as d, bool_or(weight <> 0) as heard, min(created_at::date) as first from fb{n} group by all),
  {_weights(n, 'tw', 'job_term')}, {_weights(n, 'fw', 'firm_term')},
  all{n} as materialized (select t.* replace (coalesce(k.first_seen, t.first_seen) as first_seen), x.term is not null as was from tw{n} t left join (select * from lists{n - 1} where list = 'known') k on k.profile_id = t.profile_id and k.term = t.term
    left join (select * from lists{n - 1} where list = 'exclusion') x on x.profile_id = t.profile_id and x.term = t.term),
  boost{n} as (select *, case when title_like then 'title' when location_like then 'location' else 'keyword' end as list from all{n} where not frequent and net >= 1.5 and jobs >= 2),
  lists{n} as materialized (select profile_id, 'known' as list, term, net, jobs, first_seen, null::int as place from all{n} where not frequent
    union all select {columns} from (select *, {place('net desc')} as place from boost{n}) where place <= case list when 'title' then 20 when 'location' then 10 else 30 end
    union all select {columns} from (select *, 'exclusion' as list, {place('net')} as place from (select *, 'exclusion' as list from all{n} where not frequent and case when was then net <= -1 else net <= -2 and jobs >= 2 end)) where place <= 40
    union all select {columns} from (select *, {place('net')} as place from (select *, 'employer' as list from fw{n} where net <= -2 and jobs >= 2))
    union all select {columns} from (select *, {place('score desc')} as place from (select *, 'discovery' as list from all{n} where score > 0 and term not in ('{"','".join(_BASELINE)}') and term <> 'emp' || profile_id)) where place <= 12),
  print{n} as (select profile_id, sha256(string_agg(list || ':' || terms, ';' order by list || ':' || terms)) as fingerprint from (select profile_id, list, string_agg(term, ',' order by term) as terms from lists{n} where list <> 'known' group by all) group by profile_id),
  state{n} as materialized (select p.profile_id, (coalesce(s.version, 0) + (p.fingerprint is distinct from s.fingerprint)::int)::int as version, p.fingerprint, p.feedback, p.fingerprint is distinct from s.fingerprint as changed,
      (select count(*) from lists{n} l where l.profile_id = p.profile_id and l.list in ('title', 'location', 'keyword') and not exists (select 1 from lists{n - 1} k where k.list = 'known' and k.profile_id = l.profile_id and k.term = l.term)) as added
    from (select c.profile_id, c.feedback, coalesce(q.fingerprint, sha256('')) as fingerprint from (select profile_id, count(*) as feedback from fb{n} group by all) c left join print{n} q using (profile_id)) p left join state{n - 1} s using (profile_id))"""


_NOTHING = """lists0 as (select null::bigint as profile_id, null::varchar as list, null::varchar as term, null::double as net, null::bigint as jobs, null::date as first_seen, null::int as place where false),
  state0 as (select null::bigint as profile_id, null::int as version, null::varchar as fingerprint where false)"""
_RUNS = ["feedback_id % 3 <> 0", "true", "true"]


def _baseline(t: Tables) -> DataFrame:
    own = t.feedback.select("profile_id").distinct().select("profile_id", F.concat(F.lit("emp"), F.col("profile_id").cast("string")).alias("term"))
    return own.union(t.spark.createDataFrame([(None, x) for x in _BASELINE], "profile_id long, term string"))


def _learning(t: Tables, runs: list[str]) -> list[tuple[DataFrame, DataFrame]]:
    """What each of the runs over some feedback gives, each from the one before."""
    lists, state = t.spark.createDataFrame([], learning.LISTS), t.spark.createDataFrame([], learning.STATE)
    out, terms = [], learning.terms_of(t.job)
    for where in runs:
        lists, state = learning.run(t.feedback.where(where), t.job, lists, state, _baseline(t), F.lit(_AS_OF).cast("timestamp_ntz"), terms=terms)
        out.append((lists, state))
    return out


@query(f"with {_TERMS}, {_NOTHING}, {_learned(1, 'true')} select profile_id, list, term, place, round(net, 4) as net, jobs from lists1 where list <> 'known'")
def learned_lists(t: Tables) -> DataFrame:
    """The lists of a first run over all feedback, each with its cap."""
    lists, _ = _learning(t, ["true"])[0]
    return lists.where("list <> 'known'").select("profile_id", "list", "term", "place", F.round("net", 4).alias("net"), "jobs")


@query(f"""with {_TERMS}, {_NOTHING}, {", ".join(_learned(k, where) for k, where in enumerate(_RUNS, 1))}
  """ + " union all ".join(f"select {k} as run, profile_id, 'list' as kind, list || ':' || term as id, concat_ws('|', strftime(first_seen, '%Y-%m-%d'), place) as value from lists{k} union all select {k}, profile_id, 'state', 'version', concat_ws('|', version, fingerprint, feedback, changed, added) from state{k}" for k in range(1, len(_RUNS) + 1)))
def learning_run(t: Tables) -> DataFrame:
    """Three runs in a row: over two thirds of the feedback, over all, and over all again, which changes no version."""
    parts = []
    for k, (lists, state) in enumerate(_learning(t, _RUNS), 1):
        run, who = F.lit(k).alias("run"), F.col("profile_id")
        parts.append(lists.select(run, who, F.lit("list").alias("kind"), F.concat_ws(":", "list", "term").alias("id"), F.concat_ws("|", F.date_format("first_seen", "yyyy-MM-dd"), F.col("place").cast("string")).alias("value")))
        parts.append(state.select(run, who, F.lit("state").alias("kind"), F.lit("version").alias("id"), _line(*map(F.col, ["version", "fingerprint", "feedback", "changed", "added"]))))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_SHORT, _CLAIMS = 300, 120


def _enriching(n: int) -> str:
    """SQL of batch n: queue<n>, texts<n> and what was tried, from batch n - 1; its moment is 13:00 plus n hours."""
    now = f"(timestamp '2024-03-20 13:00:00' + interval {n} hour)"
    return f"""jobs{n} as materialized (select job_id, {"status = 'active'" if n == 1 else "status = 'active' and job_id % 10 <> 1"} as active, case when job_id % 2 = 0 then 'static' else 'detail' end as enricher, {"'h' || (n_chars % 9)" if n == 1 else "case when job_id % 6 = 0 then 'g' else 'h' end || (n_chars % 9)"} as hash,
      coalesce(t.description, substr(j.description, 1, (n_chars % 700)::int)) as description, t.description is not null as enriched from job j left join texts{n - 1} t using (job_id)),
  new{n} as materialized (select job_id, enricher, hash, 'queued' as status, 0 as attempts, {now} as next_at from jobs{n} j where active and length(trim(description)) < {_SHORT} and not exists (select 1 from queue{n - 1} q where q.job_id = j.job_id and q.enricher = j.enricher and q.hash = j.hash)),
  open{n} as materialized (select q.* replace (case when not active then 'cancelled' else q.status end as status) from (select job_id, enricher, hash, status, attempts, next_at from queue{n - 1} where status in ('queued', 'retry') union all select * from new{n}) q join jobs{n} j using (job_id)),
  due{n} as (select *, attempts + 1 as attempt, (job_id + {n}) % 5 as kind from open{n} where status <> 'cancelled' and next_at <= {now} order by next_at, job_id, enricher, hash limit {_CLAIMS}),
  tried{n} as materialized (select d.*, case kind when 0 then 'skipped' when 1 then 'failed' else 'completed' end as ended, kind > 1 and j.hash = d.hash and not enriched and length(j.description) < {_SHORT} as applied from due{n} d join jobs{n} j using (job_id)),
  queue{n} as materialized (select job_id, enricher, hash, case when ended <> 'failed' then 'completed' when attempt < 3 then 'retry' else 'failed' end as status, attempt as attempts, case when ended = 'failed' and attempt < 3 then {now} + interval 30 minute else next_at end as next_at, {n} as batch from tried{n}
    union all select o.job_id, o.enricher, o.hash, o.status, o.attempts, o.next_at, {n} from open{n} o where not exists (select 1 from tried{n} t where t.job_id = o.job_id and t.enricher = o.enricher and t.hash = o.hash)
    union all select * from queue{n - 1} where status not in ('queued', 'retry')),
  texts{n} as materialized (select job_id, repeat('e', 350) || job_id as description from tried{n} where applied union all select * from texts{n - 1} p where not exists (select 1 from tried{n} t where t.job_id = p.job_id and applied))"""


_ENRICHED = f"""texts0 as (select null::bigint as job_id, null::varchar as description where false), queue0 as (select null::bigint as job_id, null::varchar as enricher, null::varchar as hash, null::varchar as status, null::int as attempts, null::timestamp as next_at, null::int as batch where false),
  {", ".join(_enriching(n) for n in (1, 2, 3))}"""


@query(f"""with {_ENRICHED} select 'text' as kind, job_id::varchar as id, md5(description) as value from texts3
  union all select 'queue', concat_ws('/', job_id, enricher, hash), concat_ws('|', status, attempts, strftime(next_at, '%H:%M'), batch) from queue3
  """ + " ".join(f"""union all select 'attempt', concat_ws('/', job_id, enricher, hash, {n}), concat_ws('|', attempt, ended) from tried{n}
  union all select 'run', '{n}', concat_ws('|', (case when count(*) filter (where ended = 'failed') > 0 then 'failed' else 'completed' end), (select count(*) from new{n}), count(*) filter (where ended <> 'failed'), count(*) filter (where applied), count(*) filter (where ended = 'failed'), (select count(*) from open{n} where status = 'cancelled')) from tried{n}""" for n in (1, 2, 3)))
def enrichment_batch(t: Tables) -> DataFrame:
    """The state after three batches an hour apart, of which the last runs twice: some inputs change and some listings go
    after the first; of the rows tried some have no result, some fail, some results are for an older input."""
    k, n = F.col("job_id"), F.col("n_chars")
    text = lambda c: c.cast("string")
    enricher = F.when(k % 2 == 0, "static").otherwise("detail").alias("enricher")
    versions = Versions(t.spark, f"{shared_folder(t.spark)}/enrichment-{uuid.uuid4().hex}")
    for batch in (1, 2, 3, 3):
        letter = F.lit("h") if batch == 1 else F.when(k % 6 == 0, "g").otherwise("h")
        active = (F.col("status") == "active") & (F.lit(batch == 1) | (k % 10 != 1))
        jobs = t.job.select("job_id", active.alias("active"), enricher, F.concat(letter, text(n % 9)).alias("hash"), F.substring("description", F.lit(1), (n % 700).cast("int")).alias("description"))
        kind = (k + batch) % 5
        every = t.job.select("job_id", enricher, F.explode(F.array(F.concat(F.lit("h"), text(n % 9)), F.concat(F.lit("g"), text(n % 9)))).alias("hash"))
        results = every.where(kind != 0).select(
            "job_id", "enricher", "hash", F.when(kind > 1, F.concat(F.repeat(F.lit("e"), 350), text(k))).alias("text"), (k % 9).cast("int").alias("confidence"), F.when(kind == 1, "no answer").alias("error"))
        now = F.lit(f"2024-03-20 {13 + batch}:00:00").cast("timestamp_ntz")
        enrichment.enrich(versions, batch, jobs, results, now, _SHORT, _CLAIMS)
    c = F.col
    row = lambda rows, kind, ids, *cs: rows.select(F.lit(kind).alias("kind"), F.concat_ws("/", *(text(c(i)) for i in ids)).alias("id"), _line(*cs))
    parts = [
        row(versions.read("texts", enrichment.TEXTS), "text", ["job_id"], F.md5("description")),
        row(versions.read("queue", enrichment.QUEUE), "queue", enrichment.KEY, c("status"), c("attempts"), F.date_format("next_at", "HH:mm"), c("batch")),
        row(versions.read("attempts", enrichment.ATTEMPTS), "attempt", [*enrichment.KEY, "batch"], c("attempt"), c("status")),
        row(versions.read("runs", enrichment.RUNS), "run", ["batch"], *map(c, ["status", "queued", "processed", "applied", "failed", "cancelled"]))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
