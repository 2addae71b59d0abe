"""Queries over listings and recommendations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..operators import gates, ranking, scoring, state
from . import flagship
from .binding import Tables
from .registry import query



def as_of() -> Column:
    """The moment that stands for now."""
    return F.lit("2024-03-20 00:00:00").cast("timestamp_ntz")

_AS_OF = "timestamp '2024-03-20 00:00:00'"
_NORM = "trim(regexp_replace(lower(coalesce({}, '')), '[^0-9a-zåäö]+', ' ', 'g'))"
_TOKENS = "list_distinct(regexp_extract_all(replace(lower(coalesce({}, '')), 'ß', 'ss'), '[0-9a-zåäö]+'))"


def _any(column: str, marks: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{m}')" for m in marks) + ")"


def _first(column: str, marks: list[str]) -> str:
    return "case " + " ".join(f"when contains({column}, '{m}') then '{m}'" for m in marks) + " end"


@query("select source_name, external_id, title, employer, location, strftime(published_at, '%Y-%m-%d') as day from listing")
def scan_listings(t: Tables) -> DataFrame:
    return t.listing.select("source_name", "external_id", "title", "employer", "location", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query("select page_id, url, length(html) as n from pages where html like '%<article%'")
def scan_pages(t: Tables) -> DataFrame:
    return t.pages.where(F.contains("html", F.lit("<article"))).select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("""with shards as (select n_chars % 500 as id, doc_id as seq, title from listing)
  select id, arg_max(title, seq) as title, max(seq) as seq from shards group by id""")
def shard_union_latest(t: Tables) -> DataFrame:
    shards = t.listing.select((F.col("n_chars") % 500).alias("id"), F.col("doc_id").alias("seq"), "title")
    return state.latest(shards, ["id"], "seq").select("id", "title", "seq")


@query("""with rows as (select n_chars % 300 as id, case when doc_id % 2 = 0 then 1 else 2 end as pass, doc_id as pos, title, published_at from listing)
  select id, arg_min(title, pass * 1000000 + pos) as title, max(published_at) as newest from rows group by id""")
def two_pass_union(t: Tables) -> DataFrame:
    rows = t.listing.select((F.col("n_chars") % 300).alias("id"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("pass"), F.col("doc_id").alias("pos"), "title", "published_at")
    return rows.groupBy("id").agg(F.min_by("title", F.struct("pass", "pos")).alias("title"), F.max("published_at").alias("newest"))


@query("""select coalesce(o.source_name, n.source_name) as source_name, o.source_name is not null as known, coalesce(n.enabled, false) as enabled
  from (select source_name from source_dim where source_id % 3 <> 0) o full join (select source_name, enabled from source_dim where source_id % 4 <> 0) n on o.source_name = n.source_name""")
def source_dim(t: Tables) -> DataFrame:
    old = t.source_dim.where("source_id % 3 <> 0").select("source_name", F.lit(True).alias("known"))
    new = t.source_dim.where("source_id % 4 <> 0").select("source_name", "enabled")
    return old.join(new, "source_name", "full").select("source_name", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("enabled", F.lit(False)).alias("enabled"))


@query("select l.doc_id as job_id, coalesce(d.lang, 'unspecified') as stratum, l.quality = 1 as relevant from labels l join documents d on l.doc_id = d.doc_id where l.quality in (0, 1)")
def labels_clean(t: Tables) -> DataFrame:
    rows = t.labels.where(F.col("quality").isin(0, 1)).join(t.documents.select("doc_id", "lang"), "doc_id")
    return rows.select(F.col("doc_id").alias("job_id"), F.coalesce("lang", F.lit("unspecified")).alias("stratum"), (F.col("quality") == 1).alias("relevant"))


@query("select kind, count(*) as n from (select regexp_extract('level=info event=' || event_type || ' id=' || event_id, 'event=(\\S+)', 1) as kind from events) group by kind")
def event_type_parse(t: Tables) -> DataFrame:
    message = F.concat(F.lit("level=info event="), "event_type", F.lit(" id="), "event_id")
    return t.events.groupBy(F.regexp_extract(message, r"event=(\S+)", 1).alias("kind")).agg(F.count("*").alias("n"))


@query(f"select doc_id, {_NORM.format('title')} as title, {_NORM.format('location')} as location from listing")
def normalize_text(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", T.normalized(F.col("title")).alias("title"), T.normalized(F.col("location")).alias("location"))


@query(f"select doc_id, len(toks) as n, array_to_string(list_sort(toks), ' ') as tokens from (select doc_id, {_TOKENS.format('title')} as toks from listing)")
def token_sets(t: Tables) -> DataFrame:
    toks = t.listing.select("doc_id", T.tokens(F.col("title")).alias("toks"))
    return toks.select("doc_id", F.size("toks").cast("long").alias("n"), F.array_join(F.array_sort("toks"), " ").alias("tokens"))


_ENDS = "['" + "','".join(fixed.SUFFIXES) + "']"
_LEMMA = "map([" + ",".join(f"'{k}'" for k in fixed.LEMMAS) + "],[" + ",".join(f"'{v}'" for v in fixed.LEMMAS.values()) + "])"


@query(f"""with tok as (select distinct unnest({_TOKENS.format('title')}) as token from listing),
  cut as (select token, unnest({_ENDS}) as e from tok),
  var as (select token, token as variant from tok union select token, substr(token, 1, length(token) - length(e)) from cut where length(token) >= 7 and ends_with(token, e) and length(token) - length(e) >= 5
          union select token, {_LEMMA}[token] from tok where {_LEMMA}[token] is not null)
  select token, count(*) as n, string_agg(variant, ' ' order by variant) as variants from var group by token""")
def token_variants(t: Tables) -> DataFrame:
    toks = t.listing.select(F.explode(T.tokens(F.col("title"))).alias("token")).distinct()
    found = T.token_variants(F.col("token"))
    return toks.select("token", F.size(found).cast("long").alias("n"), F.array_join(F.array_sort(found), " ").alias("variants"))


@query(f"select doc_id, contains(' ' || {_NORM.format('description')} || ' ', ' of the ') as found from listing")
def phrase_match(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", T.has_phrase(T.normalized(F.col("description")), F.lit("of the")).alias("found"))


@query("""with s as (select doc_id, generate_subscripts(parts, 1) - 1 as pos, unnest(parts) as sentence from
    (select doc_id, list_filter(list_transform(string_split_regex(coalesce(description, ''), '[.!?\\n;]+'), lambda x: trim(x)), lambda x: x <> '') as parts from listing))
  select doc_id, cast(pos as int) as pos, md5(sentence) as sentence from s""")
def sentence_split(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", F.posexplode(T.sentences(F.col("description"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("sentence"))


_MODE_TEXT = "replace(lower(concat_ws(' ', title, case n_chars % 4 when 0 then 'hybridi' when 1 then 'fully remote' when 2 then 'etätyö: ei' end, description)), 'ß', 'ss')"


@query(f"""with m as (select doc_id, {_first('x', fixed.REMOTE_NEGATED)} as no, {_first('x', fixed.FULL_REMOTE)} as yes, {_first('x', fixed.HYBRID)} as part, {_first('x', fixed.REMOTE_POSSIBLE)} as may from (select doc_id, {_MODE_TEXT} as x from listing))
  select doc_id, case when no is not null then 'none' when yes is not null and part is not null then 'unknown' when yes is not null then 'full_remote' when part is not null then 'hybrid' else 'unknown' end as mode,
    coalesce(no, yes, part, may) as evidence from m""")
def work_mode(t: Tables) -> DataFrame:
    mark = F.when(F.col("n_chars") % 4 == 0, "hybridi").when(F.col("n_chars") % 4 == 1, "fully remote").when(F.col("n_chars") % 4 == 2, "etätyö: ei")
    mode = T.work_mode(T.folded(F.concat_ws(" ", "title", mark, "description")))
    return t.listing.select("doc_id", mode.alias("m")).select("doc_id", "m.mode", "m.evidence")


@query("select doc_id, " + "coalesce(" + ", ".join(f"case when contains(lower(location), '{a}') then '{c}' end" for a, c in fixed.CITY_ALIASES.items()) + ", "
       + ", ".join(f"case when regexp_matches(location, '(?i)(^|[^A-Za-zÅÄÖåäö]){c}(ssa|ssä|sta|stä|an|en|in)?([^A-Za-zÅÄÖåäö]|$)') then '{c}' end" for c in fixed.CITIES) + ") as city from listing")
def infer_city(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", T.city_of(F.col("location")).alias("city"))


@query("select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as text from pages")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(T.without_markup(F.col("html"))).alias("text"))


@query("select doc_id from listing where published_at is null or published_at > timestamp '2024-03-01 00:00:00'")
def watermark_filter(t: Tables) -> DataFrame:
    return t.listing.where("published_at is null or published_at > timestamp_ntz'2024-03-01 00:00:00'").select("doc_id")


@query("""select doc_id, source_id, published_at from (select *, max(case when published_at <= timestamp '2024-02-01' then 1 else 0 end) over (partition by source_id order by doc_id rows unbounded preceding) as known from listing) where known = 0""")
def watermark_prefix(t: Tables) -> DataFrame:
    mark = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return gates.prefix_until_known(t.listing, mark, "source_id", "doc_id").select("doc_id", "source_id", "published_at")


@query("select job_id, title, employer from job where status = 'active' and title ilike '%the%' and lower(location) like '%oulu%' and published_at >= timestamp '2024-02-01'")
def catalog_search(t: Tables) -> DataFrame:
    rows = t.job.where((F.col("status") == "active") & F.col("title").ilike("%the%") & F.contains(F.lower("location"), F.lit("oulu")))
    return rows.where("published_at >= timestamp_ntz'2024-02-01 00:00:00'").select("job_id", "title", "employer")


@query("select job_id from job where regexp_matches(location, '(?i)(^|[\\s,/])(oulu|ylivieska)([\\s,/]|$)')")
def pool_local(t: Tables) -> DataFrame:
    return gates.located_in(t.job, ["oulu", "ylivieska"]).select("job_id")


@query(f"select job_id from (select job_id, replace(lower(concat_ws(' ', location, title, description)), 'ß', 'ss') as x from job) where {_any('x', [*fixed.FULL_REMOTE, '/ etä'])} and not {_any('x', fixed.REMOTE_NEGATED)}")
def pool_remote(t: Tables) -> DataFrame:
    return gates.remote_pool(t.job).select("job_id")


_BAD = "','".join(fixed.GENERIC_TERMS + fixed.DISCOVERY_EXCLUDED)


@query(f"""with w as (select item_id as profile_id, unnest(range(len(ws))) as pos, unnest(ws) as term from (select item_id, string_split(text, ' ') as ws from benchmark)),
  f as (select profile_id, pos, trim(lower(term)) as term from w),
  g as (select profile_id, term, min(pos) as pos from f where length(term) >= 5 and term not in ('{_BAD}') group by all)
  select * from (select profile_id, term, cast(row_number() over (partition by profile_id order by pos, term) as int) as place from g) where place <= 80""")
def discovery_terms(t: Tables) -> DataFrame:
    terms = t.benchmark.select(F.col("item_id").alias("profile_id"), F.posexplode(F.split("text", " ")).alias("pos", "term"))
    return gates.discovery_terms(terms).select("profile_id", "term", "place")


@query("""with x as (select job_id, lower(concat(title, case n_chars % 4 when 0 then ' aineenopettaja' when 1 then ' CE-ajokortti' when 2 then ' henkilökohtainen avustaja' else '' end)) as t from job),
  h as (select job_id, list_filter([""" + ", ".join(f"case when regexp_matches(t, '{'|'.join(p)}') then '{k}' end" for k, p in fixed.QUALIFICATION_PATTERNS.items())
       + ", " + ", ".join(f"case when contains(' ' || {_NORM.format('t')} || ' ', ' {p} ') then '{p}' end" for p in fixed.QUALIFICATION_PHRASES) + """], lambda v: v is not null) as hits from x)
  select job_id, array_to_string(list_sort(hits), ',') as labels from h where len(hits) > 0""")
def qualification_regex(t: Tables) -> DataFrame:
    extra = F.when(F.col("n_chars") % 4 == 0, " aineenopettaja").when(F.col("n_chars") % 4 == 1, " CE-ajokortti").when(F.col("n_chars") % 4 == 2, " henkilökohtainen avustaja").otherwise("")
    hits = t.job.select("job_id", gates.missing_qualifications(F.lower(F.concat("title", extra))).alias("hits"))
    return hits.where(F.size("hits") > 0).select("job_id", F.array_join("hits", ",").alias("labels"))


_VARIANTS = f"select {{0}}, v0 as base, v0 as variant from {{1}} union select {{0}}, v0, substr(v0, 1, length(v0) - length(e)) from (select *, unnest({_ENDS}) as e from {{1}}) where length(v0) >= 7 and ends_with(v0, e) and length(v0) - length(e) >= 5"
_MATCHES = f"""jt as (select distinct job_id, unnest({_TOKENS.format("concat_ws(' ', title, employer, description)")}) as v0 from job), jv as ({_VARIANTS.format('job_id', 'jt')}),
  pt as (select profile_id, term as v0 from profile_term where term not in ('{"','".join(fixed.GENERIC_TERMS)}')), pv as ({_VARIANTS.format('profile_id', 'pt')}),
  hits as (select distinct jv.job_id, pv.profile_id, pv.base as term from jv join pv on jv.variant = pv.variant)"""


def _keywords(t: Tables) -> DataFrame:
    return t.profile_term.select("profile_id", F.lit("keyword").alias("field"), "term")


@query(f"with {_MATCHES} select profile_id, term, count(*) as jobs from hits group by all")
def term_matches(t: Tables) -> DataFrame:
    return scoring.term_matches(t.job, _keywords(t)).groupBy("profile_id", "term").agg(F.count("*").alias("jobs"))


_SCORED = f"{_MATCHES}, scored as (select job_id, profile_id, count(*) as keyword_n, least(count(*), 8) * 5 as score, count(*) >= 2 as lane from hits group by all)"


@query(f"with {_SCORED} select job_id, profile_id, keyword_n, score, case when lane then 'transferable_duty,exploration' else '' end as lanes from scored")
def match_score(t: Tables) -> DataFrame:
    scored = scoring.match_scores(scoring.term_matches(t.job, _keywords(t)))
    return scored.select("job_id", "profile_id", "keyword_n", "score", F.array_join("lanes", ",").alias("lanes"))


#: Quotas that some profiles have of their own: lane, quota, and the remainder of profiles that have it.
_QUOTAS = [("exploration", 5, 4, 1), ("exploration", 0, 4, 2), ("transferable_duty", 3, 3, 1), ("unknown", 9, 2, 0)]


def quota_overrides(t: Tables) -> DataFrame:
    """(profile_id, lane, quota): what some profiles set themselves."""
    who = t.profile_term.select("profile_id").distinct()
    parts = [who.where(F.col("profile_id") % by == left).select("profile_id", F.lit(lane).alias("lane"), F.lit(n).alias("quota")) for lane, n, by, left in _QUOTAS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _quota(lane: str) -> str:
    """SQL of a profile's quota of a lane."""
    least = 1 if lane == "exploration" else 0
    own = " ".join(f"when profile_id % {by} = {left} then {max(least, n)}" for of, n, by, left in _QUOTAS if of == lane)
    return f"(case {own} else {fixed.LANE_QUOTAS[lane]} end)" if own else str(fixed.LANE_QUOTAS[lane])


def lane_order(rows: str, lanes: dict[str, str]) -> str:
    """SQL of CTEs that order ``rows`` (profile_id, job_id, score, unpenalized): ``lane_place`` has a row for each, with its
    place. lanes: lane -> condition, in order. Each lane takes from what the ones before have left."""
    parts, before = [], "select null::bigint as profile_id, null::bigint as job_id, null::bigint as pos where false"
    for k, (lane, condition) in enumerate(lanes.items()):
        by = "unpenalized" if lane == "exploration" else "score"
        left = f"not exists (select 1 from got{k} g where g.profile_id = f.profile_id and g.job_id = f.job_id)"
        parts.append(f"got{k} as materialized ({before})")
        parts.append(f"of{k} as (select f.profile_id, f.job_id, row_number() over (partition by f.profile_id order by f.{by} desc, f.job_id) as r from {rows} f where {condition} and {left})")
        before = f"select * from got{k} union all select profile_id, job_id, {k} * 1000000 + r from of{k} where r <= {_quota(lane)}"
    parts.append(f"got as materialized ({before})")
    parts.append(f"lane_place as (select f.profile_id, f.job_id, row_number() over (partition by f.profile_id order by g.pos nulls last, f.score desc, f.job_id)::int as place from {rows} f left join got g on g.profile_id = f.profile_id and g.job_id = f.job_id)")
    return ", ".join(parts)


@query(f"""with {_SCORED}, b as (select job_id, profile_id, lane, score::double as unpenalized, greatest(0, score - 8 * (job_id % 4))::double as score from scored),
  {lane_order('b', {'transferable_duty': 'lane', 'exploration': 'lane'})} select profile_id, job_id, place from lane_place""")
def lane_quota_rank(t: Tables) -> DataFrame:
    # Every fourth row has no penalty; transferable_duty and then exploration hold the same rows.
    scored = scoring.match_scores(scoring.term_matches(t.job, _keywords(t)))
    left = F.greatest(F.lit(0), F.col("score") - 8 * (F.col("job_id") % 4))
    scored = scored.select("profile_id", "job_id", "lanes", F.col("score").cast("double").alias("unpenalized"), left.cast("double").alias("score"))
    return scoring.lane_quota_order(scored, overrides=quota_overrides(t))


@query("""with keyed as (select *, concat_ws('|', """ + ", ".join(_NORM.format(c) for c in ("title", "employer", "location")) + """, strftime(published_at, '%Y-%m-%d')) as k from job),
  pairs as (select a.job_id, min(b.job_id) as twin from keyed a join keyed b on a.k = b.k and a.source_id <> b.source_id and b.status = 'active' group by a.job_id)
  select job_id, twin from pairs""")
def cross_source_dedupe(t: Tables) -> DataFrame:
    keyed = t.job.withColumn("k", state.dedupe_key(t.job, T.normalized)).select("job_id", "source_id", "status", "k")
    others = keyed.where("status = 'active'").select("k", F.col("job_id").alias("twin"), F.col("source_id").alias("of"))
    # Two least ids of different sources per key answer for every source, so copies are not paired out.
    least = others.groupBy("k", "of").agg(F.min("twin").alias("twin")).groupBy("k").agg(F.min(F.struct("twin", "of")).alias("one"), F.collect_list(F.struct("twin", "of")).alias("all"))
    second = F.array_min(F.filter("all", lambda x: x["of"] != F.col("one.of")))
    least = least.select("k", "one", second.alias("two"))
    twin = F.when(F.col("source_id") != F.col("one.of"), F.col("one.twin")).otherwise(F.col("two.twin"))
    return keyed.join(least, "k").select("job_id", twin.alias("twin")).where("twin is not null")


@query("""with g as (select n_chars % 200 as k, title, employer, location from listing)
  select k, arg_min(trim(title), (-length(trim(title)), trim(title))) as title, arg_min(trim(employer), (-length(trim(employer)), trim(employer))) as employer,
    arg_min(trim(location), (-length(trim(location)), trim(location))) as location from g group by k""")
def canonical_merge(t: Tables) -> DataFrame:
    return state.canonical(t.listing.withColumn("k", F.col("n_chars") % 200), "k", "title", "employer", "location")


@query("select job_id, r.source_name, count(*) as n from job r join source_dim s using (source_id) where s.enabled group by all")
def job_occurrences(t: Tables) -> DataFrame:
    return t.job.join(t.source_dim.where("enabled").select("source_id"), "source_id").groupBy("job_id", "source_name").agg(F.count("*").alias("n"))


@query("select r.rec_id, j.title, f.rating from rec r join job j using (job_id) left join (select job_id, profile_id, max(rating) as rating from feedback group by all) f on f.job_id = r.job_id and f.profile_id = r.profile_id")
def recs_with_reviews(t: Tables) -> DataFrame:
    given = t.feedback.groupBy("job_id", "profile_id").agg(F.max("rating").alias("rating"))
    return t.rec.join(t.job.select("job_id", "title"), "job_id").join(given, ["job_id", "profile_id"], "left").select("rec_id", "title", "rating")


@query("select job_id from job j where status = 'active' and exists (select 1 from source_dim s where s.source_id = j.source_id and s.enabled)")
def visible_jobs(t: Tables) -> DataFrame:
    return t.job.where("status = 'active'").join(t.source_dim.where("enabled"), "source_id", "left_semi").select("job_id")


@query("select job_id from job j where not exists (select 1 from feedback f where f.job_id = j.job_id and f.rating <= 1)")
def unretrieved_jobs(t: Tables) -> DataFrame:
    return t.job.join(t.feedback.where("rating <= 1").select("job_id"), "job_id", "left_anti").select("job_id")


@query("""with e as (select title, source_name, doc_id, published_at from listing) select title, string_agg(distinct source_name, ',' order by source_name) as sources, arg_max(doc_id, published_at) as latest
  from (select title, source_name, doc_id, published_at + to_microseconds(doc_id) as published_at from e) group by title""")
def display_source(t: Tables) -> DataFrame:
    return t.listing.groupBy("title").agg(F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("sources"), F.max_by("doc_id", F.struct("published_at", "doc_id")).alias("latest"))


@query("select c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order, count(*) as n from customer join orders on c_custkey = o_custkey group by c_custkey")
def latest_per_group(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(last, "c_custkey")


@query("""with q as (select list(x order by i) as v from (select i, avg(x) as x from (select unnest(range(64)) as i, unnest(embedding) as x from embeddings where label = 0) group by i)),
  s as (select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * v[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) * list_sum(list_transform(v, lambda x: x * x))), 4) as sim from embeddings, q)
  select * from s order by sim desc, vec_id limit 25""")
def semantic_topk(t: Tables) -> DataFrame:
    q = scoring.centroids(t.embeddings.where("label = 0").withColumn("one", F.lit(1)), "one").select(F.col("centroid").alias("q"))
    # One row: the query vector.
    sim = F.round(scoring.cosine(F.col("embedding"), F.col("q")), 4)
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", sim.alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(25)


@query("select job_id from job where job_id not in (select vec_id from embeddings)")
def missing_vectors(t: Tables) -> DataFrame:
    return t.job.join(t.embeddings.select(F.col("vec_id").alias("job_id")), "job_id", "left_anti").select("job_id")


_ORDER = "order by case action when 'apply' then 0 when 'consider' then 1 else 2 end, review_score desc nulls last, machine_score desc, rec_id"


@query(f"""select rec_id, row_number() over (partition by profile_id {_ORDER})::int as nationwide,
  case when commutable then row_number() over (partition by profile_id, commutable {_ORDER})::int end as commute,
  case when commutable or remote then row_number() over (partition by profile_id, commutable or remote {_ORDER})::int end as commute_or_remote from rec""")
def rank_trio(t: Tables) -> DataFrame:
    action = F.when(F.col("action") == "apply", 0).when(F.col("action") == "consider", 1).otherwise(2)
    flags = {"nationwide": F.lit(True), "commute": F.col("commutable"), "commute_or_remote": F.col("commutable") | F.col("remote")}
    ranked = state.ranks_within(t.rec, "profile_id", flags, action, F.desc_nulls_last("review_score"), F.desc("machine_score"), F.col("rec_id"))
    return ranked.select("rec_id", *flags)


@query("""select r.rec_id from rec r join job j using (job_id) where not r.hard_rejected and j.status = 'active' and exists (select 1 from source_dim s where s.source_id = j.source_id and s.enabled)
  and not exists (select 1 from feedback f where f.job_id = r.job_id and f.profile_id = r.profile_id and f.rating <= 1) and (j.expires_at is null or j.expires_at >= timestamp '2024-03-20')""")
def structural_eligibility(t: Tables) -> DataFrame:
    open_ = t.job.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_of()))).join(t.source_dim.where("enabled"), "source_id", "left_semi")
    hidden = t.feedback.where("rating <= 1").select("job_id", "profile_id")
    return t.rec.where("not hard_rejected").join(open_.select("job_id"), "job_id", "left_semi").join(hidden, ["job_id", "profile_id"], "left_anti").select("rec_id")


@query("select profile_id, count(*) as total, count(*) filter (where commutable) as commutable, greatest(0, count(*) filter (where commutable or remote) - count(*) filter (where commutable)) as remote_only, greatest(0, count(*) - count(*) filter (where commutable or remote)) as elsewhere from rec group by profile_id")
def scope_counts(t: Tables) -> DataFrame:
    near, either = F.count_if("commutable"), F.count_if(F.col("commutable") | F.col("remote"))
    zero = F.lit(0)
    return t.rec.groupBy("profile_id").agg(F.count("*").alias("total"), near.alias("commutable"), F.greatest(zero, either - near).alias("remote_only"), F.greatest(zero, F.count("*") - either).alias("elsewhere"))


@query(f"select rec_id, place from (select rec_id, row_number() over (partition by profile_id {_ORDER})::int as place from rec where commutable or remote) where place between 11 and 30")
def scope_lists(t: Tables) -> DataFrame:
    action = F.when(F.col("action") == "apply", 0).when(F.col("action") == "consider", 1).otherwise(2)
    order = Window.partitionBy("profile_id").orderBy(action, F.desc_nulls_last("review_score"), F.desc("machine_score"), "rec_id")
    return t.rec.where("commutable or remote").select("rec_id", F.row_number().over(order).alias("place")).where("place between 11 and 30")


@query("select status, count(*) as n from job group by status")
def status_counts(t: Tables) -> DataFrame:
    return t.job.groupBy("status").agg(F.count("*").alias("n"))


def _inventory(t: Tables, jobs: DataFrame) -> DataFrame:
    rows = t.source_dim.select("source_id").join(jobs, "source_id", "left")
    return rows.groupBy("source_id").agg(F.count("job_id").alias("listings"), F.count_if(F.col("job_id").isNotNull() & F.col("expires_at").isNull()).alias("no_deadline"), F.count_distinct(F.when(F.col("status") == "active", F.col("employer"))).alias("employers"))


@query("select user_id as source_id, count(*) filter (where upper(event_type) = 'ERROR') as errors, count(*) filter (where upper(event_type) = 'CLICK') as warnings from events where ts >= timestamp '2024-01-15' - interval 7 day and ts < timestamp '2024-01-15' group by user_id")
def event_window_counts(t: Tables) -> DataFrame:
    end = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    rows = t.events.where((F.col("ts") >= end - F.expr("make_dt_interval(7)")) & (F.col("ts") < end))
    level = F.upper("event_type")
    return rows.groupBy(F.col("user_id").alias("source_id")).agg(F.count_if(level == "ERROR").alias("errors"), F.count_if(level == "CLICK").alias("warnings"))


@query("select count(*) as n, count(*) filter (where trim(coalesce(title, '')) = '') as no_title, count(*) filter (where length(description) < 200) as short, count(*) filter (where location like '%Etä%') as remote, count(*) filter (where expires_at is null) as no_deadline from job")
def catalog_audit(t: Tables) -> DataFrame:
    return t.job.agg(
        F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("title", F.lit(""))) == "").alias("no_title"), F.count_if(F.length("description") < 200).alias("short"),
        F.count_if(F.contains("location", F.lit("Etä"))).alias("remote"), F.count_if(F.col("expires_at").isNull()).alias("no_deadline"))


@query("select role, count(*) as calls, cast(coalesce(sum(length(text)), 0) as bigint) as chars, count(*) filter (where text is not null) as with_text from conversations group by role")
def usage_totals(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.count("text").alias("with_text"))


_WEIGHT = """(case when applied then 1.5 else ([-1.0, -0.5, 0.0, 0.5, 1.0])[rating] end)::double
  * power(0.5::double, (case when applied then 0.5 else 1 end) * greatest(0.0, date_diff('microsecond', created_at, timestamp '2024-04-01') / 86400000000.0) / 60.0)"""


@query(f"""with w as (select f.job_id, {_WEIGHT} as weight, j.employer from feedback f join job j using (job_id))
  select employer, round(sum(weight), 4) as net, count(distinct job_id) as jobs from w group by employer""")
def decayed_terms(t: Tables) -> DataFrame:
    weighed = scoring.decayed_weights(t.feedback, F.lit("2024-04-01 00:00:00").cast("timestamp_ntz"))
    rows = weighed.join(t.job.select("job_id", "employer"), "job_id")
    return rows.groupBy("employer").agg(F.round(F.sum("weight"), 4).alias("net"), F.count_distinct("job_id").alias("jobs"))


_WILSON = "round(greatest(0.0, (k * 1.0 / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 3)"


@query(f"with c as (select d.lang as stratum, count(*) filter (where l.quality = 1) as k, count(*) as n from labels l join documents d using (doc_id) group by d.lang) select stratum, k, n, {_WILSON} as lo, {_WILSON.replace('greatest(0.0', 'least(1.0').replace('- 1.96 * sqrt', '+ 1.96 * sqrt')} as hi from c")
def wilson_interval(t: Tables) -> DataFrame:
    counts = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("stratum")), "doc_id").groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return counts.withColumn("w", scoring.wilson(F.col("k"), F.col("n"))).select("stratum", "k", "n", "w.lo", "w.hi")


@query("""with s as (select d.lang as stratum, l.quality = 1 as relevant, r.rec_id is not null as retrieved, coalesce(not r.hard_rejected, false) as eligible, coalesce(r.review_score is not null, false) as reviewed, coalesce(r.action <> 'skip' and r.machine_score >= 40, false) as published
    from labels l join documents d using (doc_id) left join rec r on r.job_id = l.doc_id),
  x as (select stratum, relevant, unnest(['retrieved', 'eligible', 'reviewed', 'published']) as stage, unnest([retrieved, eligible, reviewed, published]) as hit from s)
  select stratum, stage, count(*) filter (where relevant) as positives, count(*) filter (where relevant and hit) as found, round(count(*) filter (where relevant and hit) * 1.0 / nullif(count(*) filter (where relevant), 0), 3) as recall from x group by all""")
def labelled_metrics(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("stratum")), "doc_id").join(t.rec, F.col("job_id") == F.col("doc_id"), "left")
    rows = rows.select("stratum", (F.col("quality") == 1).alias("relevant"), F.col("rec_id").isNotNull().alias("retrieved"), (~F.col("hard_rejected")).alias("eligible"), (F.col("rec_id").isNotNull() & F.col("review_score").isNotNull()).alias("reviewed"),
                       ((F.col("action") != "skip") & (F.col("machine_score") >= 40)).alias("published"))
    long = rows.unpivot(["stratum", "relevant"], ["retrieved", "eligible", "reviewed", "published"], "stage", "hit")
    positives, found = F.count_if("relevant"), F.count_if(F.col("relevant") & F.coalesce("hit", F.lit(False)))
    return long.groupBy("stratum", "stage").agg(positives.alias("positives"), found.alias("found"), F.round(F.try_divide(found, positives), 3).alias("recall"))


@query("select rec_id, sum(case when commutable then 1 else 0 end) over (partition by profile_id order by machine_score desc, rec_id rows unbounded preceding)::bigint as place from rec where commutable")
def running_ranks(t: Tables) -> DataFrame:
    along = Window.partitionBy("profile_id").orderBy(F.desc("machine_score"), "rec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.rec.where("commutable").select("rec_id", F.sum(F.col("commutable").cast("int")).over(along).alias("place"))


@query("select title, source_id, doc_id from (select title, source_id, doc_id, row_number() over (partition by title order by source_id % 5, published_at desc, doc_id) as r from listing) where r = 1")
def distinct_on(t: Tables) -> DataFrame:
    best = t.listing.groupBy("title").agg(F.min_by(F.struct("source_id", "doc_id"), F.struct(F.col("source_id") % 5, -F.unix_micros(F.col("published_at").cast("timestamp")), "doc_id")).alias("b"))
    return best.select("title", "b.source_id", "b.doc_id")


@query("""with i as (select *, sum(case when outcome = 'classified' then 1 else 0 end) over (partition by source_id order by ts, event_id rows unbounded preceding) as island from scan),
  m as (select *, sum(case when outcome = 'missing' then 1 else 0 end) over (partition by source_id, island order by ts, event_id rows unbounded preceding)::bigint as misses from i)
  select event_id, source_id, misses, case when misses >= 3 then 'closed' when outcome = 'classified' then 'classified' else 'pending' end as state from m""")
def scan_state_batch(t: Tables) -> DataFrame:
    return state.miss_runs(t.scan).select("event_id", "source_id", "misses", "state")


@query("select source_id, count(*) as frontier, count(*) filter (where outcome = 'classified') as classified, count(*) filter (where outcome <> 'classified') as pending, bool_and(outcome = 'classified') as drained from scan group by source_id")
def scan_progress(t: Tables) -> DataFrame:
    done = F.col("outcome") == "classified"
    return t.scan.groupBy("source_id").agg(F.count("*").alias("frontier"), F.count_if(done).alias("classified"), F.count_if(~done).alias("pending"), F.bool_and(done).alias("drained"))


@query("select count(*) as n, count(*) filter (where outcome <> 'classified') as open, round(date_diff('microsecond', min(ts) filter (where outcome <> 'classified'), timestamp '2024-04-01') / 3600000000.0, 1) as oldest_hours from scan")
def scan_backlog(t: Tables) -> DataFrame:
    open_ = F.col("outcome") != "classified"
    hours = F.timestamp_diff("MICROSECOND", F.min(F.when(open_, F.col("ts"))), F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")) / 3_600_000_000.0
    return t.scan.agg(F.count("*").alias("n"), F.count_if(open_).alias("open"), F.round(hours, 1).alias("oldest_hours"))


@query("select event_id from (select event_id, row_number() over (partition by source_id order by ts desc nulls last, event_id) as r from scan where outcome <> 'classified') where r <= 3")
def scan_claim(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc_nulls_last("ts"), "event_id"))
    return t.scan.where("outcome <> 'classified'").withColumn("r", place).where("r <= 3").select("event_id")


@query("""with m as (select url as external_id, page_id % 50 as lastmod, case page_id % 4 when 0 then 'closed' when 1 then 'classified' when 2 then 'absent' else 'pending' end as state from pages where page_id % 3 <> 0 and page_id < 10000000),
  e as (select url as external_id, page_id % 50 + (page_id % 2) as lastmod from pages where page_id % 5 <> 0)
  select coalesce(e.external_id, m.external_id) as external_id, coalesce(e.lastmod, m.lastmod) as lastmod,
    case when e.external_id is null then 'absent' when m.state is null or m.state in ('closed', 'absent') or m.lastmod is distinct from e.lastmod then 'pending' else m.state end as state
  from (select distinct on (external_id) * from m order by external_id, lastmod, state) m full join (select external_id, max(lastmod) as lastmod from e group by 1) e on e.external_id = m.external_id""")
def frontier_sync(t: Tables) -> DataFrame:
    kind = F.when(F.col("page_id") % 4 == 0, "closed").when(F.col("page_id") % 4 == 1, "classified").when(F.col("page_id") % 4 == 2, "absent").otherwise("pending")
    members = t.pages.where("page_id % 3 <> 0").select(F.col("url").alias("external_id"), (F.col("page_id") % 50).alias("lastmod"), kind.alias("state"))
    members = members.groupBy("external_id").agg(F.min(F.struct("lastmod", "state")).alias("m")).select("external_id", "m.*")
    entries = t.pages.where("page_id % 5 <> 0").groupBy(F.col("url").alias("external_id")).agg(F.max(F.col("page_id") % 50 + F.col("page_id") % 2).alias("lastmod"))
    return state.frontier_changes(entries, members)


@query("""with m as (select url, page_id % 7 as lastmod, page_id from pages) select regexp_extract(url, '/(\\d+)', 1) as external_id, max(lastmod) as lastmod, arg_max(url, (lastmod, url)) as url from m group by 1""")
def frontier_merge(t: Tables) -> DataFrame:
    rows = t.pages.select(F.regexp_extract("url", r"/(\d+)", 1).alias("external_id"), (F.col("page_id") % 7).alias("lastmod"), "url")
    return rows.groupBy("external_id").agg(F.max("lastmod").alias("lastmod"), F.max_by("url", F.struct("lastmod", "url")).alias("url"))


@query("""with s as (select *, sha256(concat_ws('|', title, employer, location)) as hash, concat_ws('|', """ + ", ".join(_NORM.format(c) for c in ("title", "employer", "location")) + """, strftime(published_at, '%Y-%m-%d')) as k from job),
  old as (select * from s where job_id % 2 = 0), inc as (select source_id, external_id, k, case when job_id % 10 = 4 then 'changed' else hash end as hash from s where job_id % 5 <> 0),
  first as (select k, min(job_id) as j, min(source_id) as lo, max(source_id) as hi from old group by k)
  select i.source_id, i.external_id, case when o.job_id is not null then (case when o.hash = i.hash then 'unchanged' else 'updated' end) when f.k is not null and (f.lo <> i.source_id or f.hi <> i.source_id) then 'deduplicated' else 'inserted' end as outcome,
    coalesce(o.job_id, case when f.lo <> i.source_id or f.hi <> i.source_id then f.j end) as job_id
  from inc i left join old o on o.source_id = i.source_id and o.external_id = i.external_id left join first f on f.k = i.k""")
def upsert_outcomes(t: Tables) -> DataFrame:
    rows = t.job.withColumns({"hash": F.sha2(F.concat_ws("|", "title", "employer", "location"), 256), "dedupe_key": state.dedupe_key(t.job, T.normalized)})
    old = rows.where("job_id % 2 = 0").select("source_id", "external_id", "hash", "dedupe_key", "job_id")
    new = rows.where("job_id % 5 <> 0").select("source_id", "external_id", "dedupe_key", F.when(F.col("job_id") % 10 == 4, "changed").otherwise(F.col("hash")).alias("hash"))
    return state.upsert_outcomes(new, old).select("source_id", "external_id", "outcome", "job_id")


@query("select job_id, published_at from job order by published_at desc nulls last, job_id limit 100")
def recent_jobs(t: Tables) -> DataFrame:
    return t.job.select("job_id", "published_at").orderBy(F.desc_nulls_last("published_at"), "job_id").limit(100)


@query("select job_id, title from job order by published_at desc nulls last, job_id limit 25 offset 50")
def catalog_page(t: Tables) -> DataFrame:
    return t.job.orderBy(F.desc_nulls_last("published_at"), "job_id").offset(50).limit(25).select("job_id", "title")


@query("select job_id, lang as stratum from (select job_id, lang, row_number() over (partition by lang order by md5(concat(job_id, 'seed-1'))) as r from job) where r <= 5")
def seeded_sample(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.col("job_id").cast("string"), F.lit("seed-1")))))
    return t.job.withColumn("r", place).where("r <= 5").select("job_id", F.col("lang").alias("stratum"))


@query("select job_id, length(description) as n from job where length(description) >= 500 order by n desc, job_id limit 20")
def longest_docs(t: Tables) -> DataFrame:
    return t.job.select("job_id", F.length("description").cast("long").alias("n")).where("n >= 500").orderBy(F.desc("n"), "job_id").limit(20)


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.missing'), 'none') as other from events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("select feedback_id, case when applied then 'applied' when rating >= 4 then 'like' when rating = 3 then 'neutral' else 'hide' end as action from feedback")
def rating_map(t: Tables) -> DataFrame:
    action = F.when(F.col("applied"), "applied").when(F.col("rating") >= 4, "like").when(F.col("rating") == 3, "neutral").otherwise("hide")
    return t.feedback.select("feedback_id", action.alias("action"))


@query("select source_id, enabled and (last is null or date_diff('microsecond', last, timestamp '2024-02-01') / 3600000000.0 > 48) as stale from source_dim left join (select user_id as sid, max(ts) as last from events where event_type <> 'error' group by user_id) e on e.sid = source_id")
def source_status(t: Tables) -> DataFrame:
    last = t.events.where("event_type <> 'error'").groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("last"))
    age = F.timestamp_diff("MICROSECOND", "last", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")) / 3_600_000_000.0
    return t.source_dim.join(last, "source_id", "left").select("source_id", (F.col("enabled") & (F.col("last").isNull() | (age > 48))).alias("stale"))


@query("select profile_id, feedback_id from (select profile_id, feedback_id, row_number() over (partition by profile_id, rating >= 4 order by created_at desc, feedback_id) as r, rating from feedback where rating >= 4 or rating <= 2) where r <= case when rating >= 4 then 3 else 2 end")
def few_shot(t: Tables) -> DataFrame:
    good = F.col("rating") >= 4
    place = F.row_number().over(Window.partitionBy("profile_id", good).orderBy(F.desc("created_at"), "feedback_id"))
    return t.feedback.where(good | (F.col("rating") <= 2)).withColumn("r", place).where(F.col("r") <= F.when(good, 3).otherwise(2)).select("profile_id", "feedback_id")


@query("select job_id, min(rec_id) as keep, count(*) as n from (select rec_id, job_id % 100 as job_id from rec) group by job_id")
def survivor_remap(t: Tables) -> DataFrame:
    return t.rec.groupBy((F.col("job_id") % 100).alias("job_id")).agg(F.min("rec_id").alias("keep"), F.count("*").alias("n"))


@query("select j.job_id from job j where j.job_id % 2 = 0 and not exists (select 1 from rec r where r.job_id = j.job_id and r.job_id % 3 = 0) and not exists (select 1 from job o where o.title = j.title and o.source_id <> j.source_id)")
def mark_removed(t: Tables) -> DataFrame:
    seen = t.rec.where("job_id % 3 = 0").select("job_id")
    # A title with listings of several sources is live elsewhere.
    elsewhere = t.job.groupBy("title").agg(F.min("source_id").alias("x"), F.max("source_id").alias("y")).where("x <> y").select("title")
    return t.job.where("job_id % 2 = 0").join(seen, "job_id", "left_anti").join(elsewhere, "title", "left_anti").select("job_id")


@query("""with r as (select user_id as source_id, max(ts) as newest, bool_or(event_type = 'error') as partial from events where ts < timestamp '2024-01-20' group by user_id), o as (select user_id as source_id, max(ts) as cursor from events where ts < timestamp '2024-01-10' group by user_id)
  select source_id, case when partial then cursor else greatest(coalesce(cursor, newest), newest) end as cursor from r left join o using (source_id)""")
def watermark_advance(t: Tables) -> DataFrame:
    run = t.events.where("ts < timestamp_ntz'2024-01-20 00:00:00'").groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("newest"), F.bool_or(F.col("event_type") == "error").alias("partial"))
    old = t.events.where("ts < timestamp_ntz'2024-01-10 00:00:00'").groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("cursor"))
    return run.join(old, "source_id", "left").select("source_id", F.when(F.col("partial"), F.col("cursor")).otherwise(F.greatest("cursor", "newest")).alias("cursor"))




@query("""with r as (select job_id, 'x' || (n_chars % 40) as h, n_chars % 9 as confidence from job where job_id % 3 = 1), s as (select job_id, 'x' || ((n_chars + case when job_id % 7 = 0 then 1 else 0 end) % 40) as h, length(description) as n, job_id % 5 = 0 as enriched, n_chars % 5 as old from job)
  select s.job_id, case when r.job_id is null then 'none' when r.h <> s.h then 'stale' when enriched and confidence < old then 'kept' when not enriched and n >= 1000 then 'kept' else 'applied' end as outcome from s left join r using (job_id)""")
def apply_enrichment(t: Tables) -> DataFrame:
    results = t.job.where("job_id % 3 = 1").select("job_id", F.concat(F.lit("x"), (F.col("n_chars") % 40).cast("string")).alias("result_hash"), (F.col("n_chars") % 9).alias("confidence"))
    stale = F.when(F.col("job_id") % 7 == 0, 1).otherwise(0)
    now = t.job.select("job_id", F.concat(F.lit("x"), ((F.col("n_chars") + stale) % 40).cast("string")).alias("hash"), F.length("description").alias("length"), (F.col("job_id") % 5 == 0).alias("enriched"), (F.col("n_chars") % 5).alias("old_confidence"))
    return state.enrichment_outcomes(now, results, 1000)


@query("""with o as (select doc_id, n_chars % 50 as job_id, description as text, source_id % 4 = 0 as enriched from listing)
  select job_id, arg_min(doc_id, (case when enriched then 0 else 1 end, -length(trim(text)), trim(text), doc_id)) as kept, count(*) as n from o group by job_id""")
def description_precedence(t: Tables) -> DataFrame:
    rows = t.listing.select("doc_id", (F.col("n_chars") % 50).alias("job_id"), F.col("description").alias("text"), (F.col("source_id") % 4 == 0).alias("enriched"))
    order = F.struct(F.when(F.col("enriched"), 0).otherwise(1), -F.length(F.trim("text")), F.trim("text"), F.col("doc_id"))
    return rows.groupBy("job_id").agg(F.min_by("doc_id", order).alias("kept"), F.count("*").alias("n"))


@query("""with q as (select event_id as id, case event_type when 'error' then 'running' when 'view' then 'pending' else 'retry' end as status, event_id % 5 as attempts, ts, user_id % 9 = 0 as inactive from events)
  select id, case when inactive then 'cancelled' when status = 'running' and ts < timestamp '2024-01-10' then 'pending' when status = 'retry' and attempts >= 3 then 'failed' else status end as status from q""")
def queue_transitions(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "view", "pending").otherwise("retry")
    q = t.events.select(F.col("event_id").alias("id"), kind.alias("status"), (F.col("event_id") % 5).alias("attempts"), "ts", (F.col("user_id") % 9 == 0).alias("inactive"))
    return state.queue_transitions(q, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("id", "status")


@query("select count(*) filter (where kind = 'running') as running, count(*) filter (where kind = 'running' and ts < timestamp '2024-01-10') as stale, count(*) filter (where kind = 'pending') as pending, min(ts) filter (where kind = 'pending') as oldest_due from (select ts, case event_type when 'error' then 'running' when 'view' then 'pending' else 'done' end as kind from events)")
def queue_health(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "view", "pending").otherwise("done")
    rows = t.events.select("ts", kind.alias("kind"))
    running, pending = F.col("kind") == "running", F.col("kind") == "pending"
    old = F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return rows.agg(F.count_if(running).alias("running"), F.count_if(running & old).alias("stale"), F.count_if(pending).alias("pending"), F.min(F.when(pending, F.col("ts"))).alias("oldest_due"))


@query("select event_id from (select event_id, row_number() over (partition by user_id order by event_id % 3, ts, event_id) as r from events where event_type = 'view' and ts <= timestamp '2024-01-20') where r <= 2")
def queue_claim(t: Tables) -> DataFrame:
    due = t.events.where("event_type = 'view' and ts <= timestamp_ntz'2024-01-20 00:00:00'")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id") % 3, "ts", "event_id"))
    return due.withColumn("r", place).where("r <= 2").select("event_id")


@query("""with plan as (select r.rec_id, r.profile_id, r.review_score is not null as hit, row_number() over (partition by r.profile_id order by r.machine_score desc, r.rec_id) as pos from rec r),
  n as (select *, sum(case when hit then 0 else 1 end) over (partition by profile_id order by pos rows unbounded preceding) as needed from plan) select rec_id, case when hit then 'hit' when needed <= 20 then 'evaluate' else 'deferred' end as status from n""")
def review_plan(t: Tables) -> DataFrame:
    rows = t.rec.select("rec_id", "profile_id", F.col("review_score").isNotNull().alias("hit"), "machine_score")
    return state.within_budget(rows, "profile_id", 20, F.desc("machine_score"), F.col("rec_id")).select("rec_id", "status")


@query("select r.rec_id, coalesce(f.worst > 1, true) and not r.hard_rejected as active from rec r left join (select job_id, profile_id, arg_max(rating, (created_at, feedback_id)) as worst from feedback group by all) f on f.job_id = r.job_id and f.profile_id = r.profile_id")
def feedback_visibility(t: Tables) -> DataFrame:
    last = state.latest(t.feedback.select("job_id", "profile_id", "created_at", "feedback_id", "rating"), ["job_id", "profile_id"], "created_at", "feedback_id")
    rows = t.rec.join(last.select("job_id", "profile_id", F.col("rating").alias("last")), ["job_id", "profile_id"], "left")
    return rows.select("rec_id", (F.coalesce(F.col("last") > 1, F.lit(True)) & ~F.col("hard_rejected")).alias("active"))


@query("""with e as (select vec_id as job_id, 'h' || (label % 3) as old from embeddings), j as (select job_id, 'h' || (n_chars % 3) as hash from job) select j.job_id, case when e.job_id is null then 'missing' else 'stale' end as why from j left join e using (job_id) where e.job_id is null or e.old <> j.hash""")
def stale_embeddings(t: Tables) -> DataFrame:
    old = t.embeddings.select(F.col("vec_id").alias("job_id"), F.concat(F.lit("h"), (F.col("label") % 3).cast("string")).alias("old"))
    now = t.job.select("job_id", F.concat(F.lit("h"), (F.col("n_chars") % 3).cast("string")).alias("hash"))
    return now.join(old, "job_id", "left").where("old is null or old <> hash").select("job_id", F.when(F.col("old").isNull(), "missing").otherwise("stale").alias("why"))


@query("select event_type as kind, arg_max(event_id, (ts, event_id)) as last_run, max(ts) as started from events group by event_type")
def latest_runs(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_run"), F.max("ts").alias("started"))


@query("select 'events' as tbl, count(*) filter (where ts < timestamp '2024-01-11') as old, count(*) as n from events union all select 'orders', count(*) filter (where o_orderdate < timestamp '1995-01-01'), count(*) from orders")
def retention_report(t: Tables) -> DataFrame:
    def part(table: DataFrame, name: str, at: str, cut: str) -> DataFrame:
        return table.agg(F.lit(name).alias("tbl"), F.count_if(F.col(at) < F.lit(cut).cast("timestamp_ntz")).alias("old"), F.count("*").alias("n"))

    return part(t.events, "events", "ts", "2024-01-11 00:00:00").unionByName(part(t.orders, "orders", "o_orderdate", "1995-01-01 00:00:00"))


@query("""with p as (select conv_id, sum(length(text)) filter (where role = 'user') as a, sum(length(text)) filter (where role = 'assistant') as b from conversations group by conv_id)
  select count(*) as pairs, case when count(a) = count(*) then sum(a)::bigint end as a_total, case when count(b) = count(*) then sum(b)::bigint end as b_total, round(avg(abs(a - b)), 3) as gap from p""")
def paired_comparison(t: Tables) -> DataFrame:
    side = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")))
    pairs = t.conversations.groupBy("conv_id").agg(side("user").alias("a"), side("assistant").alias("b"))
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    return pairs.agg(F.count("*").alias("pairs"), total("a").alias("a_total"), total("b").alias("b_total"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 3).alias("gap"))


@query(f"""with w as (select f.profile_id, j.employer, sum({_WEIGHT}) as net, count(distinct f.job_id) as jobs from feedback f join job j using (job_id) group by all)
  select profile_id, employer, round(net, 4) as net, case when net <= -2 and jobs >= 2 then 'exclude' when net > -1 then (case when net >= 1.5 and jobs >= 2 then 'boost' else 'none' end) else (case when length(employer) % 2 = 0 then 'exclude' else 'none' end) end as verdict from w""")
def learned_state(t: Tables) -> DataFrame:
    weighed = scoring.decayed_weights(t.feedback, F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")).join(t.job.select("job_id", "employer"), "job_id")
    net = weighed.groupBy("profile_id", "employer").agg(F.sum("weight").alias("net"), F.count_distinct("job_id").alias("jobs"))
    before = net.select("profile_id", "employer", (F.length("employer") % 2 == 0).alias("was_excluded"))
    return state.learned_verdicts(net.join(before, ["profile_id", "employer"], "left")).select("profile_id", "employer", F.round("net", 4).alias("net"), "verdict")


@query("""select o.k as job_id, string_agg(o.doc_id::varchar, ',' order by o.published_at desc, o.doc_id) as occurrences, count(*) as n from (select n_chars % 150 as k, doc_id, published_at from listing) o group by o.k""")
def job_detail_nested(t: Tables) -> DataFrame:
    rows = t.listing.select((F.col("n_chars") % 150).alias("job_id"), "doc_id", "published_at")
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "doc_id")))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(newest, lambda x: x["doc_id"].cast("string")), ",").alias("occurrences"), F.count("*").alias("n"))


@query("select l.doc_id as job_id, l.quality = 1 as relevant, r.rec_id is not null as has_row, coalesce(r.action <> 'skip', false) as published, coalesce(f.n > 0, false) as rated from labels l left join rec r on r.job_id = l.doc_id left join (select job_id, count(*) as n from feedback group by job_id) f on f.job_id = l.doc_id")
def stage_states(t: Tables) -> DataFrame:
    rated = t.feedback.groupBy("job_id").agg(F.lit(True).alias("rated"))
    rows = t.labels.select(F.col("doc_id").alias("job_id"), (F.col("quality") == 1).alias("relevant")).join(t.rec, "job_id", "left").join(rated, "job_id", "left")
    no = F.lit(False)
    return rows.select("job_id", "relevant", F.col("rec_id").isNotNull().alias("has_row"), F.coalesce(F.col("action") != "skip", no).alias("published"), F.coalesce("rated", no).alias("rated"))
