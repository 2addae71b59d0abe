"""Further queries over listings, feedback and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, listing as L, text as T
from ..operators import gates, scoring, state, upkeep
from . import flagship
from .binding import Tables
from .listings import _NORM, _any
from .registry import query

_MARKS = ["the ", "and "]


@query("""with s as (select doc_id, lower(unnest(list_filter(string_split_regex(description || '. Englannin kielen taito vaaditaan. Saksan kieli katsotaan eduksi. Ruotsin taitoa ei vaadita', '[.!?\\n;]+'), lambda x: trim(x) <> ''))) as x from listing)
  select doc_id, """ + f"count(*) filter (where {_any('x', fixed.STRONG_MARKERS)}) as strong, count(*) filter (where {_any('x', fixed.OPTIONAL_MARKERS)}) as optional, count(*) filter (where {_any('x', fixed.NEGATION_MARKERS)}) as negated from s group by doc_id")
def sentence_flags(t: Tables) -> DataFrame:
    whole = F.concat("description", F.lit(". Englannin kielen taito vaaditaan. Saksan kieli katsotaan eduksi. Ruotsin taitoa ei vaadita"))
    rows = t.listing.select("doc_id", F.explode(T.sentences(whole)).alias("x")).withColumn("x", F.lower("x"))
    count = lambda marks: F.count_if(T.has_any(F.col("x"), marks))
    return rows.groupBy("doc_id").agg(count(fixed.STRONG_MARKERS).alias("strong"), count(fixed.OPTIONAL_MARKERS).alias("optional"), count(fixed.NEGATION_MARKERS).alias("negated"))


@query("""with m as (select job_id, greatest(1, cast(ceil((n_chars * 7 % 20000) / 60.0) as bigint)) as m from job)
  select job_id, case when m // 60 = 0 then m || ' min' when m % 60 = 0 then (m // 60) || ' h' else (m // 60) || ' h ' || (m % 60) || ' min' end as took from m""")
def travel_text(t: Tables) -> DataFrame:
    return t.job.select("job_id", T.formatted_duration(F.col("n_chars") * 7 % 20000).alias("took"))


@query("select page_id, regexp_matches(id, '^[A-Za-z0-9_-]+$') and length(id) between 1 and 12 as valid from (select page_id, regexp_extract(url, '([^/]*)$', 1) as id from pages)")
def external_id_valid(t: Tables) -> DataFrame:
    ident = F.regexp_extract("url", "([^/]*)$", 1)
    return t.pages.select("page_id", (F.rlike(ident, F.lit("^[A-Za-z0-9_-]+$")) & F.length(ident).between(1, 12)).alias("valid"))


def _merged(events: DataFrame) -> DataFrame:
    old = F.from_json("props", "map<string,bigint>")
    made = F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,bigint>")), lambda k, v: k != "k"), F.create_map(F.lit("k"), F.coalesce(F.try_element_at(old, F.lit("k")), F.lit(0)) + 1, F.lit("owner"), F.col("user_id")))
    return events.select("event_id", made.alias("m")).select("event_id", F.col("m.k").alias("k"), F.col("m.owner").alias("owner"))


@query("select job_id from job where coalesce(published_at >= timestamp '2024-02-19', true)")
def freshness_read(t: Tables) -> DataFrame:
    return t.job.where("published_at is null or published_at >= timestamp_ntz'2024-02-19 00:00:00'").select("job_id")


_SIM = "list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * {0}.v[i])) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double)) * list_sum(list_transform({0}.v, lambda x: x * x)))"


@query("with m as (select label >= 7 as good, i, avg(x) as x from (select label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings where label >= 7 or label <= 2) group by all), "
       + "p as (select list(x order by i) as v from m where good), n as (select list(x order by i) as v from m where not good) select e.vec_id, round(" + _SIM.format("p") + ", 4) + 0.0 as liked, round(" + _SIM.format("n") + ", 4) + 0.0 as disliked from embeddings e, p, n")
def centroid_similarity(t: Tables) -> DataFrame:
    rows = t.embeddings.where("label >= 7 or label <= 2").withColumn("good", F.col("label") >= 7)
    both = scoring.centroids(rows, "good").groupBy().agg(F.max_by("centroid", F.when(F.col("good"), 1).otherwise(0)).alias("p"), F.max_by("centroid", F.when(F.col("good"), 0).otherwise(1)).alias("n"))
    # One row with both centroids.
    return t.embeddings.crossJoin(F.broadcast(both)).select("vec_id", (F.round(scoring.cosine(F.col("embedding"), F.col("p")), 4) + 0.0).alias("liked"), (F.round(scoring.cosine(F.col("embedding"), F.col("n")), 4) + 0.0).alias("disliked"))


@query("""with l as (select source_id, arg_max(outcome, (ts, event_id)) as outcome, max(ts) as ts from scan group by source_id) select source_id, case when outcome = 'missing' and date_diff('microsecond', ts, timestamp '2024-02-01') / 3600000000.0 > 48 then 'closed' when outcome = 'missing' then 'absent' else 'open' end as state from l""")
def scan_closure(t: Tables) -> DataFrame:
    last = t.scan.groupBy("source_id").agg(F.max_by("outcome", F.struct("ts", "event_id")).alias("outcome"), F.max("ts").alias("ts"))
    hours = F.timestamp_diff("MICROSECOND", "ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")) / 3_600_000_000.0
    return last.select("source_id", F.when((F.col("outcome") == "missing") & (hours > 48), "closed").when(F.col("outcome") == "missing", "absent").otherwise("open").alias("state"))


@query("""with r as (select job_id, profile_id, case when hard_rejected then 'hard' when action = 'skip' then 'deterministic' when review_score is null then 'not_reviewed' else 'ok' end as bucket from rec), n as (select *, row_number() over (partition by bucket order by md5(job_id::varchar)) as r from r)
  select bucket, job_id from n where r <= 6""")
def unretrieved_buckets(t: Tables) -> DataFrame:
    bucket = F.when(F.col("hard_rejected"), "hard").when(F.col("action") == "skip", "deterministic").when(F.col("review_score").isNull(), "not_reviewed").otherwise("ok")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.col("job_id").cast("string"))))
    return t.rec.select("job_id", bucket.alias("bucket")).withColumn("r", place).where("r <= 6").select("bucket", "job_id")


@query("select profile_id, rating as hint from (select profile_id, rating, row_number() over (partition by profile_id order by newest desc, rating) as r from (select profile_id, rating, max(created_at) as newest from feedback group by all)) where r <= 3")
def eval_hints(t: Tables) -> DataFrame:
    newest = t.feedback.groupBy("profile_id", "rating").agg(F.max("created_at").alias("newest"))
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("newest"), "rating"))
    return newest.withColumn("r", place).where("r <= 3").select("profile_id", F.col("rating").alias("hint"))


@query("""with v as (select *, not hard_rejected and action <> 'skip' and machine_score >= 40 as valid from rec)
  select rec_id, valid as active, case when valid then row_number() over (partition by profile_id, valid order by machine_score desc, rec_id) end::int as rank, review_score is not null and n_of % 3 = 0 as stale from (select v.*, rec_id as n_of from v)""")
def publication_refresh(t: Tables) -> DataFrame:
    rows = t.rec.withColumn("active", ~F.col("hard_rejected") & (F.col("action") != "skip") & (F.col("machine_score") >= 40))
    rows = state.ranks_within(rows, "profile_id", {"rank": F.col("active")}, F.desc("machine_score"), F.col("rec_id"))
    return rows.select("rec_id", "active", "rank", (F.col("review_score").isNotNull() & (F.col("rec_id") % 3 == 0)).alias("stale"))


@query("select job_id, min(doc_id) as occurrence from (select n_chars as job_id, doc_id from listing) group by job_id having count(*) = 1")
def occurrence_backfill(t: Tables) -> DataFrame:
    return t.listing.groupBy(F.col("n_chars").alias("job_id")).agg(F.min("doc_id").alias("occurrence"), F.count("*").alias("n")).where("n = 1").select("job_id", "occurrence")


@query("""with a as (select event_id % 400 as feedback_id, md5(event_type) as h, event_id from events where event_id % 2 = 0), f as (select event_id % 400 as feedback_id, arg_max(md5(event_type), event_id) as h from events group by 1), l as (select feedback_id, arg_max(h, event_id) as h from a group by 1)
  select f.feedback_id, case when l.h is null then 'missing' when l.h = f.h then 'reused' else 'stale' end as status from f left join l using (feedback_id)""")
def analysis_reuse(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("event_id") % 400).alias("feedback_id"), F.md5("event_type").alias("h"), "event_id")
    now = state.latest(rows, ["feedback_id"], "event_id").select("feedback_id", "h")
    made = state.latest(rows.where("event_id % 2 = 0"), ["feedback_id"], "event_id").select("feedback_id", F.col("h").alias("made"))
    return now.join(made, "feedback_id", "left").select("feedback_id", F.when(F.col("made").isNull(), "missing").when(F.col("made") == F.col("h"), "reused").otherwise("stale").alias("status"))


@query("with c as (select rec_id from rec where review_score is not null order by machine_score desc, rec_id limit 30) select profile_id, count(*) filter (where review_score is not null and rec_id not in (select rec_id from c)) as remaining, count(*) filter (where rec_id in (select rec_id from c)) as reset from rec group by profile_id")
def cohort_reset(t: Tables) -> DataFrame:
    cohort = t.rec.where("review_score is not null").orderBy(F.desc("machine_score"), "rec_id").limit(30).select("rec_id", F.lit(True).alias("picked"))
    rows = t.rec.join(cohort, "rec_id", "left")
    return rows.groupBy("profile_id").agg(F.count_if(F.col("review_score").isNotNull() & F.col("picked").isNull()).alias("remaining"), F.count_if("picked").alias("reset"))


_PACKED = """s as (select doc_id as job_id, case doc_id % 5 when 0 then 'source:' || source_id when 1 then 'source:' || (source_id + 1) when 2 then 'enriched:static:h' || (n_chars % 3) when 3 then 'enriched:other:h1' end as provenance from listing),
  o as (select doc_id * 10 + i as occurrence, doc_id as job_id, source_id + i % 2 as source_id, case when i <> 1 then published_at + to_days(i) end as seen from listing, (select unnest(range(4))::int as i)),
  e as (select doc_id * 10 + i as enrichment, doc_id as job_id, case when i = 2 then 'other' else 'static' end as enricher, 'h' || (i % 2) as hash, case when i <> 3 then published_at end as created from listing, (select unnest(range(5))::int as i))"""


@query(f"""with {_PACKED}, f as (select job_id, source_id, arg_max(occurrence, (seen is not null, seen, occurrence)) as occurrence from o group by all), g as (select job_id, enricher, hash, arg_max(enrichment, (created is not null, created, enrichment)) as enrichment from e group by all)
  select s.job_id, 'source' as kind, f.occurrence, null::bigint as enrichment from s join f on f.job_id = s.job_id and s.provenance = 'source:' || f.source_id
  union all select s.job_id, 'enriched', null, g.enrichment from s join g on g.job_id = s.job_id and s.provenance = 'enriched:' || g.enricher || ':' || g.hash""")
def provenance_split(t: Tables) -> DataFrame:
    """The migration of packed provenances: to the occurrence seen last or the enrichment made last; the rest goes."""
    k, text = F.col("doc_id"), lambda c: c.cast("string")
    packed = F.when(k % 5 == 0, F.concat(F.lit("source:"), text(F.col("source_id")))).when(k % 5 == 1, F.concat(F.lit("source:"), text(F.col("source_id") + 1)))
    packed = packed.when(k % 5 == 2, F.concat(F.lit("enriched:static:h"), text(F.col("n_chars") % 3))).when(k % 5 == 3, "enriched:other:h1")
    each = lambda n: t.listing.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i = F.col("i")
    seen = each(4).select((k * 10 + i).alias("occurrence"), k.alias("job_id"), (F.col("source_id") + i % 2).alias("source_id"), F.when(i != 1, F.col("published_at") + F.make_dt_interval(i)).alias("seen"))
    made = each(5).select((k * 10 + i).alias("enrichment"), k.alias("job_id"), F.when(i == 2, "other").otherwise("static").alias("enricher"), F.concat(F.lit("h"), text(i % 2)).alias("hash"), F.when(i != 3, F.col("published_at")).alias("created"))
    return upkeep.split_provenance(t.listing.select(k.alias("job_id"), packed.alias("provenance")), seen, made)
