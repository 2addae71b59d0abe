"""The whole match as a query, with its SQL: every step stated anew over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import scoring
from . import flagship
from .binding import Tables
from .listings import _AS_OF, _NORM, _TOKENS, _any, lane_order
from .registry import query
from .upkeep import _discovery
from .verdicts import _CHECKS, _DEMANDS, _PHRASE, _PLACES, _PLACED, _ROUTES, _SAID, _TITLES, _VARIANTS, _soft, _sql_chosen, _stems

_POSTING = f"""posting as materialized (select job_id, status, employer, location, published_at, expires_at, n_chars, concat({_sql_chosen(_TITLES, 'job_id')}, title) as title,
    description || '. ' || {_sql_chosen(_DEMANDS)} || '. ' || {_sql_chosen(_SAID)} as description from job),
  txt as materialized (select job_id, lower(concat_ws(' ', title, employer, description)) as low, {_NORM.format("concat_ws(' ', title, employer, description)")} as norm, {_NORM.format('title')} as titled from posting)"""

_SLOT = f"({flagship.SLOTS!r})[((length(term) * 3 + profile_id) % {len(flagship.SLOTS)}) + 1]"
_TOWN = f"({flagship.TOWNS!r})[(profile_id % {len(flagship.TOWNS)}) + 1]"
_WISHES = f"""who as (select distinct profile_id from profile_term), own as materialized (select profile_id, {_SLOT} as field, term from profile_term),
  said as (select distinct item_id as profile_id, regexp_extract(lower(text), '^[^0-9a-zåäö]*([0-9a-zåäö]+ [0-9a-zåäö]+)', 1) as first, regexp_extract(lower(text), '([0-9a-zåäö]+)[^0-9a-zåäö]*$', 1) as last from benchmark)"""

_NEWEST = "published_at desc nulls last, job_id desc"
_REMOTE = f"""select job_id from (select job_id, replace(lower(concat_ws(' ', location, title, description)), 'ß', 'ss') as x from posting) where {_any('x', [*fixed.FULL_REMOTE, '/ etä'])} and not {_any('x', fixed.REMOTE_NEGATED)}"""
_POOLS = f"""{_discovery().replace('from job)', 'from posting)')}, live as (select job_id, published_at, location from posting where status = 'active'),
  pool as (select profile_id, job_id, 0 as pool from (select job_id from live order by {_NEWEST} limit {flagship.CAPS['recent']}), who
    union all select profile_id, job_id, 1 from (select profile_id, job_id, row_number() over (partition by profile_id order by {_NEWEST}) as r from live, who where regexp_matches(location, '(?i)(^|[\\s,/])' || {_TOWN} || '([\\s,/]|$)')) where r <= {flagship.CAPS['local']}
    union all select profile_id, job_id, 2 from (select job_id from live semi join ({_REMOTE}) m using (job_id) order by {_NEWEST} limit {flagship.CAPS['remote']}), who
    union all select profile_id, job_id, 3 from (select profile_id, job_id, row_number() over (partition by profile_id order by {_NEWEST}) as r from (select distinct profile_id, job_id from x join terms on phrase <> '' and contains(txt, ' ' || phrase || ' ')) join live using (job_id)) where r <= {flagship.CAPS['discovery']}),
  cand as (select profile_id, job_id, min(pool) as pool from pool group by all),
  had as materialized (select r.*, k.review_key as had_key from rec r join (select job_id, sha256(to_json({{'employer': employer, 'n_chars': case when job_id % 5 = 0 then -1 else n_chars end, 'title': title}})) as review_key from posting) k using (job_id)),
  pairs as materialized (select coalesce(c.profile_id, h.profile_id) as profile_id, coalesce(c.job_id, h.job_id) as job_id, c.pool from cand c full join (select * from had where job_id % 5 = 0) h on c.profile_id = h.profile_id and c.job_id = h.job_id)"""

_FIELDS = [*scoring.POINTS, *scoring.LOCATIONS]
_IN_TITLE, _IN_PLACE = "field in ('title', 'history_title', 'learned_title')", "field in ('location', 'history_location', 'learned_location')"
_COUNTS = f"""ft as (select profile_id, field, term as v0 from own where field not in ('negative', 'caution', 'exclusion') and term not in ('{"','".join(fixed.GENERIC_TERMS)}')
    union all select profile_id, 'location', lower({_TOWN}) from who union all select profile_id, 'history_location', 'kuopio' from who where profile_id % 2 = 0 union all select profile_id, 'learned_location', 'helsinki' from who where profile_id % 3 = 0),
  fv as ({_VARIANTS.format('profile_id, field', 'ft')}),
  jt as (select job_id, 'text' as place, unnest({_TOKENS.format("concat_ws(' ', title, employer, description)")}) as v0 from posting union select job_id, 'title', unnest({_TOKENS.format('title')}) from posting union select job_id, 'location', unnest({_TOKENS.format('location')}) from posting),
  jv as ({_VARIANTS.format('job_id, place', 'jt')}),
  hits as (select distinct job_id, profile_id, field, fv.base as term from jv join fv on jv.variant = fv.variant and jv.place = case when {_IN_TITLE} then 'title' when {_IN_PLACE} then 'location' else 'text' end),
  counts as materialized (select job_id, profile_id, {", ".join(f"count(*) filter (where field = '{f}') as {f}_n" for f in _FIELDS)} from hits group by all)"""

_NAMED = {c: _any("x", n) for c, n in fixed.LANGUAGE_NAMES.items()}
_TOP = _any("x", fixed.NATIVE_MARKERS + fixed.EXCELLENT_MARKERS)
_MISSING = [f"case when regexp_matches(norm, '{'|'.join(p)}') then 1 else 0 end" for p in fixed.QUALIFICATION_PATTERNS.values()]
_MISSING += [f"case when contains(' ' || norm || ' ', ' {p} ') then 1 else 0 end" for p in fixed.QUALIFICATION_PHRASES]
_DENTIST, _SOCIAL = _PHRASE["hammaslääkäri"], _PHRASE["sosiaalityöntekijän kelpoisuus"]
_JOBS = f"""sentence as (select job_id, generate_subscripts(p, 1) as pos, lower(unnest(p)) as x from (select job_id, list_filter(list_transform(string_split_regex(coalesce(title, '') || '. ' || description, '[.!?\\n;]+'), lambda x: trim(x)), lambda x: x <> '') as p from posting)),
  spoken as (select s.job_id, l.code, arg_min(case when l.rule = 'reject' or {_TOP} then 'fail' when {_any('x', fixed.AT_MOST_B2_MARKERS)} then 'pass' else 'caution' end, pos) as verdict
    from sentence s join (values ('en', 'reject'), ('sv', 'above_b2')) as l(code, rule) on case l.code when 'en' then {_NAMED['en']} when 'sv' then {_NAMED['sv']} end
    where {_any('x', fixed.LANGUAGE_CONTEXT)} and not {_any('x', fixed.NEGATION_MARKERS)} and not {_any('x', fixed.OPTIONAL_MARKERS)} and ({_any('x', fixed.STRONG_MARKERS)} or {_TOP})
      and not ((contains(x, ' tai ') or contains(x, ' or ')) and ({_NAMED['fi']} or (l.code <> 'sv' and {_NAMED['sv']}))) group by all),
  tongue as (select job_id, bool_or(verdict = 'fail') as failed, bool_or(verdict = 'caution') as careful from spoken group by job_id),
  stem as materialized (select job_id, title || '. ' || description as raw, {_stems('title')} as tt, {_stems("title || '. ' || description")} as xx from posting),
  checked as (select job_id, case when contains(tt, {_DENTIST}) then 'reject' when contains(xx, {_DENTIST}) then case when {_soft('hammaslääkäri')} then 'caution' else 'reject' end end as a,
      case when contains(xx, {_SOCIAL}) then case when {_soft('sosiaalityöntekijän kelpoisuus')} or contains(tt, {_PHRASE['koordinaattori']}) then 'caution' else 'reject' end end as b,
      contains(xx, {_PHRASE['ajokortti']}) as c, contains(xx, {_PHRASE['hygieniapassi']}) as d from stem),
  fresh as (select job_id, expires_at < {_AS_OF} as passed, date_diff('microsecond', published_at, {_AS_OF}) / 86400000000.0 as age, date_diff('microsecond', {_AS_OF}, published_at) > 21600000000 as ahead, published_at from posting),
  verdict as materialized (select t.job_id, {' + '.join(_MISSING)} as missing_n, coalesce(g.failed, false) as language_failed, coalesce(g.careful, false) as language_review,
      coalesce(a = 'reject', false) or coalesce(b = 'reject', false) as rejected, coalesce(a = 'caution', false) or coalesce(b = 'caution', false) or c or d as careful,
      not coalesce(passed, false) and coalesce(age <= 30, true) as eligible, case when coalesce(passed, false) then 'past_deadline' when f.published_at is null then 'no_publication_date' when ahead then 'future_publication_date' when age > 30 then 'too_old' else 'fresh' end as reason
    from txt t join checked q using (job_id) join fresh f using (job_id) left join tongue g using (job_id))"""

_PER_PAIR = """said_no as (select p.profile_id, p.job_id, count(*) as n from pairs p join txt t using (job_id) join (
      select profile_id, 'word' as kind, term as v from own where field = 'negative' and length(term) >= 10 union select profile_id, 'title', last from said where last <> '') w on w.profile_id = p.profile_id
    and case when w.kind = 'word' then contains(t.norm, w.v) else contains(' ' || t.titled || ' ', ' ' || w.v || ' ') end group by all),
  careful as (select p.profile_id, p.job_id, count(*) as n from pairs p join txt t using (job_id) join own w on w.profile_id = p.profile_id and w.field = 'caution' and contains(t.norm, w.term) group by all),
  avoided as (select p.profile_id, p.job_id, count(*) * 8.0 as penalty from pairs p join txt t using (job_id) join posting j using (job_id) join (
      select profile_id, 'text' as kind, term as v from own where field = 'exclusion' union select profile_id, 'sector', first from said where first <> '' union select profile_id, 'employer', 'emp' || (profile_id % 37) from who) w on w.profile_id = p.profile_id
    and case when w.kind = 'employer' then contains(lower(coalesce(j.employer, '')), w.v) else contains(t.low, w.v) end group by all)"""

_POINTS = " + ".join(f"least(coalesce({f}_n, 0), {most}) * {points}" for f, (most, points) in scoring.POINTS.items())
_SOME = lambda *fields: "(" + " + ".join(f"coalesce({f}_n, 0)" for f in fields) + " > 0)"
_NO = "coalesce(said_no.n, 0) > 0"
_DETERMINISTIC = f"""det as materialized (select p.profile_id, p.job_id, p.pool, coalesce(title_n, 0) as title_n, {_NO} as negative, v.missing_n > 0 as missing, v.language_failed, v.rejected, v.eligible, v.reason,
      {_POINTS} + case when {_SOME('location')} then 15 when coalesce(j.location, '') = '' then 3 else 0 end + case when {_SOME('history_location')} then 7 else 0 end + case when {_SOME('learned_location')} then 7 else 0 end
        - case when {_NO} or v.missing_n > 0 then 40 else 0 end as whole, coalesce(avoided.penalty, 0)::double as penalty,
      {_SOME('history_title', 'history_keyword')} as history, {_SOME('sector')} and {_SOME('keyword', 'history_title', 'history_keyword')} as sector, coalesce(title_n, 0) = 0 and coalesce(keyword_n, 0) >= 2 as duty,
      p.pool = 3 and exists (select 1 from said s where s.profile_id = p.profile_id and s.first <> '' and contains(' ' || t.norm || ' ', ' ' || s.first || ' ')) as learned
    from pairs p join posting j using (job_id) join txt t using (job_id) join verdict v using (job_id) left join counts c on c.job_id = p.job_id and c.profile_id = p.profile_id
      left join said_no on said_no.job_id = p.job_id and said_no.profile_id = p.profile_id left join avoided on avoided.job_id = p.job_id and avoided.profile_id = p.profile_id),
  base as (select *, round(greatest(0.0, least(100.0, whole - penalty)), 2)::double as s0, round(greatest(0.0, least(100.0, whole)), 2)::double as u0, not (negative or missing or language_failed or rejected) as allowed from det)"""

_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::double * {1}[i]::double))"
_COS = lambda a, b: f"{_DOT.format(a, b)} / sqrt({_DOT.format(a, a)} * {_DOT.format(b, b)})"
_MEANS = lambda sign: f"select profile_id, list(x order by i) as v from (select profile_id, i, avg(x) as x, count(*) as n from (select profile_id, unnest(range(64)) as i, unnest(embedding)::double as x from told where sign = '{sign}') group by all) group by profile_id having max(n) >= 3"
_VECTORS = f"""told as (select distinct f.profile_id, f.job_id, case when rating >= 4 or applied then 'liked' when rating <= 2 then 'not' end as sign, embedding from feedback f join embeddings e on e.vec_id = f.job_id),
  likes as ({_MEANS('liked')}), dislikes as ({_MEANS('not')}),
  near as (select p.profile_id, p.job_id, {_COS('e.embedding', 'w.embedding')} as v, {_COS('e.embedding', 'l.v')} as liked, {_COS('e.embedding', 'd.v')} as averse
    from pairs p join embeddings e on e.vec_id = p.job_id join embeddings w on w.vec_id = p.profile_id left join likes l on l.profile_id = p.profile_id left join dislikes d on d.profile_id = p.profile_id),
  nearest as (select *, row_number() over (partition by profile_id order by v desc, job_id) as r from near),
  sem as (select b.*, n.v as v0, n.averse, n.v + coalesce(n.liked * 0.15, 0) as v1 from base b left join (select * from nearest where r <= {flagship.VECTORS}) n on n.profile_id = b.profile_id and n.job_id = b.job_id),
  exploring as (select *, (title_n = 0 and (history or duty or sector)) or coalesce(greatest(0.0, least(1.0, v1)) >= 0.56 and title_n = 0, false) as wide from sem),
  merged as materialized (select *, case when v0 is not null then greatest(0.0, least(1.0, v1 - case when wide then 0 else coalesce(averse * 0.2, 0) end)) end as v from exploring)"""

_TRIP = _PLACES.replace(_PLACED, "select job_id, location from posting")
_WHOLE = "concat_ws(' ', location)"
_SCORED = f"""{_TRIP}, reach as (select job_id, min(duration_s) as s from (select job_id, unnest(places) as destination from p) join {_ROUTES} using (destination) group by job_id),
  trip as (select p.job_id, case when city = 'oulu' or list_contains(places, 'Oulu, Finland') then 'exact_home_city' when remote then 'full_remote' when len(places) = 0 then 'vague' when s is null then 'unknown' when s <= 7200 then 'within_limit' when contains(low, '/ hybridi') then 'hybrid' else 'over_limit' end as travel, s, remote
    from (select *, lower(trim(split_part(split_part(loc, '/', 1), ',', 1))) as city from p) p left join reach using (job_id)),
  moves as (select *, case travel when 'exact_home_city' then 12 when 'full_remote' then 15 when 'vague' then -5 when 'unknown' then -5 when 'within_limit' then case when s <= 2700 then 10 when s <= 5400 then 6 else 3 end when 'hybrid' then -8 else -15 end as adjustment,
    travel in ('exact_home_city', 'within_limit') as commutable, remote and travel in ('exact_home_city', 'full_remote') as full_remote from trip),
  scored as materialized (select m.profile_id, m.job_id, pool, round(greatest(0.0, least(100.0, case when v is null then s0 else greatest(s0, round(15 + v * 20, 2)) end + adjustment)), 2) as score,
      case when v is null then u0 else round(greatest(u0, s0, round(15 + v * 20, 2)), 2) end as unpenalized,
      list_filter([case when title_n > 0 then 'direct_title' end, case when history then 'application_history' end, case when duty then 'transferable_duty' end, case when sector then 'sector_context' end, case when title_n = 0 and (history or duty or sector) then 'exploration' end,
        case when learned then 'learned_discovery' end, case when v >= 0.56 then 'semantic_similarity' end, case when v >= 0.56 and title_n = 0 and not (history or duty or sector) then 'exploration' end], lambda x: x is not null) as lanes,
      allowed and eligible and ((whole >= 15) or coalesce(v >= 0.56, false)) as passes, allowed and eligible as hard_eligible,
      list_filter([case when negative then 'negative_match' end, case when missing then 'missing_qualification' end, case when language_failed then 'language_requirement' end, case when rejected then 'qualification' end, case when not eligible then reason end], lambda x: x is not null) as reasons,
      travel, commutable, full_remote, adjustment from merged m join moves using (job_id))"""

_LANE_SQL = {lane: f"list_contains(lanes, '{lane}')" for lane in fixed.LANE_QUOTAS}
_AFTER = f"""passing as materialized (select * from scored where pool is not null and passes), {lane_order('passing', _LANE_SQL)},
  running as (select l.*, s.score, case when commutable then sum(commutable::int) over w end::bigint as near_place, case when commutable or full_remote then sum((commutable or full_remote)::int) over w end::bigint as either_place
    from lane_place l join scored s on s.profile_id = l.profile_id and s.job_id = l.job_id window w as (partition by l.profile_id order by place rows unbounded preceding)),
  hidden as (select distinct profile_id, job_id from feedback where rating <= 1 or feedback_id % 7 = 0),
  joined as (select coalesce(n.profile_id, o.profile_id) as profile_id, coalesce(n.job_id, o.job_id) as job_id, n.job_id is not null as new, o.job_id is not null as old, n.score as ns, n.place, n.near_place, n.either_place, o.* exclude (profile_id, job_id, commutable, remote)
    from running n full join had o on n.profile_id = o.profile_id and n.job_id = o.job_id),
  after as materialized (select b.profile_id, b.job_id, s.pool, case when not new then 'left' when old then 'updated' else 'inserted' end as outcome, case when new then ns else machine_score::double end as score, s.unpenalized, s.lanes, coalesce(s.reasons, list_filter([case when hard_rejected then 'earlier' end, case when not v.eligible then v.reason end], lambda x: x is not null)) as reasons, coalesce(s.hard_eligible, not hard_rejected and v.eligible) as hard_eligible, m.travel, m.commutable, m.full_remote, b.place, b.near_place, b.either_place,
      case when not new then (rec_id % 50)::int when old and h.job_id is not null then null else b.place end as rank, case when review_score is not null then rec_id end as evaluation_id, action, {_sql_chosen([None, 'strong', 'not_applicable', 'fair', 'strong'], 'rec_id')} as tier, review_score, h.job_id is not null as hid,
      review_score is not null and b.job_id % 5 <> 0 as current, case when not coalesce(s.hard_eligible, not hard_rejected and v.eligible) then 'hard_reject' when review_score is not null and b.job_id % 5 = 0 then 'changed' end as refresh
    from joined b left join scored s on s.profile_id = b.profile_id and s.job_id = b.job_id join moves m on m.job_id = b.job_id join verdict v on v.job_id = b.job_id left join hidden h on h.profile_id = b.profile_id and h.job_id = b.job_id)"""

_NEAR, _FAR = round(flagship.REVIEWS * 0.4), round(flagship.REVIEWS * 0.2)
_OPEN = "partition by profile_id order by priority, place"
_REVIEWED = f"""opened as (select *, case when evaluation_id is null then 0 when not current then 1 else 2 end as priority from after where place is not null and hard_eligible and not hid),
  b0 as (select profile_id, job_id, 0 as bucket, place as nation, current, row_number() over ({_OPEN}) as r from opened where commutable),
  b1 as (select profile_id, job_id, 1 as bucket, place as nation, current, row_number() over ({_OPEN}) as r from opened where not commutable and full_remote),
  first2 as (select * from b0 where r <= {_NEAR} union all select * from b1 where r <= {_FAR}),
  b2 as (select profile_id, job_id, 2 as bucket, place as nation, current, row_number() over ({_OPEN}) as r from opened o where not exists (select 1 from first2 f where f.profile_id = o.profile_id and f.job_id = o.job_id)),
  asked as (select * from first2 union all select * from b2 where r <= {flagship.REVIEWS - _NEAR - _FAR}),
  planned as (select profile_id, job_id, bucket, r as review_place, case when current then 'hit' when sum((not current)::int) over (partition by profile_id order by bucket, r rows unbounded preceding) <= {flagship.BUDGET} then 'evaluate' else 'deferred' end as review from asked),
  valid as (select *, case action when 'apply' then 0 when 'consider' then 1 else 2 end as a from after where coalesce(action, '') <> 'skip' and not coalesce(review_score < 40, false) and coalesce(tier, '') not in ('generic_customer_service_only', 'not_applicable') and hard_eligible
    and refresh is null and evaluation_id is not null and not hid),
  shown as (select profile_id, job_id, row_number() over (partition by profile_id order by a, review_score desc nulls last, score desc, job_id)::int as shown_rank,
      case when commutable then row_number() over (partition by profile_id, commutable order by a, review_score desc nulls last, score desc, job_id) end::int as shown_near,
      case when commutable or full_remote then row_number() over (partition by profile_id, commutable or full_remote order by a, review_score desc nulls last, score desc, job_id) end::int as shown_either from valid)"""


@query(f"""with {_POSTING}, {_WISHES}, {_POOLS}, {_COUNTS}, {_JOBS}, {_PER_PAIR}, {_DETERMINISTIC}, {_VECTORS}, {_SCORED}, {_AFTER}, {_REVIEWED}
  select a.profile_id, a.job_id, (['recent', 'local', 'remote', 'discovery'])[a.pool + 1] as pool, outcome, score, unpenalized, array_to_string(lanes, ',') as lanes, array_to_string(reasons, ',') as reasons, travel, place, near_place, either_place, rank, refresh,
    bucket::int as bucket, review_place::int as review_place, review, shown_rank is not null as active, shown_rank, shown_near, shown_either
  from after a left join planned p on p.profile_id = a.profile_id and p.job_id = a.job_id left join shown s on s.profile_id = a.profile_id and s.job_id = a.job_id""")
def match_pipeline(t: Tables) -> DataFrame:
    return flagship.recommendations(t)


_EDITED = _POSTING.replace("posting as materialized (select", "unedited as materialized (select", 1).replace("  txt as", """  posting as materialized (select * replace (case when job_id % 14 = 0 then 'Hammaslääkäri ' || title else title end as title,
    case when job_id % 14 = 7 then 'Kirjasto. ' || description else description end as description) from unedited),
  txt as""", 1)
_STORED = "pairs as materialized (select profile_id, job_id, null::int as pool from rec)"


@query(f"""with {_EDITED}, {_WISHES}, {_STORED}, {_COUNTS}, {_JOBS}, {_PER_PAIR}, {_DETERMINISTIC}, {_VECTORS.replace(f"r <= {flagship.VECTORS}", "true")}, {_SCORED}
  select profile_id, job_id, score, hard_eligible, array_to_string(reasons, ',') as reasons, job_id % 7 = 0 as touched, case when not hard_eligible then 'hard_reject' when job_id % 7 = 0 then 'changed' end as refresh from scored""")
def reconcile_publication(t: Tables) -> DataFrame:
    """Verdicts after an edit of some jobs, of which only these are scored again; the SQL scores all."""
    rows = flagship.reconciled(t)
    return rows.select("profile_id", "job_id", "score", "hard_eligible", F.array_join("hard_reasons", ",").alias("reasons"), "touched", "refresh")
