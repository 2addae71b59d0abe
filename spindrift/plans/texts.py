"""Queries of excerpts and of payloads that leave the host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, listing as L, privacy
from .binding import Tables
from .flagship import postings
from .listings import _any
from .match import _POSTING
from .registry import query

LIMIT = 1000
_DECISIVE = _any("lower(x)", fixed.DECISIVE_MARKS)
_EXCERPTS = f"""{_POSTING}, cut as (select job_id, description as d, list_filter(list_transform(string_split_regex(regexp_replace(description, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' and {_DECISIVE}) as s from posting),
  fold as (select job_id, len(s) as i, 0 as used, []::varchar[] as kept from cut
    union all select f.job_id, i - 1, case when used + length(s[i]) + 1 <= {LIMIT // 2} then used + length(s[i]) + 1 else used end, case when used + length(s[i]) + 1 <= {LIMIT // 2} then list_prepend(s[i], kept) else kept end from fold f join cut using (job_id) where i > 0),
  made as (select c.job_id, d, s, case when length(d) <= {LIMIT} then d when len(kept) = 0 then substr(d, 1, {LIMIT}) else substr(substr(d, 1, {LIMIT // 2}) || array_to_string(kept, ' '), 1, {LIMIT}) end as short from cut c join fold f on f.job_id = c.job_id and f.i = 0)"""


@query(f"with recursive {_EXCERPTS} select job_id, length(short) as n, md5(short) as digest from made")
def excerpt(t: Tables) -> DataFrame:
    short = L.excerpt(F.col("description"), LIMIT, fixed.DECISIVE_MARKS)
    return postings(t).select("job_id", short.alias("s")).select("job_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("digest"))


@query(f"""with recursive {_EXCERPTS} select job_id, len(s)::int as decisive, len(list_filter(s, lambda x: contains(substr(d, 1, {LIMIT}), x)))::int as by_head, len(list_filter(s, lambda x: contains(short, x)))::int as by_excerpt from made""")
def excerpt_coverage(t: Tables) -> DataFrame:
    """Sentences that decide, and how many of them the head of a text and its excerpt hold."""
    return postings(t).select("job_id", L.coverage(F.col("description"), LIMIT, fixed.DECISIVE_MARKS).alias("c")).select("job_id", "c.*")


_KEYS = ["note", "Home Address", "home--address", "e-mail", "Email", " PHONE ", "post-code", "Postal Code", "skills", "SÄHKÖPOSTI", "Raw-CV", "rawcv", "Date of birth", "image_url", "Kuva"]
_key = lambda by: f"({_KEYS!r})[({by} % {len(_KEYS)}) + 1]"
_OUT = lambda key: f"regexp_replace(lower(trim({key})), '[\\s-]+', '_', 'g') in ({', '.join(repr(k) for k in fixed.FORBIDDEN_KEYS)})"
_SHOWN = lambda key, value: f"case when {_OUT(key)} then '' else ',\"' || {key} || '\":' || {value} end"


@query(f"""with k as (select event_id, {_key('event_id')} as a, {_key('(event_id // 7)')} as b, floor(value)::bigint as v from events),
  p as (select event_id, '"objective":{{"id":' || event_id || {_SHOWN('a', "'{\"deep\":1}'")} || ',"list":[{{"n":' || v || {_SHOWN('b', "'[1,2]'")} || '}},[{{"x":null' || {_SHOWN('a', "'\"é\"'")} || '}}],"s"]}}' as objective, b from k)
  select event_id, case when event_id % 11 = 0 then null when event_id % 11 = 1 then case when b = 'skills' then '{{"skills":3}}' else '{{}}' end else '{{' || objective || ',"location":{{"home_city":"Oulu","anchors":[' || case when event_id % 2 = 0 then '' else '1.5' end || ']}}' || case when b = 'skills' then ',"skills":true' else '' end || '}}' end as payload from p""")
def key_allowlist(t: Tables) -> DataFrame:
    """Nested payloads with keys in many spellings, at the top, in objects and in arrays; some are no JSON or have no key
    that is allowed."""
    key = lambda by: F.get(F.array(*map(F.lit, _KEYS)), (by % len(_KEYS)).cast("int"))
    k = F.col("event_id")
    a, b = key(k), key(F.floor(k / 7))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('":'))
    inner = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(","), q(a), F.lit('{"deep":1,"zip":2},"list":[{"n":'), F.floor("value").cast("string"), F.lit(","), q(b), F.lit('[1, 2]},[{"x":null,'), q(a), F.lit('"é"}],"s"]}'))
    place = F.concat(F.lit('{"street":"x","anchors":['), F.when(k % 2 == 0, "").otherwise("1.5"), F.lit('],"home_city":"Oulu"}'))
    whole = F.concat(F.lit('{"location":'), place, F.lit(',"phone":"1",'), q(b), F.lit('true,"objective":'), inner, F.lit("}"))
    payload = F.when(k % 11 == 0, "{no json").when(k % 11 == 1, F.concat(F.lit("{"), q(b), F.lit("3}"))).otherwise(whole)
    return t.events.select("event_id", privacy.outbound()(payload).alias("payload"))
