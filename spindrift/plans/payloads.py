"""Queries that bring payloads and pages to listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listing as L, text as T
from ..sources import landed
from .binding import Tables
from .registry import query

_TEXT = """array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_extract(coalesce(html, ''), '(?is)<article\\b[^>]*>(.*?)</article>', 1), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""


@query(f"select page_id, length(t) as n, md5(t) as text from (select page_id, {_TEXT} as t from pages)")
def html_to_text(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", landed.article_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text"))


@query("""with c as (select page_id, unnest(regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li>', 1)) as card from pages),
  f as (select page_id, regexp_extract(card, '(?is)href="([^"?#]*)', 1) as href, trim(regexp_replace(regexp_replace(regexp_extract(card, '(?is)<(?:h3|a)\\b[^>]*>(.*?)</(?:h3|a)>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as title from c)
  select page_id, count(*) as n, string_agg(title, '|' order by title) as titles from f where title <> '' and href <> '' group by page_id""")
def html_list_items(t: Tables) -> DataFrame:
    cards = t.pages.select("page_id", F.explode(landed.listing_cards(F.col("html"))).alias("c"))
    return cards.groupBy("page_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("c.title")), "|").alias("titles"))


def _payloads(t: Tables) -> DataFrame:
    """Listings as JSON payloads, to be read back."""
    title = F.create_map(F.when(F.col("doc_id") % 3 == 0, "fi").when(F.col("doc_id") % 3 == 1, "en").otherwise("de"), F.col("title"))
    day = F.date_format("published_at", "yyyy-MM-dd")
    body = F.struct(
        F.col("external_id").alias("id"), title.alias("title"), F.struct(F.col("employer").alias("name")).alias("company"), F.unix_millis(F.col("published_at").cast("timestamp")).alias("created"),
        F.date_format("published_at", "dd.MM.yyyy").alias("posted"), F.when(F.col("doc_id") % 2 == 0, day).alias("deadline"), F.when(F.col("doc_id") % 2 == 1, F.concat(day, F.lit("T10:00:00Z"))).alias("endDate"), F.col("location").alias("place"))
    return t.listing.select("doc_id", F.parse_json(F.to_json(body)).alias("payload"))


@query("select doc_id, external_id, title, employer, location from listing")
def normalize_listing(t: Tables) -> DataFrame:
    get = lambda path: F.try_variant_get("payload", path, "string")
    return _payloads(t).select("doc_id", get("$.id").alias("external_id"), landed.localized(F.col("payload"), "title").alias("title"), get("$.company.name").alias("employer"), get("$.place").alias("location"))


@query("select doc_id, published_at as at from listing")
def epoch_millis_normalize(t: Tables) -> DataFrame:
    return _payloads(t).select("doc_id", F.timestamp_millis(F.try_variant_get("payload", "$.created", "long")).cast("timestamp_ntz").alias("at"))


@query("select doc_id, date_trunc('day', published_at)::timestamp as at from listing")
def dayfirst_dates(t: Tables) -> DataFrame:
    posted = F.try_variant_get("payload", "$.posted", "string")
    return _payloads(t).select("doc_id", F.coalesce(F.try_to_timestamp(posted, F.lit("d.M.yyyy H:mm")), F.try_to_timestamp(posted, F.lit("d.M.yyyy"))).cast("timestamp_ntz").alias("at"))


@query("""select doc_id, case when doc_id % 2 = 0 then (date_trunc('day', published_at) + to_days(1))::timestamp - (case when published_at::date + 1 > date '2024-03-31' then to_hours(3) else to_hours(2) end) else date_trunc('day', published_at)::timestamp + to_hours(10) end as until from listing""")
def deadline_extract(t: Tables) -> DataFrame:
    return _payloads(t).select("doc_id", landed.deadline(F.col("payload")).cast("timestamp_ntz").alias("until"))


@query("select doc_id, title, employer from listing where doc_id % 2 = 0")
def jsonld_normalize(t: Tables) -> DataFrame:
    data = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, "JobPosting").otherwise("Thing").alias("@type"), F.col("title"), F.struct(F.col("employer").alias("name")).alias("hiringOrganization")))
    page = F.concat(F.lit('<script>x</script><script type="application/ld+json">'), data, F.lit("</script>"))
    found = t.listing.select("doc_id", landed.linked_data(page).alias("d")).where("d is not null")
    get = lambda path: F.try_variant_get("d", path, "string")
    return found.select("doc_id", get("$.title").alias("title"), get("$.hiringOrganization.name").alias("employer"))


@query("""with p as (select doc_id, list_transform(regexp_extract_all(description, '[^.!?]+[.!?]'), lambda s: trim(s))[1:2] as s from listing), j as (select doc_id, array_to_string(s, ' ') as t from p)
  select doc_id, case when length(t) <= 120 then t else regexp_replace(substr(t, 1, 120), '\\s+\\S*$', '') || '.' end as short from j""")
def sentence_prefix(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", L.first_sentences(F.col("description"), 2, 120).alias("short"))


@query("""select doc_id, case when has then replace_text else case when n_chars % 2 = 0 then 'palkka' else 'palkka|' || replace_text end end as concerns from
  (select doc_id, n_chars, n_chars % 4 = 0 as has, 'matka ' || (n_chars % 7) as replace_text from listing)""")
def concern_patch(t: Tables) -> DataFrame:
    concerns = F.when(F.col("n_chars") % 4 == 0, F.array(F.lit("Sijainti ei osu alueeseen."))).otherwise(F.array(F.lit("palkka")))
    text = F.concat(F.lit("matka "), (F.col("n_chars") % 7).cast("string"))
    return t.listing.select("doc_id", F.array_join(L.patched_concerns(concerns, text, F.col("n_chars") % 2 == 0), "|").alias("concerns"))
