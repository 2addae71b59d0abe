"""Queries over feeds and sitemaps, written as XML from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import landed
from .binding import Tables
from .registry import query

_TITLE = "trim(regexp_replace(substr(text, 1, 40), '[^0-9A-Za-z&<> ]', '', 'g'))"
_DAY = "lpad((n_chars % 28 + 1)::varchar, 2, '0')"


def _feeds(t: Tables) -> DataFrame:
    """A feed for each document: two items, of which the first may lack a job id or a date, and may be broken."""
    k, n = F.col("doc_id"), F.col("n_chars")
    plain = F.regexp_replace(F.substring("text", 1, 40), "[^0-9A-Za-z&<> ]", "")
    title = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    text = lambda c: c.cast("string")
    link = F.when(k % 4 == 3, "https://a.example.org/none").otherwise(F.concat(F.lit("https://a.example.org/what:job/jobID:"), text(k), F.lit("/")))
    date = F.when(k % 6 == 0, "some day").otherwise(F.concat(F.lit("Mon, "), day, F.lit(" Mar 2024 08:30:00 "), F.when(k % 2 == 0, "GMT").otherwise("+0200")))
    broken = F.when(k % 5 == 0, F.lit("<b>")).otherwise(F.lit(""))
    first = F.concat(F.lit("<item><title> "), title, F.lit("</title>"), broken, F.lit("<link>"), link, F.lit("</link><pubDate>"), date, F.lit("</pubDate></item>"))
    second = F.concat(F.lit("<item><link>https://a.example.org/jobID:9"), text(k), F.lit("</link></item>"))
    return t.documents.select(F.col("source"), F.concat(F.lit("<rss><channel><title>jobID:1</title>"), first, second, F.lit("</channel></rss>")).alias("xml"))


@query(f"""select source, doc_id::varchar as job_id, {_TITLE} as title, 'https://a.example.org/what:job/jobID:' || doc_id || '/' as link, case when doc_id % 6 <> 0 then '2024-03-' || {_DAY} || case when doc_id % 2 = 0 then ' 08:30' else ' 06:30' end end as published from documents where doc_id % 4 <> 3 and doc_id % 5 <> 0
  union all select source, '9' || doc_id, '', 'https://a.example.org/jobID:9' || doc_id, null from documents
  union all select source, null, null, 'broken', null from documents where doc_id % 5 = 0""")
def feed_scan(t: Tables) -> DataFrame:
    """Items of all feeds; broken ones stand apart."""
    items, broken = landed.feed_items(_feeds(t))
    none = F.lit(None).cast("string")
    rows = items.select("source", "job_id", "title", "link", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))
    return rows.union(broken.select("source", none, none, F.lit("broken"), none))


def _sitemaps(t: Tables) -> DataFrame:
    """A sitemap for each page with three entries; some pages say an error instead."""
    k = F.col("page_id")
    entry = lambda loc, day: F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), day, F.lit("</url>"))
    dated = lambda at: F.concat(F.lit("<lastmod>2024-01-"), F.lpad((at % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))
    job = lambda by: F.concat(F.lit("https://b.example.org/tyopaikka/job-"), (k % by).cast("string"))
    whole = F.concat(F.lit("<urlset>"), entry(job(40), dated(k)), entry(F.concat(job(60), F.lit("/")), F.when(k % 2 == 0, F.lit("")).otherwise(dated(k * 3))), entry(F.lit("https://b.example.org/other/1"), dated(k)), F.lit("</urlset>"))
    return t.pages.select("page_id", F.when(k % 9 == 4, F.lit("<html>no map</html>")).otherwise(whole).alias("xml"))


@query("""with e as (select 'job-' || (page_id % 40) as external_id, 'https://b.example.org/tyopaikka/job-' || (page_id % 40) as url, (page_id % 28 + 1)::int as day from pages where page_id % 9 <> 4
    union all select 'job-' || (page_id % 60), 'https://b.example.org/tyopaikka/job-' || (page_id % 60) || '/', case when page_id % 2 = 1 then (page_id * 3 % 28 + 1)::int end from pages where page_id % 9 <> 4),
  m as (select external_id, arg_max(url, (day is not null, day, url)) as url, max(day) as day from e group by external_id)
  select external_id, url, case when day is not null then '2024-01-' || lpad(day::varchar, 2, '0') end as lastmod, (select count(*) from pages where page_id % 9 = 4) as unread from m where day is null or day > 3""")
def sitemap_scan(t: Tables) -> DataFrame:
    """Entries newer than a watermark, each id once, and how many files were no sitemaps."""
    files = _sitemaps(t)
    after = F.lit("2024-01-03 00:00:00").cast("timestamp")
    unread = files.agg(F.count_if(~landed.is_sitemap(F.col("xml"))).alias("unread"))
    rows = landed.sitemap_entries(files.where(landed.is_sitemap(F.col("xml"))), watermark=after)
    return rows.crossJoin(F.broadcast(unread)).select("external_id", "url", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "unread")
