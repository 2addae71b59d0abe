"""Landed payloads of listing sources, read and brought to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(source_name, payload, file): one JSON object a line, below a folder per source; the payload as VARIANT,
    null where it is no JSON."""
    lines = spark.read.text(f"{folder}/*/*.json").select(F.col("value"), F.input_file_name().alias("file"))
    name = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return lines.select(name.alias("source_name"), F.try_parse_json("value").alias("payload"), "file")


def rfc_date(value: Column) -> Column:
    """A date of mail and feeds (``Mon, 04 Mar 2024 08:00:00 +0200``) in UTC; without a zone it is UTC; null if it is none."""
    plain = F.trim(F.regexp_replace(value, r"^\s*\w+,\s*", ""))
    zoned = F.regexp_replace(F.regexp_replace(plain, r"\s+(GMT|UTC?|Z)$", " +0000"), r"(\d{2}:\d{2}:\d{2})$", "$1 +0000")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx"))


def _elements(xml: Column, tag: str) -> Column:
    """All elements of a name in a text, as texts."""
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))


_MODE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


def feed_items(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of feeds (source, xml): (source, job_id, title, link, published_at) of those whose link has a job id, with a
    null date if it can't be read; and (source, item) of those that are no XML. A broken item takes no other with it."""
    each = feeds.select("source", F.explode(_elements(F.col("xml"), "item")).alias("item"))
    read = each.withColumn("x", F.from_xml("item", "title string, link string, pubDate string, _bad string", _MODE))
    job = F.regexp_extract(F.coalesce("x.link", F.lit("")), r"jobID:(\d+)", 1)
    clean = lambda c: F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    good = read.where("x._bad is null").select("source", job.alias("job_id"), clean(F.col("x.title")).alias("title"), clean(F.col("x.link")).alias("link"), rfc_date(F.col("x.pubDate")).alias("published_at"))
    return good.where("job_id <> ''"), read.where("x._bad is not null").select("source", "item")


def sitemap_entries(files: DataFrame, part: str = "/tyopaikka/", watermark: Column | None = None) -> DataFrame:
    """(external_id, url, lastmod) of sitemaps (xml): entries whose address has ``part`` and a valid id at its end, of those
    with one id the newest, a dated one before one without; newer than the watermark, or without a date."""
    each = files.select(F.explode(_elements(F.col("xml"), "url")).alias("entry"))
    read = each.select(F.from_xml("entry", "loc string, lastmod string, _bad string", _MODE).alias("x")).where("x._bad is null")
    rows = read.select(F.trim("x.loc").alias("url"), F.try_to_timestamp(F.trim("x.lastmod")).alias("lastmod")).where(F.contains("url", F.lit(part)))
    rows = rows.withColumn("external_id", F.regexp_extract("url", r"([A-Za-z0-9_-]+)/?$", 1)).where("external_id <> ''")
    best = F.struct(F.col("lastmod").isNotNull(), "lastmod", "url")
    rows = rows.groupBy("external_id").agg(F.max_by("url", best).alias("url"), F.max("lastmod").alias("lastmod"))
    return rows if watermark is None else rows.where(F.col("lastmod").isNull() | (F.col("lastmod") > watermark))


def is_sitemap(xml: Column) -> Column:
    """Whether a landed file is a sitemap at all; a page that says an error must not be read as an empty one."""
    return F.contains(F.coalesce(xml, F.lit("")), F.lit("<urlset"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, title, link, published_at) of the items of feed files."""
    files = spark.read.text(path, wholetext=True).select(F.lit(None).cast("string").alias("source"), F.col("value").alias("xml"))
    return feed_items(files)[0].drop("source")


def read_sitemap(spark: SparkSession, path: str, part: str = "/tyopaikka/", watermark: str | None = None) -> DataFrame:
    """(external_id, url, lastmod): entries of sitemap files."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"))
    return sitemap_entries(files, part, F.lit(watermark).cast("timestamp") if watermark else None)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def article_text(html: Column) -> Column:
    """Text of the article element: scripts go, block tags end lines, other tags are spaces, empty lines go."""
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    plain = F.regexp_replace(inner, r"(?is)<(script|style)\b.*?</\1>", " ")
    lines = F.regexp_replace(F.regexp_replace(plain, r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section)\b[^>]*>", "\n"), "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        lines = F.replace(lines, F.lit(name), F.lit(char))
    kept = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.array_join(kept, "\n")


def linked_data(html: Column) -> Column:
    """The first ld+json script that is an object of type JobPosting, as VARIANT; null if there is none."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    typed = F.filter(scripts, lambda s: F.rlike(s, F.lit(r'"@type"\s*:\s*(\[[^\]]*)?"JobPosting"')) & F.try_parse_json(s).isNotNull())
    return F.try_parse_json(F.get(typed, F.lit(0)))


def listing_cards(html: Column) -> Column:
    """Array of (href, id, title, day) of the list items that have a title and a link."""
    cards = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    made = F.transform(cards, lambda c: F.struct(
        F.regexp_extract(c, r'(?is)href="([^"?#]*)', 1).alias("href"), F.regexp_extract(c, r'(?is)href="[^"]*?(\d{4,})', 1).alias("id"), T.without_markup(F.regexp_extract(c, r"(?is)<(?:h3|a)\b[^>]*>(.*?)</(?:h3|a)>", 1)).alias("title"), F.regexp_extract(c, r'(?is)<time[^>]*datetime="([^"]*)"', 1).alias("day")))
    return F.filter(made, lambda x: (x["title"] != "") & (x["href"] != ""))


def localized(payload: Column, field: str, languages: tuple[str, ...] = ("fi", "en", "sv")) -> Column:
    """A field's value in the first of the languages that has one, else any."""
    some = F.try_variant_get(payload, f"$.{field}", "map<string,string>")
    chosen = [F.nullif(F.try_element_at(some, F.lit(x)), F.lit("")) for x in languages]
    return F.coalesce(*chosen, F.get(F.map_values(some), F.lit(0)))


def deadline(payload: Column, keys: tuple[str, ...] = ("expires_at", "deadline", "validThrough", "application_deadline", "endDate"), zone: str = "Europe/Helsinki") -> Column:
    """The first key's time that can be read, in UTC; a mere date ends with its day in the zone."""

    def read(key: str) -> Column:
        value = F.try_variant_get(payload, f"$.{key}", "string")
        day = F.to_utc_timestamp(F.date_add(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"), 1).cast("timestamp"), zone)
        return F.when(F.length(value) == 10, day).otherwise(F.try_to_timestamp(value))

    return F.coalesce(*(read(k) for k in keys))


def entities_decoded(text: Column) -> Column:
    """The common character references as characters, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def rendered_listings(rows: DataFrame, regions: DataFrame, part: str = "avoimet-tyopaikat") -> DataFrame:
    """(doc_id, title, employer, location) of rendered pages (doc_id, title, link, regions, city, mode).

    Titles lose tags and references; the employer is the slug behind ``part`` in the link; the location is the city,
    else the names of the first three region ids that have one (``Suomi`` for ten and more, and for none), with the
    work mode behind it. regions: region, name; one row per region, so that it may be broadcast."""
    from ..functions import listing as L

    known = regions.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("region", "name"))).alias("_names"))
    title = F.trim(entities_decoded(F.trim(F.regexp_replace("title", "<[^>]+>", " "))))
    employer = L.name_from_slug(F.nullif(F.regexp_extract("link", rf"/{part}/([^/?#]+)", 1), F.lit("")))
    named = F.array_compact(F.transform("regions", lambda x: F.try_element_at("_names", x)))
    placed = F.when(F.size(named) >= 10, "Suomi").otherwise(F.nullif(F.array_join(F.array_distinct(F.slice(named, 1, 3)), ", "), F.lit("")))
    location = F.coalesce("city", placed, F.lit("Suomi"))
    return rows.crossJoin(F.broadcast(known)).select("doc_id", title.alias("title"), employer.alias("employer"), T.with_work_mode(location, F.col("mode")).alias("location"))


def static_description(html: Column, least: int = 40) -> Column:
    """The first of these with ``least`` characters: the meta descriptions (plain, og, twitter), an element with
    itemprop="description", a block of a description's class. References are decoded, tags are spaces."""

    def meta(kind: str, name: str) -> Column:
        ways = [rf"(?is)<meta[^>]+{kind}=[\"']{name}[\"'][^>]+content=[\"']([^\"']+)", rf"(?is)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+{kind}=[\"']{name}[\"']"]
        return F.coalesce(*(F.nullif(entities_decoded(F.trim(F.regexp_extract(html, w, 1))), F.lit("")) for w in ways))

    def inside(pattern: str) -> Column:
        return entities_decoded(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]+>", " "), r"\s+", " ")))

    found = [
        meta("name", "description"), meta("property", "og:description"), meta("property", "twitter:description"), inside(r"(?is)itemprop=[\"']description[\"'][^>]*>(.*?)</"),
        inside(r"(?is)<(?:div|section)[^>]+class=[\"'][^\"']*(?:job-description|job__description|description)[^\"']*[\"'][^>]*>(.*?)</(?:div|section)>"),
    ]
    return F.coalesce(*(F.when(F.length(x) >= least, x) for x in found))


def feed_listings(items: DataFrame, employer: str, location: str) -> DataFrame:
    """(external_id, title, employer, location, published_at, url) of feed items with their details (job_id, title, link,
    published_at, detail_title): all have one employer and place; the detail's title counts, if there is one."""
    return items.select(F.col("job_id").alias("external_id"), F.coalesce(F.nullif(F.trim("detail_title"), F.lit("")), F.trim("title")).alias("title"), F.lit(employer).alias("employer"), F.lit(location).alias("location"), "published_at", F.col("link").alias("url"))


def card_listings(cards: DataFrame) -> DataFrame:
    """(external_id, title, employer, location, published_at, url) of rows of cards or partners (url, site, title, company,
    locations, date in mail format). The id is the safe URL, else site, title and date joined by colons; blank texts
    are null, dates that can't be read too."""
    from ..functions import links

    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    url = F.when(links.rejection(F.col("url")).isNull(), F.trim("url"))
    ident = F.coalesce(url, F.concat_ws(":", *(F.coalesce(c, F.lit("")) for c in ("site", "title", "date"))))
    plain = F.regexp_replace(F.col("date"), r"^\w+,\s*", "")
    at = F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))
    return cards.select(ident.alias("external_id"), F.coalesce(F.trim("title"), F.lit("")).alias("title"), text("company").alias("employer"), text("locations").alias("location"), at.alias("published_at"), url.alias("url"))


def content_hash(**fields: Column) -> Column:
    """sha256 of the JSON object of fields in the order of their names; nulls count."""
    from ..functions import listing as L

    return L.identity(**fields)
