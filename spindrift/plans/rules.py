"""Queries of rules that decide in order: named checks, clusters, grounding, dates, clean comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listing as L, text as T
from ..operators import gates, scoring
from .binding import Tables
from .listings import _NORM, _any
from .registry import query



@query(f"""with m as (select doc_id as job_id, unnest(list_distinct(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[0-9a-zåäö]+'))) as term from documents join (select doc_id, title from listing) using (doc_id)),
  r as (select job_id, term, row_number() over (partition by job_id order by term) as r from m)
  select job_id, round(sum(case when r <= 5 then 15.0::double else 0 end), 2) as titles, round(sum(case when r > 5 and r <= 13 then 2.5::double else 0 end), 2) as keywords from r group by job_id""")
def cluster_contributions(t: Tables) -> DataFrame:
    terms = t.listing.select(F.col("doc_id").alias("job_id"), F.lit(0).alias("profile_id"), F.explode(T.tokens(F.col("title"))).alias("term"))
    both = terms.withColumn("cluster", F.explode(F.array(F.lit("direct_title"), F.lit("keywords"))))
    parts = scoring.cluster_contributions(both, {"direct_title": 15.0, "keywords": 2.5})
    got = lambda c: F.sum(F.when(F.col("cluster") == c, F.col("contribution")).otherwise(0.0))
    return parts.groupBy("job_id").agg(got("direct_title").alias("titles"), got("keywords").alias("keywords"))


@query(f"""with s as (select doc_id as id, unnest(['the', 'emp' || (n_chars % 37), 'nowhere']) as term from documents), x as (select doc_id as id, ' ' || {_NORM.format("concat_ws(' ', title, employer)")} || ' ' as txt from listing)
  select id, term from s join x using (id) where contains(txt, ' ' || term || ' ')""")
def grounded_terms(t: Tables) -> DataFrame:
    terms = F.array(F.lit("the"), F.concat(F.lit("emp"), (F.col("n_chars") % 37).cast("string")), F.lit("nowhere"))
    suggestions = t.listing.select(F.col("doc_id").alias("id"), F.explode(terms).alias("term"))
    return scoring.grounded(suggestions, t.listing.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "title", "employer").alias("text")))


@query("select doc_id, array_to_string(list_transform(string_split(title, ' '), lambda w: case when regexp_matches(regexp_replace(w, '[^\\p{L}''-]+', '', 'g'), '^[A-ZÅÄÖ][a-zåäö]+$') and lower(regexp_replace(w, '[^\\p{L}''-]+', '', 'g')) not in ('the', 'and', 'of') then '[name]' else w end), ' ') as clean from listing")
def comment_sanitize(t: Tables) -> DataFrame:
    return t.listing.select("doc_id", L.without_names(F.col("title"), F.array(F.lit("the"), F.lit("and"), F.lit("of"))).alias("clean"))


@query("""select doc_id, length(regexp_replace(regexp_replace(substr(description, 1, 4000), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\+?[0-9][0-9 ()-]{6,}[0-9]', '[phone]', 'g')) as n, regexp_replace(regexp_replace(title, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '\\+?[0-9][0-9 ()-]{6,}[0-9]', '[phone]', 'g') as title from listing""")
def model_input_docs(t: Tables) -> DataFrame:
    made = t.listing.select("doc_id", L.model_input({"title": F.col("title"), "text": F.col("description")}).alias("j"))
    back = F.from_json("j", "text string, title string")
    return made.select("doc_id", back.alias("b")).select("doc_id", F.length("b.text").cast("long").alias("n"), "b.title")
