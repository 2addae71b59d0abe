"""A run of learning: feedback and what was learned before into lists of terms with their provenance, and a version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..sources.tables import count_written, drop_written, spread, written
from . import scoring
from .hits import small

LISTS = "profile_id long, list string, term string, net double, jobs long, first_seen date, place int"
STATE = "profile_id long, version int, fingerprint string, feedback long, changed boolean, added long"


@dataclass(frozen=True)
class Limits:
    """When a term is learned, and how many of each list are kept, the strongest first."""

    boost: float = 1.5
    enter: float = -2.0
    leave: float = -1.0
    jobs: int = 2
    titles: int = 20
    keywords: int = 30
    locations: int = 10
    exclusions: int = 40
    discovery: int = 12
    share: float = fixed.FREQUENT_SHARE
    half_life: float = 60.0


def _once(rows: DataFrame) -> DataFrame:
    """One row for each job and term, with how many there were, so that jobs can be counted without telling them apart."""
    return rows.groupBy("job_id", "term").agg(F.bool_or("title_like").alias("title_like"), F.bool_or("location_like").alias("location_like"), F.count("*").alias("copies"))


def job_terms(jobs: DataFrame) -> DataFrame:
    """(job_id, term, title_like, location_like, copies): the tokens of title, employer and location, general ones left
    out, and whether each is a variant of a token of the title or of the location."""
    whole = T.tokens(F.concat_ws(" ", "title", "employer", "location"))
    rows = spread(jobs.select("job_id", "title", "employer", "location"))
    # Variants before the explode: beside it they would be made again for every term.
    rows = rows.select("job_id", whole.alias("_all"), T.expanded_tokens(F.col("title")).alias("_t"), T.expanded_tokens(F.col("location")).alias("_l"))
    rows = rows.select("job_id", F.explode("_all").alias("term"), "_t", "_l")
    rows = rows.where(~F.col("term").isin(fixed.GENERIC_TERMS))
    return _once(rows.select("job_id", "term", F.array_contains("_t", F.col("term")).alias("title_like"), F.array_contains("_l", F.col("term")).alias("location_like")))


def firm_terms(jobs: DataFrame) -> DataFrame:
    """The same of employers, whose whole names are the terms."""
    no = F.lit(False)
    return _once(jobs.select("job_id", F.lower(F.trim("employer")).alias("term"), no.alias("title_like"), no.alias("location_like")).where("term <> ''"))


def heard(feedback: DataFrame, as_of: Column, limits: Limits) -> DataFrame:
    """(profile_id, job_id, w, d, heard, first, rows): feedback added up by profile and job, before it meets any terms."""
    weighed = scoring.decayed_weights(feedback, as_of, limits.half_life)
    w, liked = F.col("weight"), (F.col("rating") >= 4) | F.col("applied")
    sign = F.when(liked, w).when(F.col("rating") <= 2, -F.abs(w)).otherwise(F.lit(0.0))
    return weighed.groupBy("profile_id", "job_id").agg(
        F.sum("weight").alias("w"), F.sum(sign).alias("d"), F.bool_or(w != 0).alias("heard"), F.min(F.to_date("created_at")).alias("first"), F.count("*").alias("rows"))


def term_weights(per: DataFrame, terms: DataFrame, limits: Limits, suggested: DataFrame | None = None) -> DataFrame:
    """(profile_id, term, net, score, jobs, first_seen, title_like, location_like, frequent) of every term that feedback
    with a weight speaks of; net and score to 6 places. per: heard; terms: job_terms or firm_terms; suggested: profile_id,
    job_id, term, delta, from analyses.

    A profile's job has a term in one row, so sums by profile and term, which are few, are made before the shuffle."""
    copies = F.col("copies")
    found = per.where("heard").join(terms, "job_id").select("profile_id", "job_id", "term", (F.col("w") * copies).alias("w"), (F.col("d") * copies).alias("d"), "first", "title_like", "location_like")
    if suggested is not None:
        none, no = F.lit(0.0).alias("d"), F.lit(False)
        said = suggested.join(per.select("profile_id", "job_id", "first"), ["profile_id", "job_id"])
        found = found.unionByName(said.select("profile_id", "job_id", "term", F.col("delta").alias("w"), none, "first", no.alias("title_like"), no.alias("location_like")))
        found = found.groupBy("profile_id", "job_id", "term").agg(
            F.sum("w").alias("w"), F.sum("d").alias("d"), F.min("first").alias("first"), F.bool_or("title_like").alias("title_like"), F.bool_or("location_like").alias("location_like"))
    total = per.groupBy("profile_id").agg(F.sum("rows").alias("_all"))
    out = found.groupBy("profile_id", "term").agg(
        F.round(F.sum("w"), 6).alias("net"), F.round(F.sum("d"), 6).alias("score"), F.count("job_id").alias("jobs"), F.min("first").alias("first_seen"),
        F.bool_or("title_like").alias("title_like"), F.bool_or("location_like").alias("location_like"))
    return out.join(small(total), "profile_id").withColumn("frequent", F.col("jobs") / F.col("_all") > limits.share).drop("_all")


def learned_lists(weights: DataFrame, firms: DataFrame, previous: DataFrame, baseline: DataFrame, limits: Limits | None = None) -> DataFrame:
    """LISTS: the list ``known`` of all terms that say something, with where each was first seen; ``title``, ``location`` or
    ``keyword`` of what is liked, by the first of these that it stands in; ``exclusion``, which a term enters at the lower
    limit and leaves only above the upper one; ``employer``; ``discovery``, of what is liked more than disliked.

    weights: term_weights; firms: the same by employer (term); previous: LISTS of the run before; baseline: profile_id,
    term that discovery does without: null profile_id for all."""
    limits = limits or Limits()
    had = previous.where("list = 'known'").select("profile_id", "term", F.col("first_seen").alias("_first"))
    was = previous.where("list = 'exclusion'").select("profile_id", "term", F.lit(True).alias("_was"))
    rows = weights.join(had, ["profile_id", "term"], "left").join(was, ["profile_id", "term"], "left")
    rows = rows.withColumns({"first_seen": F.coalesce("_first", "first_seen"), "_was": F.coalesce("_was", F.lit(False))})
    enough = F.col("jobs") >= limits.jobs
    known = rows.where("not frequent")
    routed = F.when(F.col("title_like"), "title").when(F.col("location_like"), "location").otherwise("keyword")
    boosts = known.where((F.col("net") >= limits.boost) & enough).withColumn("list", routed)
    excluded = known.where(F.when(F.col("_was"), F.col("net") <= limits.leave).otherwise((F.col("net") <= limits.enter) & enough)).withColumn("list", F.lit("exclusion"))
    away = firms.where((F.col("net") <= limits.enter) & enough).withColumn("list", F.lit("employer"))
    every = baseline.where("profile_id is null").select("term")
    found = rows.where("score > 0").join(small(every), "term", "left_anti").join(baseline.where("profile_id is not null"), ["profile_id", "term"], "left_anti").withColumn("list", F.lit("discovery"))

    def first(part: DataFrame, most: int | None, order: Column) -> DataFrame:
        part = part.withColumn("place", F.row_number().over(Window.partitionBy("profile_id", "list").orderBy(order, "term")))
        return (part if most is None else part.where(F.col("place") <= most)).select("profile_id", "list", "term", "net", "jobs", "first_seen", "place")

    # A cap for each list, as Spark cuts to a constant one before it brings a profile's terms together.
    caps = {"title": limits.titles, "location": limits.locations, "keyword": limits.keywords}
    parts = [
        known.withColumn("list", F.lit("known")).select("profile_id", "list", "term", "net", "jobs", "first_seen", F.lit(None).cast("int").alias("place")),
        *(first(boosts.where(F.col("list") == name), most, F.desc("net")) for name, most in caps.items()),
        first(excluded, limits.exclusions, F.asc("net")), first(away, None, F.asc("net")), first(found, limits.discovery, F.desc("score"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def learned_state(lists: DataFrame, previous: DataFrame, state: DataFrame, feedback: DataFrame) -> DataFrame:
    """STATE, a row for each profile with feedback: its version moves on only if what its lists say is another than
    before, whatever the weights are; ``added``: liked terms that were not known before."""
    said = lists.where("list <> 'known'").groupBy("profile_id", "list").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))
    print_ = said.groupBy("profile_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "list", "terms"))), ";"), 256).alias("fingerprint"))
    before = previous.where("list = 'known'").select("profile_id", "term")
    new = lists.where("list in ('title', 'location', 'keyword')").join(before, ["profile_id", "term"], "left_anti").groupBy("profile_id").agg(F.count("*").alias("added"))
    old = state.select("profile_id", F.col("version").alias("_version"), F.col("fingerprint").alias("_print"))
    rows = feedback.groupBy("profile_id").agg(F.count("*").alias("feedback")).join(print_, "profile_id", "left").join(new, "profile_id", "left").join(old, "profile_id", "left")
    rows = rows.withColumn("fingerprint", F.coalesce("fingerprint", F.sha2(F.lit(""), 256)))
    changed = ~F.col("fingerprint").eqNullSafe(F.col("_print"))
    version = F.coalesce("_version", F.lit(0)) + F.when(changed, 1).otherwise(0)
    return rows.select("profile_id", version.alias("version"), "fingerprint", "feedback", changed.alias("changed"), F.coalesce("added", F.lit(0)).cast("long").alias("added"))


def terms_of(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """job_terms and firm_terms of jobs, written once for one run or several."""
    named = written(jobs.select("job_id", "title", "employer", "location"))
    return written(job_terms(named)), written(firm_terms(named))


def run(feedback: DataFrame, jobs: DataFrame, previous: DataFrame, state: DataFrame, baseline: DataFrame, as_of: Column, limits: Limits | None = None, suggested: DataFrame | None = None, terms: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists, state) after a run over all feedback (profile_id, job_id, rating, applied, created_at) on jobs (job_id,
    title, employer, location). previous, state: what the run before gave, empty for the first; terms: terms_of the jobs,
    for several runs over the same. A run over the same feedback gives the same lists and versions again.

    What is read more than once is written: weights are read by each list, lists by the state."""
    limits = limits or Limits()
    since = count_written()
    own, firms = terms or terms_of(jobs)
    per = written(heard(feedback, as_of, limits))
    weights = written(term_weights(per, own, limits, suggested))
    lists = written(learned_lists(weights, term_weights(per, firms, limits), previous, baseline, limits))
    after = written(learned_state(lists, previous, state, feedback))
    drop_written(feedback.sparkSession, since, keep=2)
    return lists, after
