"""The whole match over the driver's tables: their documents as jobs, their benchmark as wishes of profiles."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing as L
from ..operators import matching
from ..sources.tables import dealt, written
from .binding import Tables


def as_of() -> Column:
    """The moment that stands for now."""
    return F.lit("2024-03-20 00:00:00").cast("timestamp_ntz")


ROUTES = [("Oulu, Finland", 600, 8.0), ("Ylivieska, Finland", 5400, 130.0), ("Kuopio, Finland", 14400, 290.0), ("Helsinki, Finland", 21600, 610.0), ("Kempele, Finland", 1500, 12.0), ("Kuopio, Suomi", 7200, 290.0)]


def routes(t: Tables) -> DataFrame:
    """Known routes: a small table of destinations."""
    return t.spark.createDataFrame(ROUTES, "destination string, duration_s long, km double")


#: What a profile's term is to it, by the slot of the term.
SLOTS = ["title", "keyword", "history_title", "history_keyword", "learned_title", "learned_keyword", "sector", "keyword", "title", "negative", "caution", "exclusion"]
TOWNS = ["Oulu", "Ylivieska", "Kuopio"]
LANGUAGES = [("fi", "pass"), ("en", "reject"), ("sv", "above_b2")]
CAPS = {"recent": 60, "local": 40, "remote": 50, "discovery": 120}
REVIEWS, BUDGET, VECTORS = 20, 8, 100


def slot() -> Column:
    return F.get(F.array(*map(F.lit, SLOTS)), ((F.length("term") * 3 + F.col("profile_id")) % len(SLOTS)).cast("int"))


def town() -> Column:
    return F.get(F.array(*map(F.lit, TOWNS)), (F.col("profile_id") % len(TOWNS)).cast("int"))


def profiles(t: Tables) -> matching.Profiles:
    """Profiles of the benchmark: what each of its words is to the profile follows from its length."""
    from .listings import discovery_terms, quota_overrides

    own = t.profile_term.select("profile_id", slot().alias("field"), "term")
    ids = t.profile_term.select("profile_id").distinct()
    of = lambda field: own.where(F.col("field") == field).select("profile_id", F.col("term").alias("value"))
    says = lambda pattern: F.regexp_extract(F.lower("text"), pattern, 1)
    texts = t.benchmark.select(F.col("item_id").alias("profile_id"), says("^[^0-9a-zåäö]*([0-9a-zåäö]+ [0-9a-zåäö]+)").alias("first"), says("([0-9a-zåäö]+)[^0-9a-zåäö]*$").alias("last")).distinct()
    place = lambda field, name, where: ids.where(where).select("profile_id", F.lit(field).alias("field"), name.alias("term"))
    places = place("location", F.lower(town()), "true").union(place("history_location", F.lit("kuopio"), "profile_id % 2 = 0")).union(place("learned_location", F.lit("helsinki"), "profile_id % 3 = 0"))
    kind = lambda rows, name: rows.select("profile_id", F.lit(name).alias("kind"), "value")
    firms = ids.select("profile_id", F.concat(F.lit("EMP"), (F.col("profile_id") % 37).cast("string")).alias("value"))
    wishes = t.embeddings.select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("vector")).join(ids, "profile_id")
    return matching.Profiles(
        ids=ids, terms=own.where(~F.col("field").isin("negative", "caution", "exclusion")).union(places), towns=ids.select("profile_id", town().alias("town")),
        phrases=discovery_terms(t).select("profile_id", "term"), learned=texts.select("profile_id", F.col("first").alias("phrase")),
        negatives=kind(of("negative").where(F.length("value") >= 10), "keyword").union(kind(texts.select("profile_id", F.col("last").alias("value")), "title")),
        cautions=of("caution"), exclusions=kind(of("exclusion"), "term").union(kind(firms, "employer")).union(kind(texts.select("profile_id", F.col("first").alias("value")), "sector")),
        quotas=quota_overrides(t), likings=matching.likings(_vectors(t), wishes, t.feedback))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("job_id"), "embedding")


def postings(t: Tables) -> DataFrame:
    """Jobs whose texts say something of qualifications and languages."""
    from .verdicts import _SAID, _chosen, _demanding

    said = _demanding(t).withColumn("description", F.concat("description", F.lit(" "), _chosen(_SAID)))
    key = L.identity(title=F.col("title"), employer=F.col("employer"), n_chars=F.col("n_chars"))
    return said.select("job_id", "status", "title", "employer", "description", "location", "published_at", "expires_at", key.alias("review_key"))


def stored(t: Tables) -> DataFrame:
    """Recommendations of an earlier match; of every fifth the text has changed since its review."""
    from .verdicts import _chosen, _demanding

    key = L.identity(title=F.col("title"), employer=F.col("employer"), n_chars=F.when(F.col("job_id") % 5 == 0, -1).otherwise(F.col("n_chars")))
    jobs = _demanding(t).select("job_id", key.alias("review_key"))
    k = F.col("rec_id")
    rows = t.rec.select(
        "profile_id", "job_id", F.col("machine_score").cast("double").alias("score"), (k % 50).cast("int").alias("rank"), F.lit("earlier").alias("rationale"), (k % 5 != 0).alias("active"), (~F.col("hard_rejected")).alias("hard_eligible"),
        F.when(F.col("review_score").isNotNull(), k).alias("evaluation_id"), "action", _chosen([None, "strong", "not_applicable", "fair", "strong"], "rec_id").alias("tier"), "review_score")
    return rows.join(jobs, "job_id")


def recommendations(t: Tables) -> DataFrame:
    """Every recommendation after the match, see matching.run."""
    feedback = t.feedback.select("profile_id", "job_id", "rating", "applied", F.when(F.col("feedback_id") % 7 == 0, "not_relevant").otherwise("other").alias("action"))
    rows = matching.run(postings(t), profiles(t), _vectors(t), stored(t), feedback, _policy(t))
    return rows.select(
        "profile_id", "job_id", "pool", "outcome", "score", "unpenalized", F.array_join("lanes", ",").alias("lanes"), F.array_join("hard_reasons", ",").alias("reasons"), "travel", "place", "near_place", "either_place",
        "rank", "refresh", "bucket", "review_place", "review", "active", "shown_rank", "shown_near", "shown_either")


def _policy(t: Tables, vectors: int = VECTORS) -> matching.Policy:
    return matching.Policy(as_of(), t.spark.createDataFrame(LANGUAGES, "code string, rule string"), _checks(t), routes(t), "Oulu", CAPS, vectors, REVIEWS, BUDGET)


def edited(jobs: DataFrame) -> DataFrame:
    """The jobs after an edit of every seventh: the title of some names a profession that rules them out, of others the
    text begins anew."""
    k = F.col("job_id")
    title = F.when(k % 14 == 0, F.concat(F.lit("Hammaslääkäri "), "title")).otherwise(F.col("title"))
    text = F.when(k % 14 == 7, F.concat(F.lit("Kirjasto. "), "description")).otherwise(F.col("description"))
    key = F.when(k % 7 == 0, F.concat("review_key", F.lit("+"))).otherwise(F.col("review_key"))
    return jobs.withColumns({"title": title, "description": text, "review_key": key})


def reconciled(t: Tables) -> DataFrame:
    """Verdicts made of the jobs as they were, held against the jobs after an edit."""
    # No limit on vectors: a verdict must not depend on which other rows are scored with it.
    policy, who = _policy(t, 1 << 30), profiles(t)
    who = dataclasses.replace(who, ids=who.ids.withColumn("profile_key", F.concat(F.lit("p"), F.col("profile_id").cast("string"))))
    # Read by every step: written once.
    before = written(dealt(postings(t), "job_id"))
    pairs = t.rec.select("profile_id", "job_id", F.lit(None).cast("string").alias("pool"))
    key = matching.verdict_key(F.col("review_key"), F.col("profile_key"), "v1")
    kept = matching.scored_pairs(pairs, before, who, _vectors(t), policy).join(before.select("job_id", "review_key"), "job_id").join(who.ids, "profile_id").withColumn("key", key)
    return matching.reconciled(written(kept), edited(postings(t)), who, _vectors(t), policy, "v1")


def _checks(t: Tables) -> DataFrame:
    from .verdicts import _CHECKS

    lists = ", ".join(f"{c} array<string>" for c in ("title_or_text", "reject", "adjacent", "caution", "required"))
    return t.spark.createDataFrame(_CHECKS, f"name string, {lists}, never_by_title boolean")
