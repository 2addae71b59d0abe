"""Semantic merge, travel and publication over scored listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, places as P


def semantic_merge(scored: DataFrame, similar: DataFrame, alpha: float = 0.15, beta: float = 0.20, threshold: float = fixed.VECTOR_THRESHOLD) -> DataFrame:
    """Adds vector_score and updates score, unpenalized, lanes and passes of scored (job_id, profile_id, title_n,
    negative_n, missing_n, score, unpenalized, lanes, passes, hard_eligible). What is ruled out stays so.

    similar: job_id, profile_id, vector, preference, anti, the last two null where unknown. The likeness to
    what was disliked is not held against exploration. Rows without a vector stay as they are."""
    rows = scored.join(similar, ["job_id", "profile_id"], "left")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    liked = F.col("vector") + F.coalesce(F.col("preference") * alpha, F.lit(0.0))
    exploring = F.array_contains("lanes", "exploration") | (F.col("vector").isNotNull() & (unit(liked) >= threshold) & (F.col("title_n") == 0))
    # greatest and least pass over nulls.
    v = F.when(F.col("vector").isNotNull(), unit(liked - F.when(exploring, 0.0).otherwise(F.coalesce(F.col("anti") * beta, F.lit(0.0)))))
    rows = rows.withColumn("v", v)
    near = F.coalesce(F.col("v") >= threshold, F.lit(False))
    hidden = near & (F.col("title_n") == 0)
    none = F.array().cast("array<string>")
    lanes = F.array_union("lanes", F.concat(F.when(near, F.array(F.lit("semantic_similarity"))).otherwise(none), F.when(hidden, F.array(F.lit("exploration"))).otherwise(none)))
    score = F.when(F.col("v").isNull(), F.col("score").cast("double")).otherwise(F.greatest(F.col("score").cast("double"), F.round(15 + F.col("v") * 20, 2)))
    open_ = near & (F.col("negative_n") == 0) & (F.col("missing_n") == 0)
    passes = F.when(F.col("v").isNull(), F.col("passes")).otherwise(F.col("hard_eligible") & (F.col("passes") | open_))
    before = F.col("unpenalized").cast("double")
    return rows.select(
        "job_id", "profile_id", "title_n", score.alias("score"), F.when(F.col("v").isNull(), before).otherwise(F.round(F.greatest(before, score), 2)).alias("unpenalized"), lanes.alias("lanes"), passes.alias("passes"), "hard_eligible", F.round("v", 4).alias("vector_score"))


def best_routes(jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """(job_id, destination, duration_s, km): of each job's destinations the one reached soonest, the first of
    equally near ones. routes: destination, duration_s, km. Jobs without a known route give no row."""
    each = jobs.select("job_id", F.posexplode(P.destinations(F.col("location"))).alias("pos", "destination"))
    hits = each.join(routes, "destination")
    return hits.groupBy("job_id").agg(F.min_by(F.struct("destination", "duration_s", "km"), F.struct("duration_s", "pos")).alias("r")).select("job_id", "r.*")


def travel_scores(jobs: DataFrame, routes: DataFrame, home: str, limit_minutes: int = 120, origin: str | None = None, no_route: DataFrame | None = None, maps: bool = True) -> DataFrame:
    """(job_id, status, reason, adjustment, commutable, full_remote, duration_s, km): how each job is reached.

    jobs: job_id, location, and work_mode_text if there is one. home: the profile's home city, which counts only if
    the city of ``origin``, the address that routes start from, agrees with it (without an origin it does).
    no_route: destination of lookups that found nothing. A place exactly at the limit is inside it."""
    text = F.col("work_mode_text") if "work_mode_text" in jobs.columns else F.lit(None).cast("string")
    rows = jobs.select("job_id", "location", text.alias("_text")).join(best_routes(jobs, routes), "job_id", "left")
    if no_route is None:
        rows = rows.withColumn("_looked", F.lit(False))
    else:
        looked = jobs.select("job_id", F.explode(P.destinations(F.col("location"))).alias("destination")).join(no_route, "destination", "left_semi").select("job_id", F.lit(True).alias("_looked")).distinct()
        rows = rows.join(looked, "job_id", "left")
    places = P.destinations(F.col("location"))
    agrees = F.lit(True) if origin is None else F.coalesce(P.city_name(P.origin_city(F.lit(origin))) == home.strip().lower(), F.lit(False))
    exact = agrees & F.coalesce(P.city_name(F.col("location")) == home.strip().lower(), F.lit(False))
    inside = agrees & F.array_contains(places, P.destination(F.lit(home)))
    remote = P.full_remote(F.col("location")) | P.full_remote(F.col("_text"))
    looked, minutes, within = F.coalesce("_looked", F.lit(False)), F.col("duration_s") / 60, F.col("duration_s") <= limit_minutes * 60
    hybrid = F.coalesce(P.work_mode_of(F.col("location")) == "hybrid", F.lit(False))
    unknown = F.col("duration_s").isNull()
    kinds = [
        (exact, "exact_home_city", "exact_home_city", 12, True), (inside, "exact_home_city", "contains_home_city", 12, True), (remote, "full_remote", "full_remote", 15, False), (F.size(places) == 0, "vague", "vague", -5, False),
        (unknown & F.lit(not maps), "unknown", "transit_unavailable", -5, False), (unknown & looked, "unrouteable", "transit_unrouteable", -5, False), (unknown, "unknown", "transit_unknown", -5, False),
        (within & (minutes <= 45), "within_limit", "transit_within_limit", 10, True), (within & (minutes <= 90), "within_limit", "transit_within_limit", 6, True), (within, "within_limit", "transit_within_limit", 3, True),
        (hybrid, "hybrid", "transit_over_limit_hybrid", -8, False), (F.lit(True), "over_limit", "transit_over_limit", -15, False),
    ]
    kind = F.coalesce(*(F.when(test, F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), F.lit(n).alias("adjustment"), F.lit(c).alias("commutable"))) for test, s, r, n, c in kinds))
    routed = F.col("k.reason").startswith("transit_within") | F.col("k.reason").startswith("transit_over")
    return rows.select("job_id", kind.alias("k"), remote.alias("_remote"), "duration_s", "km").select(
        "job_id", "k.*", (F.col("_remote") & F.col("k.status").isin("exact_home_city", "full_remote")).alias("full_remote"), F.when(routed, F.col("duration_s")).alias("duration_s"), F.when(routed, F.col("km")).alias("km"))
