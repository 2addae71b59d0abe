"""The whole match of a catalogue with many profiles: pools, scores of all fields, gates, lanes, upsert, reconciliation,
reviews and the set that is shown."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, listing, text as T
from ..sources.tables import count_written, dealt, drop_written, spread, written
from . import gates, hits, ranking, scoring, state, upkeep

PAIR = ["profile_id", "job_id"]
POOLS = ["recent", "local", "remote", "discovery"]


@dataclass(frozen=True)
class Profiles:
    """What profiles look for, each a table by profile_id. terms: field, term (see scoring.term_matches); towns: town;
    phrases: term, for discovery; learned: phrase; negatives: kind, value (gates.negative_matches); cautions: value;
    exclusions: kind, value (scoring.exclusion_matches); quotas: lane, quota; likings: vector, preference, anti (null
    where unknown), keys: what a review depends on."""

    ids: DataFrame
    terms: DataFrame
    towns: DataFrame
    phrases: DataFrame
    learned: DataFrame
    negatives: DataFrame
    cautions: DataFrame
    exclusions: DataFrame
    quotas: DataFrame
    likings: DataFrame


@dataclass(frozen=True)
class Policy:
    """Parameters of a match. caps: most jobs of each pool, as in a top-k report; languages: code, rule; checks: see
    gates.qualification_gate; routes: destination, duration_s, km."""

    as_of: Column
    languages: DataFrame
    checks: DataFrame
    routes: DataFrame
    home: str
    caps: dict[str, int] = field(default_factory=lambda: {"recent": 500, "local": 500, "remote": 200, "discovery": 1500})
    vectors: int = 300
    reviews: int = 20
    budget: int = 12


def candidates(jobs: DataFrame, profiles: Profiles, caps: dict[str, int]) -> DataFrame:
    """(profile_id, job_id, pool): of every profile the newest jobs of each pool, a job in the first pool that has it.

    Jobs are cut to the cap by location and by phrase before they meet the profiles, as no profile can take more of
    any of these; so a town or a word that all look for is cut once."""
    newest = [F.desc_nulls_last("published_at"), F.desc("job_id")]
    first = lambda rows, n, *by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("_r") <= n).drop("_r")
    every = lambda rows, pool: profiles.ids.crossJoin(F.broadcast(rows.orderBy(*newest).limit(caps[pool]).select("job_id")))
    near = gates.town_pool(first(jobs.select("job_id", "location", "published_at"), caps["local"], "location"), profiles.towns)
    near = first(near.join(jobs.select("job_id", "published_at"), "job_id"), caps["local"], "profile_id")
    named = profiles.phrases.select("profile_id", T.normalized(F.col("term")).alias("phrase")).where("phrase <> ''").distinct()
    text = T.normalized(F.concat_ws(" ", "title", "description")).alias("text")
    found = first(hits.phrases_in(jobs.select("job_id", "published_at", text), named, ["published_at"]), caps["discovery"], "phrase")
    found = first(found.join(hits.small(named), "phrase").select("profile_id", "job_id", "published_at").distinct(), caps["discovery"], "profile_id")
    parts = [every(jobs, "recent"), near, every(gates.remote_pool(jobs), "remote"), found]
    rows = parts[0].select(*PAIR, F.lit(0).alias("pool"))
    for k, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.select(*PAIR, F.lit(k).alias("pool")))
    return rows.groupBy(*PAIR).agg(F.min("pool").alias("_k")).select(*PAIR, F.get(F.array(*map(F.lit, POOLS)), F.col("_k")).alias("pool"))


def job_facts(jobs: DataFrame, policy: Policy) -> DataFrame:
    """What holds of a job for every profile, a row each: has_location, missing_n, language_failed, language_review,
    qualification_reject, qualification_caution, eligible, reason."""
    spoken = gates.language_gate(jobs, policy.languages).groupBy("job_id").agg(
        F.bool_or(F.col("verdict") == "fail").alias("language_failed"), F.bool_or(F.col("verdict") == "caution").alias("language_review"))
    checked = gates.qualification_gate(jobs, policy.checks).groupBy("job_id").agg(
        F.bool_or(F.col("verdict") == "reject").alias("qualification_reject"), F.bool_or(F.col("verdict") == "caution").alias("qualification_caution"))
    missing = F.size(gates.missing_qualifications(F.col("_n"), F.col("_n")))
    has = F.coalesce(F.col("location") != "", F.lit(False))
    # Normalised once, as a column that several expressions read stays one, and only where a mark of a qualification stands.
    whole = F.concat_ws(" ", "title", "employer", "description")
    marked = T.has_any(F.lower(whole), [m for marks in fixed.QUALIFICATION_MARKS.values() for m in marks] + [p.split()[-1] for p in fixed.QUALIFICATION_PHRASES])
    own = gates.freshness(jobs, policy.as_of).withColumn("_n", F.when(marked, T.normalized(whole)).otherwise(F.lit("")))
    own = own.select("job_id", has.alias("has_location"), missing.alias("missing_n"), "eligible", "reason")
    return own.join(spoken, "job_id", "left").join(checked, "job_id", "left")


def scored_pairs(pairs: DataFrame, jobs: DataFrame, profiles: Profiles, vectors: DataFrame, policy: Policy) -> DataFrame:
    """Every pair (profile_id, job_id, pool; null for one that is stored only) with its score of all fields, gates,
    vectors and travel: score, unpenalized, lanes, passes, hard_eligible, hard_reasons, vector_score.

    Texts stay on the side of the jobs: they are cut into tokens once, and what is found is joined by id. What profiles
    without a pair look for is not looked for."""
    profiles = _asking(profiles, pairs)
    tokens = hits.job_tokens(jobs)
    tokens, known = hits.only_met(tokens, hits.distinct_tokens(tokens), *_words(profiles))
    matches = scoring.term_matches(jobs, profiles.terms, tokens, known).join(pairs.select(*PAIR), PAIR, "left_semi")
    negative = gates.negative_matches(pairs.select(*PAIR), jobs, profiles.negatives, tokens, known).select(*PAIR, F.size("matches").alias("negative_n"))
    whole = T.normalized(F.concat_ws(" ", "title", "employer", "description"))
    caution = hits.texts_within(jobs.select("job_id", whole.alias("text")), profiles.cautions, tokens.where("raw"), known.where("raw")).join(hits.small(profiles.cautions.distinct()), "value")
    caution = caution.groupBy(*PAIR).agg(F.count("*").alias("caution_n"))
    avoided = scoring.exclusion_matches(pairs, jobs, profiles.exclusions, tokens=tokens, known=known).select(*PAIR, "exclusion_penalty")
    facts = pairs.join(job_facts(jobs, policy), "job_id").join(negative, PAIR, "left").join(caution, PAIR, "left").join(avoided, PAIR, "left")
    facts = written(facts)
    scored = scoring.deterministic_scores(scoring.match_scores(matches), facts)
    scored = scored.join(facts.select(*PAIR, "pool", "eligible", "reason"), PAIR)
    # Only what came through the discovery pool can have been learned.
    found = jobs.join(pairs.where("pool = 'discovery'").select("job_id").distinct(), "job_id", "left_semi")
    scored = gates.learned_discovery(scored, found, profiles.learned)
    fresh = F.col("eligible")
    scored = scored.withColumns({
        "passes": F.col("passes") & fresh, "hard_eligible": F.col("hard_eligible") & fresh,
        "hard_reasons": F.when(fresh, F.col("hard_reasons")).otherwise(F.array_append("hard_reasons", F.col("reason")))})
    merged = ranking.semantic_merge(scored, _similar(pairs, profiles.likings, vectors, policy.vectors))
    travel = ranking.travel_scores(jobs, policy.routes, policy.home).select("job_id", "adjustment")
    merged = merged.join(scored.select(*PAIR, "pool", "hard_reasons"), PAIR).join(travel, "job_id")
    moved = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + F.col("adjustment"))), 2)
    return merged.withColumn("score", moved).select(*PAIR, "pool", "score", "unpenalized", "lanes", "passes", "hard_eligible", "hard_reasons", "vector_score")


def _asking(profiles: Profiles, pairs: DataFrame) -> Profiles:
    """What the profiles of some pairs look for."""
    ids = hits.small(written(pairs.select("profile_id").distinct()))
    of = lambda table: table.join(ids, "profile_id", "left_semi")
    return dataclasses.replace(profiles, **{k: of(getattr(profiles, k)) for k in ("terms", "learned", "negatives", "cautions", "exclusions", "likings")})


def _words(profiles: Profiles) -> tuple[DataFrame, DataFrame]:
    """(word) of all that profiles look for as parts of tokens, and (variant) of all that they look for as such."""
    wished = profiles.negatives.where("kind = 'keyword'").select("value").union(profiles.cautions.select("value")).union(profiles.exclusions.where("kind <> 'employer'").select("value")).distinct()
    pieces = F.array_union(T.tokens(F.col("value")), F.array_union(F.split("value", T.OTHER), F.split(F.lower("value"), T.OTHER)))
    words = written(wished.select(F.explode_outer(pieces).alias("word")).where("word <> ''").distinct())
    terms = profiles.terms.select(F.explode_outer(T.token_variants(F.col("term"))).alias("variant")).where("variant is not null")
    return words, written(terms.union(words).distinct())


def _similar(pairs: DataFrame, likings: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(job_id, profile_id, vector, preference, anti) of the ``most`` nearest jobs of each profile."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: dot(F.col(c), F.col(c))
    wished = likings.where("vector is not null").select("profile_id", *(x for c in ("vector", "preference", "anti") for x in (F.col(c).alias(f"_{c}"), norm(c).alias(f"_{c}_n"))))
    own = vectors.select("job_id", "embedding", norm("embedding").alias("_n"))
    rows = pairs.select(*PAIR).join(own, "job_id").join(hits.small(wished), "profile_id")
    like = lambda c: (dot(F.col("embedding"), F.col(f"_{c}")) / F.sqrt(F.col("_n") * F.col(f"_{c}_n"))).alias(c)
    rows = rows.select(*PAIR, like("vector"), like("preference"), like("anti"))
    near = Window.partitionBy("profile_id").orderBy(F.desc("vector"), F.col("job_id"))
    return rows.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= most).drop("_r")


def likings(vectors: DataFrame, wishes: DataFrame, feedback: DataFrame) -> DataFrame:
    """(profile_id, vector, preference, anti): the vector of each profile in wishes (profile_id, vector), and the mean
    vectors of what its feedback (profile_id, job_id, rating, applied) likes and dislikes, of three jobs at least."""
    liked = (F.col("rating") >= 4) | F.col("applied")
    sign = F.when(liked, "preference").when(F.col("rating") <= 2, "anti")
    told = feedback.select(*PAIR, sign.alias("sign")).where("sign is not null").distinct().join(vectors, "job_id")
    mean = lambda s: scoring.centroids(told.where(F.col("sign") == s), "profile_id").select("profile_id", F.col("centroid").alias(s))
    return wishes.join(mean("preference"), "profile_id", "left").join(mean("anti"), "profile_id", "left")


def run(jobs: DataFrame, profiles: Profiles, vectors: DataFrame, stored: DataFrame, feedback: DataFrame, policy: Policy) -> DataFrame:
    """The table of recommendations after a match, a row for each pair that was stored or passes.

    jobs: job_id, status, title, employer, description, location, published_at, expires_at, review_key (what verdict and
    review of it depend on). vectors: job_id, embedding. stored: profile_id, job_id, score, rank, rationale, active,
    hard_eligible, evaluation_id, action, tier, review_score, review_key. feedback: profile_id, job_id, rating, action,
    applied.

    Candidates of all pools are scored, and of the stored pairs those whose key is another now; the others keep the
    verdict that they had, but for their dates. All is in one table that every later step reads. Candidates that pass
    stand in lane order and are upserted; of those that may be reviewed each bucket takes its share, and reviews that
    still hold are not made again; what has a valid review is shown, in the order of reviews."""
    since, jobs = count_written(), spread(jobs)
    keys = jobs.select("job_id", F.col("review_key").alias("_key"))
    changed = stored.join(keys, "job_id").where(~F.col("review_key").eqNullSafe(F.col("_key")))
    pairs = candidates(jobs.where("status = 'active'"), profiles, policy.caps).join(changed.select(*PAIR), PAIR, "full").select(*PAIR, "pool")
    # Read by every fact, and by the scores: written once.
    pairs = written(pairs)
    needed = written(dealt(jobs.join(pairs.select("job_id").distinct(), "job_id", "left_semi"), "job_id"))
    scored = written(scored_pairs(pairs, needed, profiles, vectors, policy))
    travel = ranking.travel_scores(jobs, policy.routes, policy.home).select("job_id", F.col("status").alias("travel"), "commutable", "full_remote")
    travel = travel.join(keys, "job_id").join(gates.freshness(jobs, policy.as_of).select("job_id", "eligible", "reason"), "job_id")
    passing = scored.where("pool is not null and passes").join(travel, "job_id")
    placed = scoring.lane_quota_order(passing, keep=["score", "commutable", "full_remote"], overrides=profiles.quotas)
    near, either = F.col("commutable"), F.col("commutable") | F.col("full_remote")
    along = Window.partitionBy("profile_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda flag: F.when(flag, F.sum(flag.cast("int")).over(along))
    placed = placed.select(*PAIR, "score", "place", count(near).alias("near_place"), count(either).alias("either_place"))
    after = upkeep.recommendation_upsert(placed.select(*PAIR, "score", F.col("place").alias("rank"), F.lit("match").alias("rationale")), stored, feedback, activate=False)
    hidden = feedback.where("rating <= 1 or action = 'not_relevant'").select(*PAIR, F.lit(True).alias("hidden")).distinct()
    told = stored.select(*PAIR, "evaluation_id", "action", "tier", "review_score", F.col("review_key").alias("_had"), F.col("hard_eligible").alias("_could"))
    verdicts = scored.select(*PAIR, "pool", "unpenalized", "lanes", "hard_eligible", "hard_reasons")
    rows = after.join(verdicts, PAIR, "left").join(placed.drop("score"), PAIR, "left").join(told, PAIR, "left").join(hidden, PAIR, "left").join(travel, "job_id", "left")
    reviewed, same, fresh = F.col("evaluation_id").isNotNull(), F.col("_had").eqNullSafe(F.col("_key")), F.coalesce("eligible", F.lit(False))
    kept = F.coalesce("_could", F.lit(False)) & fresh
    reasons = F.array_compact(F.array(F.when(~F.coalesce("_could", F.lit(False)), "earlier"), F.when(~fresh, F.col("reason"))))
    rows = rows.withColumns({"hard_eligible": F.coalesce("hard_eligible", kept), "hard_reasons": F.coalesce("hard_reasons", reasons), "current": reviewed & same, "hidden": F.coalesce("hidden", F.lit(False))})
    rows = rows.withColumn("refresh", F.when(~F.col("hard_eligible"), "hard_reject").when(reviewed & ~same, "changed"))
    rows = written(rows.select(*PAIR, "pool", "outcome", "score", "unpenalized", "lanes", "hard_eligible", "hard_reasons", "travel", "commutable", "full_remote", "place", "near_place", "either_place",
                               "rank", "evaluation_id", "action", "tier", "review_score", "refresh", "current", "hidden"))
    # The result reads the last table only.
    drop_written(rows.sparkSession, since, keep=1)
    return rows.join(_reviews(rows, policy), PAIR, "left").join(_shown(rows), PAIR, "left").withColumn("active", F.col("shown_rank").isNotNull())


def reconciled(stored: DataFrame, jobs: DataFrame, profiles: Profiles, vectors: DataFrame, policy: Policy, policy_key: str) -> DataFrame:
    """stored with the verdict that holds now: profile_id, job_id, key, score, hard_eligible, hard_reasons, touched, refresh.

    stored: profile_id, job_id, score, hard_eligible, hard_reasons, key: ``verdict_key`` of what it was made from. jobs: as
    in run; profiles.ids also has profile_key. Only rows whose key is another now, by job, profile or policy, are scored
    again; the result is that of scoring all, as a verdict depends on nothing else. ``refresh`` is ``hard_reject`` for what
    is ruled out, ``changed`` for other touched rows, null where all holds. Rows of jobs or profiles that are gone are
    ruled out with the reason ``gone``."""
    expected = F.when(F.col("_job").isNotNull() & F.col("_profile").isNotNull(), verdict_key(F.col("_job"), F.col("_profile"), policy_key))
    now = jobs.select("job_id", F.col("review_key").alias("_job")), profiles.ids.select("profile_id", F.col("profile_key").alias("_profile"))
    rows = stored.join(now[0], "job_id", "left").join(hits.small(now[1]), "profile_id", "left").withColumn("_key", expected)
    rows = written(rows.withColumn("touched", ~F.col("key").eqNullSafe(F.col("_key"))))
    again = rows.where("touched and _key is not null").select(*PAIR, F.lit(None).cast("string").alias("pool"))
    needed = written(dealt(jobs.join(again.select("job_id").distinct(), "job_id", "left_semi"), "job_id"))
    fresh = scored_pairs(again, needed, profiles, vectors, policy).select(*PAIR, F.struct("score", "hard_eligible", "hard_reasons").alias("n"))
    out = rows.join(fresh, PAIR, "left")
    gone = F.col("_key").isNull()
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c))
    able = ~gone & pick("hard_eligible")
    why = F.when(gone, F.array(F.lit("gone"))).otherwise(pick("hard_reasons"))
    refresh = F.when(~able, "hard_reject").when(F.col("touched"), "changed")
    return out.select(*PAIR, F.col("_key").alias("key"), pick("score").alias("score"), able.alias("hard_eligible"), why.alias("hard_reasons"), "touched", refresh.alias("refresh"))


def verdict_key(job: Column, profile: Column, policy: str) -> Column:
    """What a verdict was made from."""
    return listing.identity(job=job, profile=profile, policy=F.lit(policy))


def _reviews(rows: DataFrame, policy: Policy) -> DataFrame:
    """(profile_id, job_id, bucket, review_place, review): what is reviewed, by which bucket, and whether a review that
    holds is there (hit), is made (evaluate) or waits (deferred)."""
    priority = F.when(F.col("evaluation_id").isNull(), 0).when(~F.col("current"), 1).otherwise(2)
    open_ = rows.where("place is not null and hard_eligible and not hidden").select(
        F.concat_ws("-", *PAIR).alias("rec_id"), *PAIR, "commutable", F.col("full_remote").alias("remote"), priority.alias("priority"), F.col("place").alias("nationwide"), F.col("score").alias("machine_score"), F.col("current").alias("hit"))
    asked = upkeep.review_buckets(open_, policy.reviews)
    planned = state.within_budget(asked, "profile_id", policy.budget, F.col("bucket"), F.col("place"))
    return planned.select(*PAIR, "bucket", F.col("place").alias("review_place"), F.col("status").alias("review"))


def _shown(rows: DataFrame) -> DataFrame:
    """(profile_id, job_id, shown_rank, shown_near, shown_either) of the rows that may be shown."""
    valid = gates.publishable(rows.withColumns({"awaiting_refresh": F.coalesce(F.col("refresh") == "changed", F.lit(False)), "compatible": F.col("refresh").isNull()}))
    order = F.when(F.col("action") == "apply", 0).when(F.col("action") == "consider", 1).otherwise(2)
    near, either = F.coalesce("commutable", F.lit(False)), F.coalesce(F.col("commutable") | F.col("full_remote"), F.lit(False))
    flags = {"shown_rank": F.lit(True), "shown_near": near, "shown_either": either}
    return state.ranks_within(valid, "profile_id", flags, order, F.desc_nulls_last("review_score"), F.desc("score"), F.col("job_id")).select(*PAIR, *flags)
