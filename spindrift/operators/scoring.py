"""Match scores of listings against many profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..sources.tables import written
from .hits import LEAST, distinct_tokens, job_tokens, small, texts_within, variants_of, words_within


#: Fields of terms and the text of a job that they are matched with.
PLACES = {"title": "title", "history_title": "title", "learned_title": "title", "history_location": "location", "learned_location": "location", "location": "location"}


def term_matches(jobs: DataFrame, terms: DataFrame, tokens: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(job_id, profile_id, field, term): a term matches if one of its variants is a variant of a token of the
    title, the location or the whole text, as PLACES says of its field. terms: profile_id, field, term; general
    terms match nothing. tokens: job_tokens(jobs), if there are some already; known: distinct_tokens of them.

    A job's text is cut into distinct tokens once, each with where it stands. Variants are made of the distinct tokens
    of all jobs, not of each job's, and meet the terms' variants there. What they find, a table of the profiles' size, is
    broadcast back to the jobs' tokens if it is small; so no token that most jobs have is a hot key."""
    tokens = (job_tokens(jobs) if tokens is None else tokens).where("in_text or in_location")
    wanted = terms.where(~F.col("term").isin(fixed.GENERIC_TERMS)).select("profile_id", "field", "term", F.explode(T.token_variants(F.col("term"))).alias("variant")).distinct()
    known = tokens.select("token").distinct() if known is None else known.where("in_text or in_location").select("token")
    wanted = written(wanted)
    found = written(variants_of(known, wanted).join(small(wanted), "variant").select("token", "profile_id", "field", "term").distinct())
    place = F.coalesce(*(F.when(F.col("field") == f, p) for f, p in PLACES.items()), F.lit("text"))
    stands = F.when(place == "title", F.col("in_title")).when(place == "location", F.col("in_location")).otherwise(F.col("in_text"))
    return tokens.join(small(found), "token").where(stands).select("job_id", "profile_id", "field", "term").distinct()


#: Field: most matches that count, points for each.
POINTS = {"title": (5, 15), "keyword": (8, 5), "history_title": (4, 18), "history_keyword": (6, 5), "sector": (3, 4), "learned_title": (4, 18), "learned_keyword": (6, 5)}
#: Fields that only say that a place matches.
LOCATIONS = ["location", "history_location", "learned_location"]


def match_scores(matches: DataFrame) -> DataFrame:
    """(job_id, profile_id, <field>_n ..., score, lanes): matches of each field, capped counts times points, at most
    100, and the lanes that a job qualifies for. What the job itself adds is in deterministic_scores."""
    count = lambda field: F.count_if(F.col("field") == field)
    per = matches.groupBy("job_id", "profile_id").agg(*(count(f).alias(f"{f}_n") for f in [*POINTS, *LOCATIONS]))
    score = reduce(Column.__add__, (F.least(F.col(f"{f}_n"), F.lit(most)) * points for f, (most, points) in POINTS.items()))
    history = (F.col("history_title_n") + F.col("history_keyword_n")) > 0
    sector = (F.col("sector_n") > 0) & (history | (F.col("keyword_n") > 0))
    transferable = (F.col("title_n") == 0) & (F.col("keyword_n") >= 2)
    hidden = (F.col("title_n") == 0) & (history | transferable | sector)
    lanes = F.array_compact(F.array(
        F.when(F.col("title_n") > 0, "direct_title"), F.when(history, "application_history"), F.when(transferable, "transferable_duty"), F.when(sector, "sector_context"), F.when(hidden, "exploration")))
    return per.select("job_id", "profile_id", *(f"{f}_n" for f in [*POINTS, *LOCATIONS]), score.cast("long").alias("raw"), F.least(score, F.lit(100)).cast("long").alias("score"), lanes.alias("lanes"))


def deterministic_scores(counted: DataFrame, facts: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The whole score of jobs for profiles: (job_id, profile_id, title_n, negative_n, missing_n, score,
    unpenalized, passes, hard_eligible, hard_reasons, concerns, lanes).

    counted: match_scores(). facts: job_id, profile_id, has_location, negative_n, missing_n, caution_n,
    exclusion_penalty, language_failed, language_review, qualification_reject, qualification_caution; a fact that is
    null counts as 0 or false. clusters: job_id, profile_id, contribution of profiles with weights of their own; it
    takes the place of points and of the location's 15 (3 if the job has none). History and learned places add 7
    each, negative terms or a missing qualification take 40. The penalty counts only after the pass rule, 15 points
    and nothing that rules the job out."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = facts.join(counted, ["job_id", "profile_id"], "left")
    rows = rows.join(clusters, ["job_id", "profile_id"], "left") if clusters is not None else rows.withColumn("contribution", F.lit(None).cast("double"))
    placed, negative, missing = zero(F.col("location_n")) > 0, zero(F.col("negative_n")) > 0, zero(F.col("missing_n")) > 0
    points = zero(F.col("raw")) + F.when(placed, 15).when(~F.col("has_location"), 3).otherwise(0)
    whole = F.coalesce("contribution", points.cast("double")) + F.when(zero(F.col("history_location_n")) > 0, 7).otherwise(0) + F.when(zero(F.col("learned_location_n")) > 0, 7).otherwise(0) - F.when(negative | missing, 40).otherwise(0)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    language, rejected = no(F.col("language_failed")), no(F.col("qualification_reject"))
    said = {"negative": negative, "missing": missing, "caution": zero(F.col("caution_n")) > 0, "qualification": no(F.col("qualification_caution")), "language": no(F.col("language_review")), "location": F.col("has_location") & ~placed}
    concerns = F.array_compact(F.array(*(F.when(test, F.lit(fixed.CONCERNS[k])) for k, test in said.items())))
    reasons = F.array_compact(F.array(F.when(negative, "negative_match"), F.when(missing, "missing_qualification"), F.when(language, "language_requirement"), F.when(rejected, "qualification")))
    passes = (clip(whole) >= 15) & ~negative & ~missing & ~language & ~rejected
    return rows.select(
        "job_id", "profile_id", zero(F.col("title_n")).alias("title_n"), zero(F.col("negative_n")).alias("negative_n"), zero(F.col("missing_n")).alias("missing_n"),
        F.round(clip(whole - zero(F.col("exclusion_penalty"))), 2).alias("score"), F.round(clip(whole), 2).alias("unpenalized"), passes.alias("passes"), (F.size(reasons) == 0).alias("hard_eligible"), reasons.alias("hard_reasons"),
        concerns.alias("concerns"), F.coalesce("lanes", F.array().cast("array<string>")).alias("lanes"))


def exclusion_matches(pairs: DataFrame, jobs: DataFrame, exclusions: DataFrame, each: float = 8.0, tokens: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(job_id, profile_id, exclusion_penalty, matches) of the pairs (job_id, profile_id) that meet what a profile has
    learned to avoid. exclusions: profile_id, kind (term, employer, sector), value. tokens: job_tokens(jobs), if there
    are some already; known: distinct_tokens of them.

    Tokens of four characters and more of a term count if they are part of the text or a variant of its tokens,
    employers if they are part of the employer, sectors if they are part of the text. Each takes ``each`` points."""
    words = exclusions.where("kind = 'term'").select("profile_id", F.explode(T.tokens(F.col("value"))).alias("value")).where(F.length("value") >= LEAST).distinct()
    others = exclusions.where("kind <> 'term'").select("profile_id", "kind", F.lower("value").alias("value")).where("value <> ''").distinct()
    firms, sectors = others.where("kind = 'employer'").drop("kind"), others.where("kind = 'sector'").drop("kind")
    tokens = job_tokens(jobs) if tokens is None else tokens
    known = distinct_tokens(tokens) if known is None else known
    part = words_within(tokens, words.withColumnRenamed("value", "word"), known.where("raw")).select("token", "word", F.lit(False).alias("whole"))
    alike = written(words.select(F.col("value").alias("variant")).distinct())
    same = variants_of(known.where("in_text"), alike).join(small(alike), "variant").select("token", F.col("variant").alias("word"), F.lit(True).alias("whole"))
    held = tokens.join(small(written(part.union(same).distinct())), "token").where(F.when(F.col("whole"), F.col("in_text")).otherwise(F.col("raw")))
    employers = jobs.select(F.lower("employer").alias("text")).where("text is not null").distinct()
    named = texts_within(employers.select(F.col("text").alias("job_id"), "text"), firms).select(F.col("job_id").alias("text"), "value")
    named = jobs.select("job_id", F.lower("employer").alias("text")).join(small(named), "text").select("job_id", "value")
    told = texts_within(jobs.select("job_id", F.lower(F.concat_ws(" ", "title", "employer", "description")).alias("text")), sectors, tokens.where("raw"), known.where("raw"))
    of = lambda kind, found, wanted: found.distinct().join(small(wanted), "value").select("job_id", "profile_id", F.lit(kind).alias("kind"), "value")
    found = of("term", held.select("job_id", F.col("word").alias("value")), words).union(of("employer", named, firms)).union(of("sector", told, sectors))
    lists = found.groupBy("job_id", "profile_id").agg((F.count("*") * each).alias("exclusion_penalty"), F.array_sort(F.collect_set("value")).alias("matches"))
    return pairs.select("job_id", "profile_id").join(lists, ["job_id", "profile_id"])


def effective_quotas(overrides: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(profile_id, lane, quota) of the profiles in overrides (profile_id, lane, quota): known lanes take the quota given,
    the least one if there are several; ``exploration`` has one at least; null quotas and unknown lanes change nothing."""
    most = most or fixed.LANE_QUOTAS
    lanes = F.explode(F.array(*(F.struct(F.lit(k).alias("lane"), F.lit(q).alias("_q")) for k, q in most.items()))).alias("x")
    given = overrides.groupBy("profile_id", "lane").agg(F.min("quota").alias("_given"))
    rows = overrides.select("profile_id").distinct().select("profile_id", lanes).select("profile_id", "x.*").join(given, ["profile_id", "lane"], "left")
    quota = F.coalesce("_given", "_q")
    return rows.select("profile_id", "lane", F.when(F.col("lane") == "exploration", F.greatest(F.lit(1), quota)).otherwise(quota).cast("int").alias("quota"))


def lane_quota_order(scored: DataFrame, quotas: dict[str, int] | None = None, keep: list[str] | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(profile_id, job_id, place) and the columns ``keep``: lanes in order take their quota of the best rows not yet
    taken; all other rows follow by score. scored: profile_id, job_id, score, lanes, and unpenalized, by which the lane
    ``exploration`` takes its rows where it is there and not null. overrides: quotas of profiles, see effective_quotas.

    Only the best rows of each lane, as many as all quotas up to it together, can be taken by it, so these alone are
    folded per profile; the rest is ranked by a window."""
    quotas = quotas or fixed.LANE_QUOTAS
    free = F.coalesce("unpenalized", "score") if "unpenalized" in scored.columns else F.col("score")
    every = F.array(*(F.struct(F.lit(k).alias("lane"), F.lit(q).alias("quota")) for k, q in quotas.items()))
    reach, own = sum(quotas.values()), None
    if overrides is not None:
        # One row for each profile with quotas of its own, and one number: the most that any profile takes.
        place = F.array_position(F.array(*map(F.lit, quotas)), F.col("lane"))
        own = effective_quotas(overrides, quotas).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "lane", "quota"))).alias("_own"))
        own = own.select("profile_id", F.transform("_own", lambda x: F.struct(x["lane"].alias("lane"), x["quota"].alias("quota"))).alias("_own"))
        total = F.aggregate("_own", F.lit(0), lambda s, x: s + F.greatest(F.lit(0), x["quota"]))
        reach = max(reach, own.agg(F.max(total)).first()[0] or 0)
    each = scored.select("profile_id", "job_id", "score", free.alias("_free"), F.explode("lanes").alias("lane")).where(F.col("lane").isin(*quotas))
    by = F.when(F.col("lane") == "exploration", F.col("_free")).otherwise(F.col("score"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("profile_id", "lane").orderBy(by.desc(), F.col("job_id")))).where(F.col("r") <= reach)
    lists = each.groupBy("profile_id", "lane").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "job_id"))), lambda x: x["job_id"]).alias("jobs"))
    lists = lists.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("lane", "jobs"))).alias("by_lane"))
    lists = lists.withColumn("_steps", every) if own is None else lists.join(small(own), "profile_id", "left").withColumn("_steps", F.coalesce("_own", every))
    none = F.array().cast("array<bigint>")
    rest = lambda got, s: F.array_except(F.coalesce(F.try_element_at("by_lane", s["lane"]), none), got)
    taken = F.aggregate("_steps", none, lambda got, s: F.concat(got, F.slice(rest(got, s), F.lit(1), F.greatest(F.lit(0), s["quota"]))))
    first = lists.select("profile_id", F.posexplode(taken).alias("pos", "job_id"))
    kept = keep or []
    rows = scored.select("profile_id", "job_id", *dict.fromkeys(["score", *kept])).join(first, ["profile_id", "job_id"], "left")
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.col("pos").asc_nulls_last(), F.desc("score"), F.col("job_id")))
    return rows.select("profile_id", "job_id", *kept, place.alias("place"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(vectors: DataFrame, by: str, least: int = 3) -> DataFrame:
    """(by, n, centroid): mean vector of each group of at least ``least`` vectors."""
    cells = vectors.select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    out = cells.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("centroid"))
    return out.where(F.col("n") >= least)


def decayed_weights(feedback: DataFrame, as_of: Column, half_life: float = 60.0) -> DataFrame:
    """Adds weight: 1.5 applied for, else from -1 for a rating of 1 to 1 for 5, halved every ``half_life`` days (at
    least 1) of age; what was applied for ages half as fast; ages are never below 0."""
    age = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", "created_at", as_of) / F.lit(86_400_000_000.0))
    age = F.when(F.col("applied"), age / 2).otherwise(age)
    rated = F.coalesce(*(F.when(F.col("rating") == k, F.lit(w)) for k, w in fixed.RATING_WEIGHTS.items()))
    base = F.when(F.col("applied"), F.lit(fixed.APPLIED_WEIGHT)).otherwise(rated)
    return feedback.withColumn("weight", base * F.pow(F.lit(0.5), age / max(half_life, 1)))


def rare_terms(terms: DataFrame, rows: int | Column, share: float = fixed.FREQUENT_SHARE) -> DataFrame:
    """The terms (term, jobs) that at most ``share`` of all ``rows`` of feedback hold, general ones left out."""
    return terms.where((F.col("jobs") / rows <= share) & ~F.col("term").isin(fixed.GENERIC_TERMS))


def analysis_terms(analyses: DataFrame, known: DataFrame) -> DataFrame:
    """(id, term, delta): what analyses of feedback add to terms. analyses: id, term, weight, confidence (high, medium,
    low; others count as low), sign (of the feedback). A suggestion counts if a variant stands in the text of its id
    in known (id, text) and its weight has the feedback's sign; the weight is multiplied by the confidence."""
    there = grounded(analyses.select("id", "term").distinct(), known)
    sure = F.coalesce(*(F.when(F.col("confidence") == k, F.lit(v)) for k, v in fixed.CONFIDENCE.items()), F.lit(fixed.CONFIDENCE["low"]))
    agreed = analyses.where(F.signum("weight") == F.signum("sign")).join(there, ["id", "term"], "left_semi")
    return agreed.groupBy("id", "term").agg(F.sum(F.col("weight") * sure).alias("delta"))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (lo, hi): Wilson interval of k out of n, 3 places; null for n = 0."""
    p = k / n
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.round(F.greatest(F.lit(0.0), (middle - spread) / scale), 3).alias("lo"), F.round(F.least(F.lit(1.0), (middle + spread) / scale), 3).alias("hi")))


#: Clusters in the order in which they claim terms, with the most terms of each that count.
CLUSTERS = [("direct_title", 5), ("application_history_title", 4), ("learned_title", 4), ("keywords", 8), ("application_history_keyword", 6), ("learned_keyword", 6), ("sector", 3), ("location", 3)]


def cluster_contributions(matches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(job_id, profile_id, cluster, contribution): a term counts once, in the first cluster that has room for
    it; a term left out for lack of room stays open to later ones. matches: job_id, profile_id, cluster, term.

    Which terms are taken depends on the order, so the clusters of a job are folded one after another."""
    none = F.array().cast("array<string>")
    lists = matches.groupBy("job_id", "profile_id", "cluster").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    lists = lists.groupBy("job_id", "profile_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "terms"))).alias("by"))
    steps = F.array(*(F.struct(F.lit(c).alias("cluster"), F.lit(n).alias("room"), F.lit(float(weights.get(c, 0.0))).alias("weight")) for c, n in CLUSTERS))
    start = F.struct(none.alias("claimed"), F.array().cast("array<struct<cluster:string,contribution:double>>").alias("out"))

    def step(got: Column, s: Column) -> Column:
        counted = F.slice(F.array_except(F.coalesce(F.try_element_at("by", s["cluster"]), none), got["claimed"]), F.lit(1), s["room"])
        made = F.struct(s["cluster"].alias("cluster"), F.round(F.size(counted) * s["weight"], 2).alias("contribution"))
        return F.struct(F.concat(got["claimed"], counted).alias("claimed"), F.array_append(got["out"], made).alias("out"))

    folded = F.aggregate(steps, start, step, lambda got: got["out"])
    return lists.select("job_id", "profile_id", F.explode(folded).alias("c")).select("job_id", "profile_id", "c.cluster", "c.contribution")


def grounded(suggestions: DataFrame, texts: DataFrame) -> DataFrame:
    """The suggestions (id, term) of which a variant stands in the text of the same id. texts: id, text."""
    wanted = suggestions.select("id", "term", F.explode(T.expanded_tokens(F.col("term"))).alias("variant"))
    there = texts.select("id", F.explode(T.expanded_tokens(F.col("text"))).alias("variant")).distinct()
    return wanted.join(there, ["id", "variant"], "left_semi").select("id", "term").distinct()
