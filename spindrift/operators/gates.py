"""Filters and rule gates over listings. Every "now" is the parameter as_of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..sources.tables import spread
from . import hits

DAY = 86_400_000_000.0


def age_days(at: Column, as_of: Column) -> Column:
    """Age in days, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", at, as_of) / F.lit(DAY)


def freshness(jobs: DataFrame, as_of: Column, max_age: int | None = 30, slack_hours: int = 6, drop_past: bool = True) -> DataFrame:
    """Adds eligible, reason, source, age_days (4 places), deadline_passed and review.

    An age counts from published_at, without it from first_seen_at. One of exactly ``max_age`` days is fresh (None:
    every age is), a deadline equal to as_of has not passed. A date more than ``slack_hours`` ahead and a missing
    date are kept for review, so is a malformed one (``published_malformed``, ``first_seen_malformed``,
    ``deadline_malformed``, false where the column is missing). A passed deadline counts unless ``drop_past`` is
    off; a malformed one then stays unknown."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in jobs.columns else F.lit(False)
    published = F.when(~flag("published_malformed"), F.col("published_at"))
    seen = F.when(~flag("first_seen_malformed"), F.col("first_seen_at")) if "first_seen_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    effective = F.coalesce(published, seen)
    age = age_days(effective, as_of)
    ahead = F.timestamp_diff("MICROSECOND", as_of, effective) > slack_hours * 3_600_000_000
    old = F.lit(False) if max_age is None else age > max_age
    bad_deadline = flag("deadline_malformed") if drop_past else F.lit(False)
    passed = F.when(bad_deadline, F.lit(None)).otherwise(F.col("expires_at") < as_of) if drop_past else F.lit(None).cast("boolean")
    dated = F.when(effective.isNull(), "no_publication_date").when(ahead, "future_publication_date").when(old, "too_old").otherwise("fresh")
    reason = F.when(F.coalesce(passed, F.lit(False)), "past_deadline").when(bad_deadline & (dated != "too_old"), "unknown_deadline").otherwise(dated)
    review = dated.isin("no_publication_date", "future_publication_date") | flag("published_malformed") | flag("first_seen_malformed") | flag("deadline_malformed")
    source = F.when(published.isNotNull(), "published_at").when(seen.isNotNull(), "first_seen").otherwise("unknown")
    return jobs.withColumns({"age_days": F.round(age, 4), "deadline_passed": passed, "source": source, "eligible": ~F.coalesce(passed, F.lit(False)) & (dated != "too_old"), "reason": reason, "review": review})


def prefix_until_known(rows: DataFrame, watermark: Column, by: str, *order: str) -> DataFrame:
    """Rows of each source in page order up to the first that is not newer than the watermark; rows without a
    date count as newer."""
    known = F.coalesce(F.col("published_at") <= watermark, F.lit(False)).cast("int")
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_known", F.max(known).over(upto)).where("_known = 0").drop("_known")


def located_in(jobs: DataFrame, towns: list[str]) -> DataFrame:
    """Jobs whose location holds one of the towns between separators."""
    return jobs.where(F.rlike("location", F.lit(rf"(?i)(^|[\s,/])({'|'.join(towns)})([\s,/]|$)")))


def remote_pool(jobs: DataFrame) -> DataFrame:
    """Jobs with a mark of remote work and no negation in location, title or description."""
    whole = T.folded(F.concat_ws(" ", "location", "title", "description"))
    marks = fixed.FULL_REMOTE + ["/ etä"]
    return jobs.where(T.has_any(whole, marks) & ~T.has_any(whole, fixed.REMOTE_NEGATED))


def discovery_terms(terms: DataFrame, keep: int = 80, least: int = 5) -> DataFrame:
    """The first ``keep`` distinct terms (pos, term) per profile, folded, without short and general ones."""
    out = terms.select("profile_id", "pos", F.trim(F.lower("term")).alias("term"))
    out = out.where((F.length("term") >= least) & ~F.col("term").isin(fixed.GENERIC_TERMS + fixed.DISCOVERY_EXCLUDED))
    first = out.groupBy("profile_id", "term").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("pos", "term"))
    return first.withColumn("place", place).where(F.col("place") <= keep)


def discovery_pool(jobs: DataFrame, terms: DataFrame) -> DataFrame:
    """(job_id, profile_id): jobs that hold a term of a profile (profile_id, term) as whole tokens in title or
    description."""
    phrases = terms.select("profile_id", T.normalized(F.col("term")).alias("phrase")).where("phrase <> ''").distinct()
    rows = jobs.select("job_id", T.normalized(F.concat_ws(" ", "title", "description")).alias("text"))
    return hits.phrases_in(rows, phrases).join(hits.small(phrases), "phrase").select("job_id", "profile_id").distinct()


def town_pool(jobs: DataFrame, towns: DataFrame) -> DataFrame:
    """(job_id, profile_id): jobs whose location holds a town of a profile (profile_id, town) between separators, in
    whatever case. Distinct locations meet the towns, not jobs."""
    cut = lambda c: F.array_join(F.split(F.trim(F.lower(c)), r"[\s,/]+"), " ")
    named = towns.select("profile_id", cut(F.col("town")).alias("phrase")).where("phrase <> ''").distinct()
    places = jobs.select("location").where("location is not null").distinct()
    found = hits.phrases_in(places.select(F.col("location").alias("job_id"), cut(F.col("location")).alias("text")), named)
    found = found.join(hits.small(named), "phrase").select(F.col("job_id").alias("location"), "profile_id").distinct()
    return jobs.select("job_id", "location").join(hits.small(found), "location").select("job_id", "profile_id")


def language_gate(jobs: DataFrame, languages: DataFrame, text: str = "description") -> DataFrame:
    """(job_id, code, verdict, pos): the first sentence that decides on a language: ``fail``, ``caution`` or
    ``pass``; jobs without a deciding sentence give no row.

    languages: code, rule: ``pass`` (never asked for), ``reject`` (fails where it is demanded) or ``above_b2`` (fails
    where native or excellent command is; B2 or less passes). A sentence decides if it names the language and a
    skill, is not negated or optional, and demands it, or asks for native or excellent command; not if it offers
    another language of rule ``pass`` or ``above_b2`` instead."""
    low, names = F.col("_low"), fixed.LANGUAGE_NAMES
    top = T.has_any(low, fixed.NATIVE_MARKERS + fixed.EXCELLENT_MARKERS)
    parts = spread(jobs.select("job_id", "title", text)).select("job_id", F.posexplode_outer(T.sentences(F.concat_ws(". ", F.coalesce("title", F.lit("")), text))).alias("pos", "sentence")).select("job_id", "pos", F.lower("sentence").alias("_low"))
    # Sentences that can't decide go before they meet the languages.
    parts = parts.where(T.has_any(low, [n for x in names.values() for n in x]) & T.has_any(low, fixed.LANGUAGE_CONTEXT) & ~T.has_any(low, fixed.NEGATION_MARKERS) & ~T.has_any(low, fixed.OPTIONAL_MARKERS) & (T.has_any(low, fixed.STRONG_MARKERS) | top))
    parts = parts.withColumn("_named", F.array_compact(F.array(*(F.when(T.has_any(low, n), F.lit(code)) for code, n in names.items()))))
    # One row for each language of a profile.
    able = languages.where("rule in ('pass', 'above_b2')").agg(F.collect_set("code").alias("_able"))
    hit = parts.join(F.broadcast(languages.where("rule <> 'pass'")), F.array_contains("_named", F.col("code"))).crossJoin(F.broadcast(able))
    instead = T.has_any(low, [" tai ", " or "]) & F.arrays_overlap(F.array_except("_named", F.array("code")), "_able")
    verdict = F.when((F.col("rule") == "reject") | top, "fail").when(T.has_any(low, fixed.AT_MOST_B2_MARKERS), "pass").otherwise("caution")
    return hit.where(~F.coalesce(instead, F.lit(False))).groupBy("job_id", "code").agg(F.min_by(verdict, "pos").alias("verdict"), F.min("pos").alias("pos"))


def missing_qualifications(text: Column, plain: Column | None = None) -> Column:
    """Sorted labels of qualifications that a folded text demands. plain: the text normalised, if it is there already."""
    plain = T.normalized(text) if plain is None else plain
    some = lambda marks: reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in marks))
    hits = [F.when(some(fixed.QUALIFICATION_MARKS[label]) & F.rlike(text, F.lit("|".join(p))), F.lit(label)) for label, p in fixed.QUALIFICATION_PATTERNS.items()]
    hits += [F.when(T.has_phrase(plain, F.lit(p)), F.lit(p)) for p in fixed.QUALIFICATION_PHRASES]
    return F.array_sort(F.array_compact(F.array(*hits)))


def softened(text: Column, phrase: Column) -> Column:
    """Whether the first sentence that holds a phrase is negated or optional; false if none holds it."""
    return _softened(_sentences(text), phrase)


def _sentences(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?\n]")


def _softened(parts: Column, phrase: Column) -> Column:
    first = F.get(F.filter(parts, lambda s: F.contains(s, F.lower(phrase))), F.lit(0))
    return F.coalesce(T.has_any(first, fixed.DEMAND_NEGATED + fixed.DEMAND_OPTIONAL), F.lit(False))


def qualification_gate(jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """(job_id, name, verdict): ``reject`` or ``caution`` of each named check that has something to say.

    checks: name, title_or_text, reject, adjacent, caution, required (arrays of phrases, never null) and
    never_by_title. A phrase of title_or_text in the title rejects; in the text it rejects unless softened, else
    cautions. Then phrases of ``reject`` in the text reject unless all are softened, which cautions; a title with an
    adjacent role makes a rejection a caution. Then, with never_by_title, a phrase of ``caution`` cautions, and
    without it one of ``required``. Phrases match as stems. The checks are a few rows, so the join is with a small
    side."""
    from ..functions.listing import stemmed, stemmed_runs

    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    whole, lists = F.concat_ws(". ", "title", "description"), ["title_or_text", "reject", "adjacent", "caution", "required"]
    # Of the texts only the words that begin as a phrase's do are stemmed; the phrases are a few.
    begins = checks.select(F.explode(F.concat(*lists)).alias("p")).select(F.explode(F.split(stemmed(F.col("p")), " ")).alias("s")).where("s <> ''").distinct()
    begins = sorted(r["s"] for r in begins.collect())
    rows = jobs.select("job_id", pad(stemmed_runs(F.coalesce("title", F.lit("")), begins)).alias("_t"), pad(stemmed_runs(whole, begins)).alias("_x"), _sentences(whole).alias("_said"))
    # Phrases are stemmed before they meet the jobs.
    stems = [F.transform(c, lambda p: F.struct(p.alias("p"), pad(stemmed(p)).alias("s"))).alias(c) for c in lists]
    rows = rows.crossJoin(F.broadcast(checks.select("name", "never_by_title", *stems)))
    within = lambda where, phrases: F.transform(F.filter(phrases, lambda x: F.contains(F.col(where), x["s"])), lambda x: x["p"])
    rows = rows.select("job_id", "name", "never_by_title", "_said", within("_t", "title_or_text").alias("titled"), within("_x", "title_or_text").alias("told"), within("_x", "reject").alias("named"), within("_t", "adjacent").alias("near"), within("_x", "caution").alias("careful"), within("_x", "required").alias("asked"))
    some = lambda c: F.size(c) > 0
    soft = lambda p: _softened(F.col("_said"), p)
    hard = F.filter("named", lambda p: ~soft(p))
    verdict = (
        F.when(some("titled"), "reject").when(some("told"), F.when(soft(F.get("told", F.lit(0))), "caution").otherwise("reject"))
        .when(some(hard), F.when(some("near"), "caution").otherwise("reject")).when(some("named"), "caution")
        .when(F.col("never_by_title"), F.when(some("careful"), "caution")).when(some("asked"), "caution"))
    # A row each: a filter on the verdict itself would be carried below the stems and make them anew for every use.
    return rows.select("job_id", "name", F.explode_outer(F.array(verdict)).alias("verdict")).where("verdict is not null")


def publishable(recs: DataFrame, deterministic_only: bool = False) -> DataFrame:
    """The recommendations that may be shown: not skipped, not reviewed below 40, of a tier that fits, structurally
    eligible, reviewed unless deterministic rows may be shown, not hidden by feedback. recs: action, review_score,
    tier, hard_eligible, awaiting_refresh, compatible, evaluation_id, hidden; nulls speak for a row, but for
    evaluation_id."""
    yes = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    wrong = (
        (yes("action", "") == "skip") | F.coalesce(F.col("review_score") < 40, F.lit(False)) | yes("tier", "").isin(fixed.UNFIT_TIERS) | ~yes("hard_eligible", True)
        | (yes("awaiting_refresh", False) & ~yes("compatible", True)) | yes("hidden", False))
    if not deterministic_only:
        wrong = wrong | F.col("evaluation_id").isNull()
    return recs.where(~wrong)


def learned_discovery(scored: DataFrame, jobs: DataFrame, phrases: DataFrame) -> DataFrame:
    """scored (job_id, profile_id, pool, lanes) with the lane ``learned_discovery`` for rows that came only through the
    discovery pool and hold one of the profile's learned phrases (profile_id, phrase) as whole tokens."""
    named = phrases.select("profile_id", T.normalized(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    rows = jobs.select("job_id", T.normalized(F.concat_ws(" ", "title", "employer", "description")).alias("text"))
    found = hits.phrases_in(rows, named).join(hits.small(named), "phrase").select("job_id", "profile_id", F.lit(True).alias("_found")).distinct()
    rows = scored.join(found, ["job_id", "profile_id"], "left")
    new = (F.col("pool") == "discovery") & F.col("_found") & ~F.array_contains("lanes", "learned_discovery")
    return rows.withColumn("lanes", F.when(new, F.array_append("lanes", F.lit("learned_discovery"))).otherwise(F.col("lanes"))).drop("_found")


def passes_feedback(recs: DataFrame, level: float = 0.75) -> DataFrame:
    """The rows that are worth a review: not those as like what was disliked as ``level`` that also meet a learned
    exclusion. recs: anti, exclusion_matches (array), both null where unknown."""
    return recs.where(~F.coalesce((F.col("anti") >= level) & (F.size("exclusion_matches") > 0), F.lit(False)))


def removal_permitted(runs: DataFrame) -> Column:
    """Whether a run may mark listings as removed: complete, without watermark, not stopped at one, not empty, not
    cut by a number of URLs or pages. Columns: complete, watermark, fetched, stopped, max_urls, max_pages."""
    cut = F.coalesce(F.col("fetched") >= F.col("max_urls"), F.lit(False)) | F.col("max_pages").isNotNull()
    return F.col("complete") & F.col("watermark").isNull() & ~F.col("stopped") & (F.col("fetched") > 0) & ~cut


def negative_matches(pairs: DataFrame, jobs: DataFrame, wanted: DataFrame, tokens: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The pairs (job_id, profile_id, ...) whose job meets what a profile rules out, with ``matches``, sorted. wanted:
    profile_id, kind, value: of kind ``title`` phrases that stand in the title as whole tokens, of kind ``keyword``
    texts of which any token of four characters and more is part of the whole text. tokens: job_tokens(jobs), if there
    are some already; known: distinct_tokens of them."""
    phrases = wanted.where("kind = 'title'").select("profile_id", T.normalized(F.col("value")).alias("phrase")).where("phrase <> ''").distinct()
    words = wanted.where("kind = 'keyword'").select("profile_id", F.explode(T.tokens(F.col("value"))).alias("word")).where(F.length("word") >= hits.LEAST).distinct()
    titled = hits.phrases_in(jobs.select("job_id", T.normalized(F.col("title")).alias("text")), phrases)
    tokens = hits.job_tokens(jobs).where("raw") if tokens is None else tokens.where("raw")
    said = tokens.join(hits.small(hits.words_within(tokens, words, None if known is None else known.where("raw"))), "token").select("job_id", "word").distinct()
    found = titled.join(hits.small(phrases), "phrase").select("job_id", "profile_id", F.col("phrase").alias("m")).union(said.join(hits.small(words), "word").select("job_id", "profile_id", "word"))
    lists = found.groupBy("job_id", "profile_id").agg(F.array_sort(F.collect_set("m")).alias("matches"))
    return pairs.join(lists, ["job_id", "profile_id"]).select(*pairs.columns, "matches")


def region_subset(rows: DataFrame, codes: list[str], paths: list[str]) -> DataFrame:
    """Rows of a region: any of their municipality codes (array, null for none) or their regional path is wanted."""
    near = F.coalesce(F.arrays_overlap("codes", F.array(*map(F.lit, codes))), F.lit(False))
    return rows.where(near | F.coalesce(F.col("path").isin(paths), F.lit(False)))
