"""State that is kept up: lookups, evidence, caches, runs, attempts, reviews, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_plan(wanted: DataFrame, cache: DataFrame, failures: DataFrame, budget: int, no_route_days: float = 30.0, backoff_days: float = 1.0) -> DataFrame:
    """Adds status to wanted (destination, pos): ``hit`` if the cache has it; ``miss`` if no route was found in the last
    ``no_route_days``; ``backoff`` if it failed otherwise in the last ``backoff_days``; ``fetch`` for the first
    ``budget`` others by pos; ``deferred`` for the rest. failures: destination, reason, age_days; one row each."""
    known, failed = cache.select("destination", F.lit(True).alias("_known")).distinct(), failures.select("destination", "reason", "age_days")
    rows = wanted.join(known, "destination", "left").join(failed, "destination", "left")
    recent = F.when((F.col("reason") == "no_route") & (F.col("age_days") <= no_route_days), "miss").when((F.col("reason") != "no_route") & (F.col("age_days") <= backoff_days), "backoff")
    rows = rows.select(*wanted.columns, F.when(F.col("_known"), "hit").otherwise(recent).alias("_said"))
    # At most ``budget`` rows, kept by a limit instead of a window over all.
    fetched = rows.where("_said is null").orderBy("pos", "destination").limit(budget).select("destination", F.lit("fetch").alias("_fetch"))
    return rows.join(F.broadcast(fetched), "destination", "left").select(*wanted.columns, F.coalesce("_said", "_fetch", F.lit("deferred")).alias("status"))


def evidence(stored: DataFrame, built: DataFrame) -> DataFrame:
    """(job_id, evidence): the stored text (job_id, text, tone) if it is not blank and has one of three tones, else what
    was built (job_id, built), else null."""
    valid = (F.trim(F.coalesce("text", F.lit(""))) != "") & F.coalesce(F.col("tone").isin("good", "warning", "bad"), F.lit(False))
    return stored.join(built, "job_id", "left").select("job_id", F.when(valid, F.col("text")).otherwise(F.col("built")).alias("evidence"))


def route_cache(found: DataFrame, failed: DataFrame, key: str = "destination", order: str = "at") -> tuple[DataFrame, DataFrame]:
    """The cache, the latest result of each key, and the failures, the latest of each key without a result."""
    from .state import latest

    cache = latest(found, [key], order)
    left = failed.groupBy(key).agg(F.max(order).alias(order)).join(cache.select(key), key, "left_anti")
    return cache, left


def finished_runs(runs: DataFrame, ends: DataFrame, free: DataFrame) -> DataFrame:
    """runs (run_id, source_id, status, owner) after ends (run_id, owner, final): a running run takes the final status
    of its owner, once; others change nothing. Runs still running of a source in ``free``, whose lock nobody
    holds, are abandoned and fail."""
    rows = runs.join(ends.select("run_id", F.col("owner").alias("_by"), "final"), "run_id", "left").join(free.select("source_id", F.lit(True).alias("_free")).distinct(), "source_id", "left")
    running = F.col("status") == "running"
    finished = running & F.coalesce(F.col("_by") == F.col("owner"), F.lit(False))
    status = F.when(finished, F.col("final")).when(running & F.col("_free"), "failed").otherwise(F.col("status"))
    return rows.select("run_id", "source_id", status.alias("status"), "owner", finished.alias("finished"))


def analysis_attempts(rows: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Adds status and next_at to rows (attempts, outcome) and counts the attempt: ``completed``; ``terminal`` fails at
    once; ``retryable`` waits 2 ** attempts hours, and fails with the ``most``-th attempt; ``stale``, made for a text
    edited since, leaves the row pending and is not counted."""
    n = F.col("attempts") + F.when(F.col("outcome") == "stale", 0).otherwise(1)
    again = (F.col("outcome") == "retryable") & (F.col("attempts") + 1 < most)
    status = F.when(F.col("outcome") == "completed", "completed").when(F.col("outcome") == "stale", "pending").when(again, "retry").otherwise("failed")
    wait = F.make_dt_interval(F.lit(0), F.pow(F.lit(2), F.col("attempts") + 1).cast("int"))
    return rows.withColumns({"status": status, "next_at": F.when(again, now + wait), "attempts": n})


def run_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """A row for each run of enrichment outcomes: candidates, attempts, and what became of them."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(F.col("outcome") != "none").alias("attempts"), is_("applied").alias("enriched"), is_("stale").alias("stale"), is_("kept").alias("kept"))


def bucket_limits(most: int) -> dict[str, int]:
    """Of ``most`` reviews 40 % near (one at least), 20 % remote, the rest anywhere; halves go to the even number."""
    if most <= 0:
        return {"near": 0, "remote": 0, "anywhere": 0}
    near = min(most, max(1, round(most * 0.4)))
    remote = min(most - near, round(most * 0.2))
    return {"near": near, "remote": remote, "anywhere": most - near - remote}


def review_buckets(recs: DataFrame, most: int) -> DataFrame:
    """recs of the reviews of each profile with bucket (0 near, 1 remote, 2 anywhere) and place in it. recs: rec_id,
    profile_id, commutable, remote, priority, nationwide (rank), machine_score.

    Each bucket is ranked per profile with its limit as a constant, so that ranks beyond it are cut before the sort;
    the last takes from all that the first two have not taken, by an anti join on ids that are never null."""
    limits = bucket_limits(most)

    def first(rows: DataFrame, bucket: int, limit: int) -> DataFrame:
        order = Window.partitionBy("profile_id").orderBy("priority", F.col("nationwide").asc_nulls_last(), F.desc("machine_score"), F.desc("rec_id"))
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("bucket", F.lit(bucket))

    near = first(recs.where("commutable"), 0, limits["near"])
    remote = first(recs.where("not commutable and remote"), 1, limits["remote"])
    taken = near.select("rec_id").union(remote.select("rec_id")).distinct()
    rest = first(recs.join(taken, "rec_id", "left_anti"), 2, limits["anywhere"])
    return near.unionByName(remote).unionByName(rest.select(*near.columns))


def repaired_links(rows: DataFrame, families: DataFrame) -> DataFrame:
    """Adds ``repaired`` to rows (source, external_id, url): the URL made from the external id where the source's URL is
    broken, that is, like ``like_`` and not like ``unlike``; null elsewhere. families: source, like_, unlike, prefix;
    one row for each source with a rule."""
    out = rows.join(F.broadcast(families), "source", "left")
    broken = F.expr("url like like_ and not (url like unlike)")
    return out.select(*rows.columns, F.when(broken, F.concat("prefix", "external_id")).alias("repaired"))


def page_prefix(pages: DataFrame, full: int, max_pages: int | None = None, max_results: int | None = None) -> DataFrame:
    """The pages (source_id, page from 1 on, n, last) that a capped fetch reads: up to the first empty page, not with it;
    up to the first with fewer than ``full`` rows or the flag ``last``, and with it; at most ``max_pages``; and no
    further page once ``max_results`` rows are there."""
    per = Window.partitionBy("source_id")
    before = per.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumns({
        "_empty": F.min(F.when(F.col("n") == 0, F.col("page"))).over(per), "_end": F.min(F.when((F.col("n") < full) | F.col("last"), F.col("page"))).over(per), "_had": F.coalesce(F.sum("n").over(before), F.lit(0))})
    keep = (F.col("_empty").isNull() | (F.col("page") < F.col("_empty"))) & (F.col("_end").isNull() | (F.col("page") <= F.col("_end")))
    if max_pages is not None:
        keep = keep & (F.col("page") <= max_pages)
    if max_results is not None:
        keep = keep & (F.col("_had") < max_results)
    return rows.where(keep).select(*pages.columns)


def fetch_outcomes(pages: DataFrame) -> DataFrame:
    """(source_id, outcome, warnings) of fetches from their pages (source_id, status, warning, watermark): ``partial`` with
    any page that failed (status 400 and above), else ``delta`` from a watermark on, else ``full_snapshot``; warnings
    sorted, each once. Only the last may remove listings."""
    outcome = F.when(F.bool_or(F.col("status") >= 400), "partial").when(F.bool_or(F.col("watermark").isNotNull()), "delta").otherwise("full_snapshot")
    return pages.groupBy("source_id").agg(outcome.alias("outcome"), F.array_sort(F.collect_set("warning")).alias("warnings"))


def search_union(base: DataFrame, searches: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of base pages and of searches, one per key: a later search replaces an earlier one and any page."""
    from .state import latest

    both = base.withColumn("_search", F.lit(0)).unionByName(searches.withColumn("_search", F.lit(1)))
    return latest(both, [key], "_search", order).drop("_search")


def candidate_pool(pools: list[DataFrame], caps: list[int | None], *order: Column) -> DataFrame:
    """(job_id, pool) of pools of jobs in order, each cut to its cap in the given order of its rows; a job counts in the
    first pool that has it. Caps are parameters of the match, as in a top-k report; None takes a pool whole."""
    parts = [(p if cap is None else p.orderBy(*order).limit(cap)).select("job_id", F.lit(k).alias("pool")) for k, (p, cap) in enumerate(zip(pools, caps, strict=True))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("job_id").agg(F.min("pool").alias("pool"))


def recommendation_upsert(new: DataFrame, old: DataFrame, feedback: DataFrame, activate: bool = True) -> DataFrame:
    """The table of recommendations after a match, with ``outcome``: inserted, updated or left.

    new: profile_id, job_id, score, rank, rationale; old: the same with active, evaluation_id. Ranks of rows that
    feedback (job_id, profile_id, rating, action) hides, by a rating of 1 or as not relevant, are null, and such rows
    are inactive; a rationale that came from a review stays; rows of old alone stay as they are."""
    hidden = feedback.where("rating <= 1 or action = 'not_relevant'").select("profile_id", "job_id", F.lit(True).alias("_hidden")).distinct()
    a = new.select("profile_id", "job_id", F.struct("score", "rank", "rationale").alias("n"))
    b = old.select("profile_id", "job_id", F.struct("score", "rank", "rationale", "active", "evaluation_id").alias("o"))
    rows = a.join(b, ["profile_id", "job_id"], "full").join(hidden, ["profile_id", "job_id"], "left")
    fresh, known, masked = F.col("n").isNotNull(), F.col("o").isNotNull(), F.coalesce("_hidden", F.lit(False))
    rank = F.when(~fresh, F.col("o.rank")).when(known & masked, F.lit(None)).otherwise(F.col("n.rank"))
    active = F.when(~fresh, F.col("o.active")).when(~known, F.lit(activate)).when(F.lit(activate), ~masked).otherwise(F.col("o.active"))
    rationale = F.when(~fresh | F.col("o.evaluation_id").isNotNull(), F.col("o.rationale")).otherwise(F.col("n.rationale"))
    outcome = F.when(~fresh, "left").when(known, "updated").otherwise("inserted")
    return rows.select("profile_id", "job_id", F.when(fresh, F.col("n.score")).otherwise(F.col("o.score")).alias("score"), rank.alias("rank"), rationale.alias("rationale"), active.alias("active"), outcome.alias("outcome"))


def feedback_upsert(given: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored feedback (key, rating, applied, comment, status, snapshot) after submissions (key, at, rating, applied,
    comment, snapshot), of which the last of a key counts, with ``outcome``: new, kept or reset.

    The same input, nulls equal to nulls, keeps row and snapshot, but an analysis that failed or was skipped waits again;
    other input takes the new snapshot and waits for a new analysis."""
    from .state import latest

    own = stored.select("key", F.struct("rating", "applied", "comment", "status", "snapshot").alias("o"))
    rows = latest(given, ["key"], "at").join(own, "key", "full")
    left, same = F.col("at").isNull(), F.col("o").isNotNull()
    for c in ("rating", "applied", "comment"):
        same = same & F.col(c).eqNullSafe(F.col(f"o.{c}"))
    pick = lambda c, cond: F.when(cond, F.col(f"o.{c}")).otherwise(F.col(c))
    status = F.when(left, F.col("o.status")).when(same, F.when(F.col("o.status").isin("failed", "skipped"), "pending").otherwise(F.col("o.status"))).otherwise("pending")
    outcome = F.when(left, "left").when(F.col("o").isNull(), "new").when(same, "kept").otherwise("reset")
    return rows.select("key", *(pick(c, left).alias(c) for c in ("rating", "applied", "comment")), pick("snapshot", left | same).alias("snapshot"), status.alias("status"), outcome.alias("outcome"))


def centroid_table(old: DataFrame, new: DataFrame, key: str, least: int = 3) -> DataFrame:
    """The table of centroids after new ones (key, n, centroid) of a run over all vectors: those of ``least`` vectors and
    more replace what is there, all other keys go; with ``change``: inserted, updated or deleted."""
    rows = old.select(key, F.lit(True).alias("_old")).join(new.where(F.col("n") >= least), key, "full")
    change = F.when(F.col("n").isNull(), "deleted").when(F.col("_old"), "updated").otherwise("inserted")
    return rows.select(key, "n", "centroid", change.alias("change"))


def relinked(occurrences: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (occurrence, job_id) after moves (occurrence, to), and jobs (job_id) that are superseded: those that an
    occurrence was moved away from and that have none left."""
    rows = occurrences.join(moves, "occurrence", "left").withColumn("_moved", F.col("to").isNotNull() & (F.col("to") != F.col("job_id")))
    after = rows.select("occurrence", F.coalesce("to", "job_id").alias("job_id"))
    gone = rows.where("_moved").select("job_id").distinct().join(after.select("job_id").distinct(), "job_id", "left_anti")
    return after, gone


def enrichment_candidates(jobs: DataFrame, done: DataFrame, queued: DataFrame, threshold: int) -> DataFrame:
    """jobs (job_id, enricher, description, hash) with a short description, blank or below ``threshold`` characters, that
    were neither enriched nor queued with the same input. done, queued: job_id, enricher, hash."""
    short = jobs.where(F.length(F.trim(F.coalesce("description", F.lit("")))) < threshold)
    return short.join(done, ["job_id", "enricher", "hash"], "left_anti").join(queued, ["job_id", "enricher", "hash"], "left_anti")


def feedback_benchmark(rows: DataFrame, *by: str) -> DataFrame:
    """Measures of feedback (rating, applied, rank, lanes, anti, exclusion_matches): labels, recall of the liked among the
    first 30, share of the disliked among the rated of these, shares of the liked that came by exploration and by
    learned discovery, rows that the feedback filter would skip. Shares of nothing are null."""
    liked = (F.col("rating") >= 4) | F.col("applied")
    disliked = ~liked & (F.col("rating") <= 2)
    first = F.coalesce(F.col("rank") <= 30, F.lit(False))
    lane = lambda *names: F.coalesce(F.arrays_overlap("lanes", F.array(*map(F.lit, names))), F.lit(False))
    skipped = F.coalesce((F.col("anti") >= 0.75) & (F.size("exclusion_matches") > 0), F.lit(False))
    share = lambda part, whole: F.round(F.try_divide(F.count_if(part), F.count_if(whole)), 3)
    return rows.groupBy(*by).agg(
        F.count_if(liked).alias("positive"), F.count_if(disliked).alias("negative"), F.count_if(first).alias("rated_30"), share(liked & first, liked).alias("recall_30"), share(disliked & first, first).alias("negative_30"),
        share(liked & lane("exploration"), liked).alias("exploration"), share(liked & lane("learned_discovery", "feedback_discovery"), liked).alias("learned_discovery"), F.count_if(skipped).alias("skips"))


def profile_state(imported: DataFrame, stored: DataFrame, reset: bool = False) -> DataFrame:
    """Profiles (profile_id, learned, boosts as maps) after an import: what was learned survives, key by key, unless the
    import has the key; boosts survive unless the import has any; nothing does with ``reset``."""
    rows = imported.join(stored.select("profile_id", F.col("learned").alias("_l"), F.col("boosts").alias("_b")), "profile_id", "left")
    if reset:
        return rows.select("profile_id", "learned", "boosts")
    kept = F.map_filter("_l", lambda k, v: ~F.array_contains(F.map_keys("learned"), k))
    learned = F.when(F.col("_l").isNull(), F.col("learned")).when(F.col("learned").isNull(), F.col("_l")).otherwise(F.map_concat("learned", kept))
    return rows.select("profile_id", learned.alias("learned"), F.coalesce("boosts", "_b").alias("boosts"))


def due(rows: DataFrame, now: Column, most: int) -> DataFrame:
    """Rows (status, next_at, attempts) to be tried: waiting for a retry, tried fewer than ``most`` times, without a next
    time or with one that has come."""
    return rows.where((F.col("status") == "retry") & (F.col("attempts") < most) & (F.col("next_at").isNull() | (F.col("next_at") <= now)))


def split_provenance(states: DataFrame, occurrences: DataFrame, enrichments: DataFrame) -> DataFrame:
    """The migration of packed provenances to references: (job_id, kind, occurrence, enrichment).

    states: job_id, provenance as ``source:<source_id>`` or ``enriched:<enricher>:<hash>``. The first refers to the
    occurrence (occurrence, job_id, source_id, seen) of the job in that source that was seen last, the second to the
    enrichment (enrichment, job_id, enricher, hash, created) that was made last; rows without a date come first, and of
    equal ones the larger id counts. What refers to nothing, or says something else, goes."""
    last = lambda rows, of, at, *by: rows.groupBy("job_id", *by).agg(F.max_by(of, F.struct(F.col(at).isNotNull(), at, of)).alias(of))
    part = lambda k: F.split_part("provenance", F.lit(":"), F.lit(k))
    rows = states.select("job_id", part(1).alias("kind"), F.expr("try_cast(split_part(provenance, ':', 2) as long)").alias("source_id"), part(2).alias("enricher"), part(3).alias("hash"))
    seen = last(occurrences.withColumn("source_id", F.col("source_id").cast("long")), "occurrence", "seen", "source_id")
    sources = rows.where("kind = 'source'").join(seen, ["job_id", "source_id"])
    made = rows.where("kind = 'enriched'").join(last(enrichments, "enrichment", "created", "enricher", "hash"), ["job_id", "enricher", "hash"])
    none = lambda c: F.lit(None).cast("long").alias(c)
    return sources.select("job_id", "kind", F.col("occurrence").cast("long").alias("occurrence"), none("enrichment")).unionByName(made.select("job_id", "kind", none("occurrence"), F.col("enrichment").cast("long").alias("enrichment")))
