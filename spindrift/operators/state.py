"""Upserts, state changes and incremental maintenance as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last in the given order. An aggregate, so that hot keys are combined before the
    shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def dedupe_key(rows: DataFrame, normalized: object) -> Column:
    """Key under which one listing of two sources meets: title, employer, location and day; null if any of
    employer and day is missing."""
    day = F.date_format("published_at", "yyyy-MM-dd")
    parts = [normalized(F.col(c)) for c in ("title", "employer", "location")]
    return F.when(F.col("employer").isNotNull() & F.col("published_at").isNotNull(), F.concat_ws("|", *parts, day))


def canonical(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Merged row per key whatever the order of arrival: of each field the longest trimmed value, of equally
    long ones the least."""
    best = lambda c: F.min_by(F.trim(c), F.struct(-F.coalesce(F.length(F.trim(c)), F.lit(-1)), F.trim(c)))
    return rows.groupBy(key).agg(*(best(F.col(c)).alias(c) for c in fields))


def upsert_outcomes(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming (source_id, external_id, hash, dedupe_key) against state (same, job_id): adds outcome and job_id.

    A known occurrence is unchanged or updated by its hash; a new one is deduplicated if another source's
    listing has its key, and joins the least job id of it; else it is inserted without a job id yet."""
    own = state.select("source_id", "external_id", F.col("hash").alias("_hash"), F.col("job_id").alias("_job"))
    by_key = state.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.min(F.struct("job_id", "source_id")).alias("_first"), F.min("source_id").alias("_lo"), F.max("source_id").alias("_hi"))
    rows = incoming.join(own, ["source_id", "external_id"], "left").join(by_key, "dedupe_key", "left")
    other = F.col("_first").isNotNull() & ((F.col("_lo") != F.col("source_id")) | (F.col("_hi") != F.col("source_id")))
    outcome = F.when(F.col("_job").isNotNull(), F.when(F.col("_hash").eqNullSafe(F.col("hash")), "unchanged").otherwise("updated")).when(other, "deduplicated").otherwise("inserted")
    return rows.select(*incoming.columns, outcome.alias("outcome"), F.coalesce("_job", F.when(other, F.col("_first.job_id"))).alias("job_id"))


def miss_runs(outcomes: DataFrame, close_after: int = 3) -> DataFrame:
    """Adds misses and state to outcomes (source_id, ts, event_id, outcome): how many misses in a row end at
    each row. ``classified`` starts anew, ``invalid`` changes nothing, ``close_after`` misses close."""
    along = Window.partitionBy("source_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = outcomes.withColumn("_island", F.sum((F.col("outcome") == "classified").cast("int")).over(along))
    inside = Window.partitionBy("source_id", "_island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("misses", F.sum((F.col("outcome") == "missing").cast("int")).over(inside)).drop("_island")
    return rows.withColumn("state", F.when(F.col("misses") >= close_after, "closed").when(F.col("outcome") == "classified", "classified").otherwise("pending"))


def frontier_changes(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(external_id, lastmod, state): a scan's entries (external_id, lastmod) against members (external_id,
    lastmod, state). New, closed, absent or changed members are pending, unlisted ones absent, others stay."""
    e = entries.select("external_id", F.col("lastmod").alias("_new"), F.lit(True).alias("_listed"))
    rows = members.join(e, "external_id", "full")
    state = (
        F.when(F.col("_listed").isNull(), "absent").when(F.col("state").isNull() | F.col("state").isin("closed", "absent") | ~F.col("lastmod").eqNullSafe(F.col("_new")), "pending").otherwise(F.col("state")))
    return rows.select("external_id", F.coalesce("_new", "lastmod").alias("lastmod"), state.alias("state"))


def ranks_within(rows: DataFrame, by: str, flags: dict[str, Column], *order: Column) -> DataFrame:
    """Adds a rank for each flag: the place among the rows of ``by`` that have it, null for the others."""
    for name, flag in flags.items():
        place = F.row_number().over(Window.partitionBy(by, flag).orderBy(*order))
        rows = rows.withColumn(name, F.when(flag, place))
    return rows


def enrichment_outcomes(now: DataFrame, results: DataFrame, short: int, *kept: str) -> DataFrame:
    """(job_id, outcome) of enrichment results: a result counts if it was made for the present input; it
    replaces text shorter than ``short`` and enriched text of no higher confidence. kept: columns of results that tell
    several of one job apart, put out as well."""
    rows = now.join(results, "job_id", "left")
    outcome = (
        F.when(F.col("result_hash").isNull(), "none").when(F.col("result_hash") != F.col("hash"), "stale").when(F.col("enriched") & (F.col("confidence") < F.col("old_confidence")), "kept")
        .when(~F.col("enriched") & (F.col("length") >= short), "kept").otherwise("applied"))
    return rows.select("job_id", *kept, outcome.alias("outcome"))


def queue_transitions(queue: DataFrame, stale_before: Column, most: int = 3) -> DataFrame:
    """Next status of queue rows (id, status, attempts, ts, inactive): inactive ones are cancelled, running
    ones that are too old wait again, those tried ``most`` times fail."""
    status = F.when(F.col("inactive"), "cancelled").when((F.col("status") == "running") & (F.col("ts") < stale_before), "pending")
    return queue.withColumn("status", status.when((F.col("status") == "retry") & (F.col("attempts") >= most), "failed").otherwise(F.col("status")))


def within_budget(rows: DataFrame, by: str, budget: int, *order: Column) -> DataFrame:
    """Adds status to rows with a flag ``hit``: ``hit``, ``evaluate`` for the first ``budget`` others in the
    given order, ``deferred`` for the rest."""
    along = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = F.sum((~F.col("hit")).cast("int")).over(along)
    return rows.withColumn("status", F.when(F.col("hit"), "hit").when(needed <= budget, "evaluate").otherwise("deferred"))


def learned_verdicts(net: DataFrame, enter: float = -2.0, leave: float = -1.0, boost: float = 1.5, jobs: int = 2) -> DataFrame:
    """Adds verdict to (net, jobs, was_excluded): terms are excluded from ``enter`` on and stay so until they
    rise above ``leave``; boosts and new exclusions need ``jobs`` jobs."""
    enough = F.col("jobs") >= jobs
    verdict = (
        F.when((F.col("net") <= enter) & enough, "exclude").when(F.col("net") > leave, F.when((F.col("net") >= boost) & enough, "boost").otherwise("none"))
        .otherwise(F.when(F.col("was_excluded"), "exclude").otherwise("none")))
    return net.withColumn("verdict", verdict)
