"""A batch of enrichment: short listings into a queue, due ones tried once, results applied, everything logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import count_written, drop_written, written
from ..sources.versions import Versions
from . import state, upkeep

KEY = ["job_id", "enricher", "hash"]
TEXTS = "job_id long, description string, confidence int, hash string, batch int"
QUEUE = "job_id long, enricher string, hash string, status string, attempts int, next_at timestamp_ntz, batch int"
ATTEMPTS = "job_id long, enricher string, hash string, batch int, attempt int, status string, error string"
RUNS = "batch int, status string, queued long, processed long, applied long, failed long, cancelled long"


def enrich(versions: Versions, number: int, jobs: DataFrame, results: DataFrame, now: Column, threshold: int, limit: int, most: int = 3, wait_minutes: int = 30) -> None:
    """Writes version ``number`` of the tables texts, queue, attempts and runs.

    jobs: job_id, active, enricher, hash (of what an enrichment depends on), description (of the source). results: job_id,
    enricher, hash, and text with confidence, or error; a claimed row without one was skipped. Active listings whose text,
    the enriched one if there is one, is shorter than ``threshold`` are queued once for an input; queued rows of listings
    that are gone are cancelled; the first ``limit`` that are due are tried, at most ``most`` times each and again after
    ``wait_minutes``. A result counts if the listing's input is still the same (state.enrichment_outcomes). The log of
    attempts only grows. All tables are made of the version before, so a batch that is run again gives the same."""
    spark, since = jobs.sparkSession, count_written()
    read = lambda name, schema: versions.read(name, schema, before=number)
    texts, queue = read("texts", TEXTS), read("queue", QUEUE)
    had = texts.select("job_id", F.col("description").alias("_text"), F.col("confidence").alias("_sure"))
    now_jobs = written(jobs.join(had, "job_id", "left").withColumn("description", F.coalesce("_text", "description")))
    open_ = F.col("status").isin("queued", "retry")
    wanted = upkeep.enrichment_candidates(now_jobs.where("active"), queue.where(~open_).select(*KEY), queue.where(open_).select(*KEY), threshold)
    new = wanted.select(*KEY, F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("next_at"), F.lit(number).alias("batch"))
    live = now_jobs.where("active").select("job_id", F.lit(True).alias("_live"))
    rows = queue.where(open_).unionByName(new).join(live, "job_id", "left")
    rows = written(rows.withColumn("status", F.when(F.col("_live").isNull(), "cancelled").otherwise(F.col("status"))).drop("_live"))
    claimed = rows.where(open_ & (F.col("next_at") <= now)).orderBy("next_at", *KEY).limit(limit)
    told = written(claimed.withColumn("attempts", F.col("attempts") + 1).join(results.withColumn("_told", F.lit(True)), KEY, "left"))
    current = now_jobs.select("job_id", F.col("hash"), F.length(F.coalesce("description", F.lit(""))).alias("length"), F.col("_text").isNotNull().alias("enriched"), F.col("_sure").alias("old_confidence"))
    given = told.where("text is not null and error is null").select("job_id", "enricher", F.col("hash").alias("result_hash"), "confidence")
    # A job may be claimed for its old and its new input at once, so an outcome belongs to a row, not to a job.
    outcome = state.enrichment_outcomes(current.join(given.select("job_id"), "job_id", "left_semi"), given, threshold, "enricher", "result_hash")
    tried = told.join(outcome.withColumnRenamed("result_hash", "hash"), KEY, "left")
    ended = F.when(F.col("error").isNotNull(), "failed").when(F.col("text").isNull(), "skipped").otherwise("completed")
    tried = written(tried.withColumn("ended", ended))
    failed = F.col("ended") == "failed"
    again = failed & (F.col("attempts") < most)
    after = tried.select(
        *KEY, F.when(again, "retry").when(failed, "failed").otherwise("completed").alias("status"), "attempts",
        F.when(again, now + F.expr(f"make_dt_interval(0, 0, {wait_minutes})")).otherwise(F.col("next_at")).alias("next_at"), F.lit(number).alias("batch"))
    others = rows.join(tried.select(*KEY), KEY, "left_anti").withColumn("batch", F.lit(number))
    applied = tried.where("ended = 'completed' and outcome = 'applied'")
    log = tried.select(*KEY, F.lit(number).alias("batch"), F.col("attempts").alias("attempt"), F.col("ended").alias("status"), "error")
    counts = tried.agg(F.count_if(~failed).alias("processed"), F.count_if((F.col("ended") == "completed") & (F.col("outcome") == "applied")).alias("applied"), F.count_if(failed).alias("failed"))
    made = new.agg(F.count("*").alias("queued")).crossJoin(counts).crossJoin(rows.agg(F.count_if(F.col("status") == "cancelled").alias("cancelled")))
    run = made.select(F.lit(number).alias("batch"), F.when(F.col("failed") > 0, "failed").otherwise("completed").alias("status"), "queued", "processed", "applied", "failed", "cancelled")
    versions.commit(number, {
        "texts": (written(applied.select("job_id", F.col("text").alias("description"), "confidence", "hash", F.lit(number).alias("batch"))), ["job_id"], "batch"),
        "queue": (written(after.unionByName(others.select(*after.columns))), KEY, "batch"),
        "attempts": (written(log), [*KEY, "batch"], "attempt"), "runs": (written(run), ["batch"], "queued")})
    drop_written(spark, since)
