"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document of a source gets a virtual finish time: the words of its source up to and
including it, divided by the source's target. All documents, with as many repeats as a source may have,
stand in the order of these times, and the mix ends where the budget is used up.

No step sorts or windows a whole source: running sums are taken inside hash buckets of a source, whose
number follows the corpus, and the buckets' own sums are added in front. The one running sum over all
sources is taken only inside the narrow band of finish times in which the budget ends.

Only DataFrame functions are used; the text is read once, for its length, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 2000
BANDS = 4096
RANKS = 1 << 60


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Words that each source should give: (source, source_size, n_docs, target).

    Sources in the order of their code points, null last, weigh ``cycle`` in turn and share the sum of all
    sizes. A target ends at ``max_repeats`` times the source's size; what is over is shared by weight among
    the rest. The level at which this settles is found in one ordered pass over the sources: those that
    fill up soonest come first, and the first that stays open fixes the level.
    sizes: (source, size). One row per source; an empty input gives no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # From here on one row per source, never documents.
    every = Window.partitionBy(F.lit(0))
    named = every.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(cycle) + 1
    per = per.withColumns({"weight": F.element_at(F.array(*map(F.lit, cycle)), place.cast("int")).cast("long"), "cap": F.col("source_size") * max_repeats})
    filling = every.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({
        "place": F.row_number().over(filling),
        "left": F.sum("source_size").over(every) - full,
        "heavy": F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    stays_open = F.col("cap") * F.col("heavy") >= F.col("left") * F.col("weight")
    per = per.withColumn("first", F.min(F.when(stays_open, F.struct("place", "left", "heavy"))).over(every))
    share = F.col("first.left").cast("double") * F.col("weight") / F.col("first.heavy")
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(share)
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", max_repeats: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source_size, target, taken, copies, source).

    docs: doc_id, text, source; other columns are ignored. One row comes back for every row that goes in,
    repeated and null ids included. Null text has size 0; null is a source of its own. A source is shuffled
    by the md5 of seed, doc_id and size, so that reruns agree; rows equal in these stand or fall together,
    so that no tie is left open. ``copies`` is the number of times a document is taken, ``taken`` the words.
    Documents without words are taken with their neighbours in the order, at no cost; if nothing has
    words, nothing is taken. An empty table gives no rows.
    """
    mark = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = written(sized.withColumn("rank", F.conv(F.substring(F.md5(mark), 1, 15), 16, 10).cast("long")))
    step = F.floor(F.lit(RANKS) / F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS))) + 1
    targets = source_targets(sized, max_repeats, cycle).withColumn("step", step.cast("long"))
    targets = targets.withColumnRenamed("source", "of")
    keyed = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", F.expr("rank div step"))
    bucket = F.col("source"), F.col("bucket")
    sums = keyed.groupBy(*bucket).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*bucket).orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.drop("of").withColumn("within", F.sum("size").over(inside))
    run = run.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
    upto = F.col("before") + F.col("within")
    finish = F.transform(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)),
        lambda turn: F.struct(((upto + F.col("source_size") * turn).cast("double") / F.col("target")).alias("finish"), F.col("rank").alias("rank"), turn.alias("turn")))
    run = written(run.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("target") > 0, finish).alias("turns")))
    return run.crossJoin(F.broadcast(_cut(run))).select(
        "doc_id", "size", "source_size", "target", "source",
        F.coalesce(F.size(F.filter("turns", lambda t: t <= F.col("cut"))), F.lit(0)).alias("copies"),
    ).withColumns({"copies": F.greatest("copies", F.lit(0)), "taken": F.col("size") * F.greatest("copies", F.lit(0))})


def mixed(docs: DataFrame, few: int = 1_000_000, **options) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as mix_sources takes it.

    Rows are matched by id, source and size, in which equal rows are taken equally often: by broadcast if
    there are at most ``few`` of these, else by a shuffle.
    """
    taken = mix_sources(docs, **options).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies").distinct()
    taken = written(taken.withColumnRenamed("copies", "__copies"))
    taken = F.broadcast(taken) if taken.count() <= few else taken
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (word_count(F.col("text")) == F.col("__size"))
    times = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__turn")
    return docs.join(taken, same).select(*docs.columns, times).drop("__turn")


def _cut(run: DataFrame) -> DataFrame:
    """One row: the last turn (finish, rank, number) that the budget, the sum of all sizes, still holds."""
    turns = run.select("size", F.explode("turns").alias("turn"))
    turns = turns.withColumn("band", F.least(F.lit(4 * BANDS), F.floor(F.col("turn.finish") * BANDS)).cast("long"))
    # One row per band, 4 * BANDS + 1 at most.
    along = Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = run.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    bands = turns.groupBy("band").agg(F.sum("size").alias("words")).withColumn("end", F.sum("words").over(along))
    over = bands.crossJoin(F.broadcast(budget)).where("end > budget")
    last = over.agg(F.min(F.struct("band", (F.col("budget") - F.col("end") + F.col("words")).alias("room"))).alias("last"))
    in_order = Window.partitionBy("band").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Only the band in which the budget ends, 1 / BANDS of the mix, is put in one order.
    edge = turns.join(F.broadcast(last), F.col("band") == F.col("last.band")).withColumn("used", F.sum("size").over(in_order))
    edge = edge.where(F.col("used") <= F.col("last.room")).agg(F.max("turn").alias("held"))
    end = F.struct((F.col("last.band") / F.lit(float(BANDS))).alias("finish"), F.lit(-1).cast("long").alias("rank"), F.lit(-1).alias("turn"))
    whole = F.struct(F.lit(float("inf")).alias("finish"), F.lit(-1).cast("long").alias("rank"), F.lit(-1).alias("turn"))
    return edge.crossJoin(F.broadcast(last)).select(F.coalesce("held", F.when(F.col("last").isNull(), whole).otherwise(end)).alias("cut"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (
  SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 15))::BIGINT AS rank FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per),
filling AS (
  SELECT *, row_number() OVER f AS place,
         (SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
opened AS (SELECT place AS p0, room AS r0, heavy AS h0 FROM filling WHERE cap * heavy >= room * weight ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN place < p0 THEN cap::DOUBLE ELSE r0::BIGINT::DOUBLE * weight::BIGINT::DOUBLE / h0::BIGINT::DOUBLE END AS target
  FROM filling, opened),
run AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rank,
         (sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rank))::BIGINT AS upto
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
numbered AS (SELECT *, row_number() OVER () AS row_no FROM run),
turns AS (
  SELECT row_no, size, rank, turn, (upto + source_size * turn)::DOUBLE / target AS finish
  FROM numbered, (SELECT unnest([0, 1, 2]) AS turn) WHERE target > 0),
used AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, turn) AS used FROM turns),
held AS (SELECT row_no, count(*) AS copies FROM used WHERE used <= (SELECT sum(size) FROM sized) GROUP BY row_no)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken, coalesce(copies, 0)::INTEGER AS copies
FROM numbered LEFT JOIN held USING (row_no)
"""
