"""What of a profile's words, phrases and texts a job holds: found per job first, then joined by id, so that no text is
copied for every profile."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..sources.tables import spread, written

#: Rows of a table of terms that are broadcast at most; beyond that they are joined by a shuffle.
FEW = 1_000_000
#: Texts of one group that a text is searched for in one go.
GROUP = 500
#: A word must be so long to count as a part of a token.
LEAST = 4


def is_small(table: DataFrame) -> bool:
    return table.limit(FEW + 1).count() <= FEW


def small(table: DataFrame) -> DataFrame:
    """A table of terms, to be broadcast if it has no more than FEW rows."""
    return F.broadcast(table) if is_small(table) else table


def job_tokens(jobs: DataFrame) -> DataFrame:
    """(job_id, token, in_title, in_location, in_text, raw): each job's distinct tokens and where they stand, written once.

    Tokens are folded; ``raw`` tells those that stand in the lower-case text as they are, among them pieces of words
    with ß, which are tokens of nothing else."""
    whole, sharp = F.concat_ws(" ", "title", "employer", "description"), F.lit("ß")
    rows = spread(jobs.select("job_id", "title", "employer", "description", "location"))
    pieces = F.when(F.contains(F.lower(whole), sharp), F.array_remove(F.array_distinct(F.split(F.lower(whole), T.OTHER)), ""))
    rows = rows.select("job_id", T.tokens(whole).alias("_all"), T.tokens(F.col("title")).alias("_title"), T.tokens(F.col("location")).alias("_place"), pieces.alias("_raw"))
    broken = F.coalesce(F.array_except("_raw", "_all"), F.array().cast("array<string>"))
    places = F.array_except(F.array_except("_place", "_all"), broken)
    # Those of the whole text, of the location alone, the broken ones; what holds of each is told after the explode, where it
    # is generated code. posexplode_outer: posexplode would have its whole array made a second time, for a filter on its size.
    rows = rows.select("job_id", "_title", "_place", "_raw", F.size("_all").alias("_n"), F.concat("_all", places, broken).alias("_each"))
    each = rows.select("job_id", "_title", "_place", "_raw", "_n", F.posexplode_outer("_each").alias("_pos", "token")).where("token is not null")
    token, inside = F.col("token"), F.col("_pos") < F.col("_n")
    whole_word = F.col("_raw").isNull() | ~F.contains(token, F.lit("ss")) | F.array_contains("_raw", token)
    raw = F.when(inside, whole_word).otherwise(F.coalesce(F.array_contains("_raw", token), F.lit(False)))
    stands = {"in_title": inside & F.array_contains("_title", token), "in_location": F.array_contains("_place", token), "in_text": inside, "raw": raw}
    return written(each.select("job_id", "token", *(c.alias(k) for k, c in stands.items())))


def phrases_in(rows: DataFrame, phrases: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(job_id, phrase) and the columns ``keep`` of rows: phrases (words joined by single spaces) that stand in rows
    (job_id, text: words joined by single spaces) as whole words. job_id is unique in rows.

    A text's distinct words meet the longest word of each phrase; the text is searched for those phrases alone whose
    longest word it has. Phrases are broadcast if they are few, so that no word of a text is shuffled."""
    wanted, kept = phrases.select("phrase").where("phrase <> ''").distinct(), keep or []
    longest = F.array_max(F.transform(F.split("phrase", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = wanted.withColumn("_word", longest)
    texts = rows.select("job_id", *kept, F.concat(F.lit(" "), "text", F.lit(" ")).alias("_t"), F.array_distinct(F.split("text", " ")).alias("_ws"))
    there = (F.col("phrase") == F.col("_word")) | F.contains(F.col("_t"), F.concat(F.lit(" "), "phrase", F.lit(" ")))
    if is_small(wanted):
        found = texts.select("job_id", *kept, "_t", F.explode_outer("_ws").alias("_word")).join(F.broadcast(wanted), "_word")
    else:
        found = texts.select("job_id", F.explode_outer("_ws").alias("_word")).join(wanted, "_word").join(texts.drop("_ws"), "job_id")
    return found.where(there).select("job_id", *kept, "phrase")


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    """(token, raw, in_text, in_location) of job_tokens, each token once with what holds of it in any job, written once."""
    return written(tokens.groupBy("token").agg(*(F.bool_or(c).alias(c) for c in ("raw", "in_text", "in_location"))))


def only_met(tokens: DataFrame, known: DataFrame, words: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of tokens (job_tokens) and known (distinct_tokens) of those tokens alone that have a part in words (word) or
    one of variants (variant), written once. What looks for none but these finds the same in them."""
    alike = variants_of(known, variants).join(small(variants), "variant")
    held = small(written(words_within(tokens, words, known).select("token").union(alike.select("token")).distinct()))
    return written(tokens.join(held, "token", "left_semi")), written(known.join(held, "token", "left_semi"))


def words_within(tokens: DataFrame, words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(token, word): words of LEAST characters and more that are part of tokens, written once. tokens: token; words: word.
    known: the distinct tokens, if there are some already.

    Of each distinct token the parts of LEAST characters meet the beginnings of the words; the words that are met are
    then looked for."""
    wanted = words.select("word").where(F.length("word") >= LEAST).distinct().withColumn("_part", F.substring("word", 1, LEAST))
    each = (tokens.select("token").distinct() if known is None else known.select("token")).where(F.length("token") >= LEAST)
    parts = F.array_distinct(F.regexp_extract_all("token", F.lit(rf"(?s)(?=(.{{{LEAST}}}))"), F.lit(1)))
    # explode_outer: explode would have its whole array made a second time, for a filter on its size.
    met = each.select("token", F.explode_outer(parts).alias("_part")).join(small(wanted), "_part")
    return written(met.where(F.contains("token", F.col("word"))).select("token", "word"))


def texts_within(rows: DataFrame, values: DataFrame, tokens: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(job_id, value): values that are part of the text of rows (job_id, text), wherever they begin. job_id is unique.

    tokens: job_id, token: the words of each text in lower case, if there are some already, and known: the distinct ones of
    these; then a text, which must be in lower case, is searched only for values of whose longest word it has a part.
    Values without a word of LEAST characters are searched for in every text, GROUP at a time where it lies."""
    wanted = values.select("value").where("value <> ''").distinct()
    if tokens is None:
        return _searched(rows, wanted)
    longest = F.array_max(F.transform(F.split("value", T.OTHER), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = written(wanted.withColumn("word", longest))
    worded, others = keyed.where(F.length("word") >= LEAST), keyed.where(F.length("word") < LEAST)
    held = written(words_within(tokens, worded, known).join(small(worded), "word").select("token", "word", "value"))
    met = tokens.join(small(held), "token").select("job_id", "word", "value").distinct()
    found = met.where("value = word").select("job_id", "value").union(_searched(rows, others.select("value")))
    if held.where("value <> word").isEmpty():
        return found
    # Texts are made of those rows alone that have a part of such a value.
    met = written(met.where("value <> word").select("job_id", "value"))
    texts = rows.join(small(met.select("job_id").distinct()), "job_id", "left_semi")
    return found.union(texts.join(small(met), "job_id").where(F.contains("text", F.col("value"))).select("job_id", "value"))


def variants_of(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(token, variant) of the distinct tokens in known, of all that may have one of the variants in wanted (variant): a
    variant is how its token begins, or its base form in the table of these."""
    start = lambda c: F.substring(c, 1, LEAST).alias("_start")
    starts = wanted.select(start("variant"), F.lit(True).alias("_met")).distinct()
    may = known.select("token", start("token")).join(small(starts), "_start", "left").where(F.col("_met") | F.col("token").isin(*fixed.LEMMAS))
    return may.select("token", F.explode_outer(T.token_variants(F.col("token"))).alias("variant"))


def _searched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    groups = math.ceil(wanted.count() / GROUP)
    if not groups:
        return rows.where("false").select("job_id", F.lit("").alias("value"))
    lists = wanted.groupBy(F.pmod(F.xxhash64("value"), F.lit(groups)).alias("_g")).agg(F.collect_list("value").alias("_vs"))
    found = rows.select("job_id", "text").crossJoin(F.broadcast(lists)).select("job_id", F.filter("_vs", lambda v: F.contains(F.col("text"), v)).alias("_f"))
    # explode_outer: explode would search a second time, for a filter on the size of what is found.
    return found.select("job_id", F.explode_outer("_f").alias("value")).where("value is not null")
