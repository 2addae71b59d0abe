"""Hits of terms, lanes, learning and versions against plain loops."""

import datetime
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from spindrift.functions import fixed, privacy
from spindrift.operators import collection, enrichment, gates, hits, learning, scoring
from spindrift.sources import versions
from spindrift.sources.versions import Versions

JOB = "job_id long, title string, employer string, description string, location string"


def test_words_and_texts_within(spark):
    tokens = ["kirjastonhoitaja", "hoito", "a", "aaaa", "", "x" * 300 + "hoit"]
    words = ["hoit", "kirja", "aaa", "aaaa", "taja", "none", "x" * 50]
    got = hits.words_within(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((t, w) for t in tokens for w in words if len(w) >= 4 and w in t)
    values = [f"{a}{b}" for a in "abcde" for b in "abcdefgh"] + ["", "of the", "zz"]
    texts = [(k, "".join(random.Random(k).choices("abcdefgh of the", k=40))) for k in range(50)] + [(99, None), (100, "")]
    got = hits.texts_within(spark.createDataFrame(texts, "job_id long, text string"), spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert sorted(map(tuple, got)) == sorted((k, v) for k, t in texts for v in values if v and v in (t or ""))


def test_exclusions_against_a_loop(spark):
    texts = ["Straße und Haus", "STRASSE", "grosser Hausmeister", "asse", "opettajan työ", "", None, "the hand of"]
    jobs = [(k, t, f"Emp{k % 3}", "x", None) for k, t in enumerate(texts)]
    wanted = [(1, "term", "asse"), (1, "term", "stra"), (1, "term", "haus"), (1, "term", "opettaja"), (1, "employer", "EMP1"), (1, "sector", "ße u"), (2, "term", "abc"), (2, "sector", "hand of")]
    pairs = [(k, p) for k in range(len(texts)) for p in (1, 2)]
    got = scoring.exclusion_matches(spark.createDataFrame(pairs, "job_id long, profile_id long"), spark.createDataFrame(jobs, JOB), spark.createDataFrame(wanted, "profile_id long, kind string, value string"))
    want = {}
    for k, t, firm, d, _ in jobs:
        whole = " ".join(x for x in (t, firm, d) if x is not None)
        variants = {v for w in re.findall("[0-9a-zåäö]+", whole.lower().replace("ß", "ss")) for v in [w, *(w[: -len(e)] for e in fixed.SUFFIXES if len(w) >= 7 and w.endswith(e) and len(w) - len(e) >= 5)]}
        for p, kind, v in wanted:
            v = v.lower()
            ok = v in whole.lower() or v in variants if kind == "term" else v in firm.lower() if kind == "employer" else v in whole.lower()
            if ok and not (kind == "term" and len(v) < 4):
                want.setdefault((k, p), set()).add(v)
    assert {(r.job_id, r.profile_id): set(r.matches) for r in got.collect()} == want
    assert all(r.exclusion_penalty == 8 * len(r.matches) for r in got.collect())


def test_towns(spark):
    jobs = [(1, "Oulu"), (2, "oulu/Etä"), (3, "Oulunsalo"), (4, "Iso Kyrö, Suomi"), (5, None), (6, ""), (7, "Helsinki, OULU")]
    frame = spark.createDataFrame(jobs, "job_id long, location string")
    got = gates.town_pool(frame, spark.createDataFrame([(1, "Oulu"), (2, " iso  kyrö "), (3, ""), (4, "oulu")], "profile_id long, town string")).collect()
    assert {tuple(r) for r in got} == {(j, p) for j in (1, 2, 7) for p in (1, 4)} | {(4, 2)} and len(got) == 7


def plain_order(rows, quotas):
    """Lanes one after another over a list."""
    taken = []
    for lane, quota in quotas.items():
        by = (lambda r: (-(r[4] if r[4] is not None else r[2]), r[1])) if lane == "exploration" else (lambda r: (-r[2], r[1]))
        taken += [r for r in sorted(rows, key=by) if lane in r[3] and r not in taken][: max(0, quota)]
    return [r[1] for r in taken + [r for r in sorted(rows, key=lambda r: (-r[2], r[1])) if r not in taken]]


def test_lanes_against_a_loop(spark):
    r = random.Random(5)
    rows = [(p, j, float(r.randint(0, 20)), r.sample(list(fixed.LANE_QUOTAS), r.randint(0, 3)), r.choice([None, float(r.randint(0, 40))])) for p in range(5) for j in range(60)]
    overrides = [(1, "exploration", 7), (1, "direct_title", 1), (2, "exploration", 0), (2, "unknown", 5), (3, "sector_context", 0), (3, "sector_context", None), (4, "application_history", 50)]
    frame = spark.createDataFrame(rows, "profile_id long, job_id long, score double, lanes array<string>, unpenalized double")
    got = {}
    for x in scoring.lane_quota_order(frame, overrides=spark.createDataFrame(overrides, "profile_id long, lane string, quota int")).orderBy("place").collect():
        got.setdefault(x.profile_id, []).append(x.job_id)
    own = {1: {"exploration": 7, "direct_title": 1}, 2: {"exploration": 1}, 3: {"sector_context": 0}, 4: {"application_history": 50}}
    assert got == {p: plain_order([x for x in rows if x[0] == p], fixed.LANE_QUOTAS | own.get(p, {})) for p in range(5)}


def test_hysteresis_over_runs(spark):
    day = lambda d: datetime.datetime(2024, 3, d)
    jobs = spark.createDataFrame([(1, "kokki oulu", "A", "Oulu"), (2, "kokki", "B", "Oulu"), (3, "myyjä", "C", "Vaasa"), (4, "myyjä", "D", "Kuopio"), (5, "kokki", "E", "Kemi"), (6, "x", "F", "y"), (7, "x2", "F2", "y2")], "job_id long, title string, employer string, location string")
    make = lambda rows: spark.createDataFrame(rows, "profile_id long, job_id long, rating int, applied boolean, created_at timestamp_ntz")
    first = [(1, 1, 1, False, day(1)), (1, 2, 1, False, day(2)), (1, 3, 5, False, day(1)), (1, 4, 5, False, day(1)), (1, 6, 3, False, day(1)), (1, 7, 3, False, day(1)), (1, 7, 3, False, day(2))]
    as_of, none = F.lit("2024-03-02 00:00:00").cast("timestamp_ntz"), spark.createDataFrame([], learning.LISTS)
    limits = learning.Limits(enter=-1.9, leave=-0.9)
    base = spark.createDataFrame([(None, "vaasa")], "profile_id long, term string")
    lists, state = learning.run(make(first), jobs, none, spark.createDataFrame([], learning.STATE), base, as_of, limits)
    of = lambda rows, name: {x.term for x in rows.collect() if x.list == name}
    assert "kokki" in of(lists, "exclusion") and of(lists, "title") == {"myyjä"} and "vaasa" not in of(lists, "discovery") and "kuopio" in of(lists, "discovery")
    # Nothing new: the same lists, and the version stays.
    again, same = learning.run(make(first), jobs, lists, state, base, as_of, limits)
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in lists.collect()} and same.first().version == state.first().version == 1 and not same.first().changed
    # A liked cook: above the limit to enter, below that to leave.
    more, now = learning.run(make([*first, (1, 5, 4, False, day(2)), *[(1, 6, 3, False, day(2))] * 5]), jobs, lists, state, base, as_of, limits)
    kokki = next(x for x in more.collect() if x.list == "known" and x.term == "kokki")
    assert "kokki" in of(more, "exclusion") and -1.9 < kokki.net <= -0.9 and kokki.first_seen == datetime.date(2024, 3, 1)
    fresh, _ = learning.run(make([*first, (1, 5, 4, False, day(2)), *[(1, 6, 3, False, day(2))] * 5]), jobs, none, state, base, as_of, limits)
    assert "kokki" not in of(fresh, "exclusion") and now.first().version >= 1


def test_a_version_is_whole_or_not_there(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/v"
    table = Versions(spark, folder, 10)
    rows = lambda v: spark.range(30).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    table.commit(1, {"a": (rows(1), ["k"], "v"), "b": (rows(1), ["k"], "v")})
    broken = rows(2).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="no"):
        table.commit(2, {"a": (rows(2), ["k"], "v"), "b": (broken, ["k"], "v")})
    seen = lambda name: {r.v for r in table.read(name, "k long, v int").collect()}
    assert seen("a") == seen("b") == {1} and table.numbers() == [1]
    table.commit(2, {"a": (rows(2), ["k"], "v"), "b": (rows(2), ["k"], "v")})
    assert seen("a") == seen("b") == {2}


def test_keys_below(spark):
    rows = ['{"skills": [{"CV-text": 1, "x": [{"Postal Code": 2, "y": null}]}], "other": 1}', "[1]", "no", None, '{"location": {"home_city": "é", "zip": 1}, "objective": "a@b.fi"}', '{"skills":' + "[" * 5000 + "]" * 5000 + "}"]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, p string")
    got = [r.o for r in frame.select("k", privacy.outbound()(F.col("p")).alias("o")).orderBy("k").collect()]
    assert got[:5] == ['{"skills":[{"x":[{"y":null}]}]}', None, None, None, '{"objective":"a@b.fi","location":{"home_city":"é"}}']
    assert got[5] is None or "zip" not in got[5]
    assert [r.o for r in frame.select("k", privacy.outbound(None)(F.col("p")).alias("o")).orderBy("k").collect()][1] == "[1]"


def test_two_inputs_of_a_job_claimed_at_once(spark):
    table = Versions(spark, tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/v")
    for batch, letter in ((1, "a"), (2, "b")):
        jobs = spark.createDataFrame([(1, True, "static", letter, "short"), (2, True, "static", "a", "short")], "job_id long, active boolean, enricher string, hash string, description string")
        results = [(1, "static", "a", "old", 9, "no" if batch == 1 else None), (1, "static", "b", "new", 1, None), (2, "static", "a", "text", 1, None)]
        results = spark.createDataFrame(results, "job_id long, enricher string, hash string, text string, confidence int, error string")
        enrichment.enrich(table, batch, jobs, results, F.lit(f"2024-03-20 {13 + batch}:00:00").cast("timestamp_ntz"), 300, 100)
    run = next(r for r in table.read("runs", enrichment.RUNS).collect() if r.batch == 2)
    assert (run.processed, run.applied, run.failed) == (2, 1, 0)
    got = {r.job_id: (r.description, r.confidence, r.hash) for r in table.read("texts", enrichment.TEXTS).collect()}
    assert got == {1: ("new", 1, "b"), 2: ("text", 1, "a")}


def test_weights_of_jobs_that_come_twice_and_of_suggestions(spark):
    day = datetime.datetime(2024, 3, 1)
    jobs = spark.createDataFrame([(1, "kokki", "A", "Oulu"), (1, "kokki", "A", "Oulu"), (2, "kokki", "B", "Oulu")], "job_id long, title string, employer string, location string")
    said = spark.createDataFrame([(1, 1, 5, False, day), (1, 1, 5, False, day), (1, 2, 5, False, day), (1, 9, 3, False, day)], "profile_id long, job_id long, rating int, applied boolean, created_at timestamp_ntz")
    own, firms = learning.terms_of(jobs)
    limits = learning.Limits()
    per = learning.heard(said, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), limits)
    got = {r.term: (r.net, r.jobs, r.title_like) for r in learning.term_weights(per, own, limits).collect()}
    assert got == {"kokki": (5.0, 2, True), "oulu": (5.0, 2, False), "a": (4.0, 1, False), "b": (1.0, 1, False)}
    assert {r.term: (r.net, r.jobs) for r in learning.term_weights(per, firms, limits).collect()} == {"a": (4.0, 1), "b": (1.0, 1)}
    more = spark.createDataFrame([(1, 1, "kokki", 0.5), (1, 9, "uusi", 0.25), (1, 1, "uusi", 0.25), (2, 1, "x", 1.0)], "profile_id long, job_id long, term string, delta double")
    got = {r.term: (r.net, r.jobs) for r in learning.term_weights(per, own, limits, more).collect()}
    assert got == {"kokki": (5.5, 2), "oulu": (5.0, 2), "a": (4.0, 1), "b": (1.0, 1), "uusi": (0.5, 2)}


def test_learning_makes_terms_and_weights_once(spark):
    """Variants are made before the explode, jobs are counted without a distinct, and nothing is made again for the state."""
    jobs = spark.createDataFrame([(1, "kokki oulu", "A", "Oulu")], "job_id long, title string, employer string, location string")
    said = spark.createDataFrame([(1, 1, 5, False, datetime.datetime(2024, 3, 1))], "profile_id long, job_id long, rating int, applied boolean, created_at timestamp_ntz")
    base = spark.createDataFrame([], "profile_id long, term string")
    lists, state = learning.run(said, jobs, spark.createDataFrame([], learning.LISTS), spark.createDataFrame([], learning.STATE), base, F.lit("2024-03-02 00:00:00").cast("timestamp_ntz"))
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert all(x not in plan(rows) for rows in (lists, state) for x in ("Join", "Aggregate", "Window"))
    text = plan(learning.job_terms(jobs))
    assert "Generate" in text and "lambda" not in text[: text.index("Generate")]


def test_a_bucket_is_written_by_several_tasks(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/v"
    table = Versions(spark, folder, bucket_rows=600, task_rows=50)
    rows = lambda first, end, v: spark.range(first, end).select(F.col("id").alias("k"), F.lit(v).alias("v"), F.repeat(F.lit("x"), F.col("id").cast("int") % 7).alias("text"))
    table.commit(1, {"a": (rows(0, 500, 1), ["k"], "v")})
    files = lambda n: table.read("a", "k long, v int, text string", n).groupBy(F.input_file_name()).count().collect()
    assert len(files(2)) == 10 and max(r["count"] for r in files(2)) < 100
    table.commit(2, {"a": (rows(400, 1500, 2), ["k"], "v")})
    assert len(table.manifest()["a"]) > 1 and max(r["count"] for r in files(3)) < 100
    got = {r.k: (r.v, r.text) for r in table.read("a", "k long, v int, text string").collect()}
    assert got == {k: (1 if k < 400 else 2, "x" * (k % 7)) for k in range(1500)}


def test_collected_texts_are_kept_once(spark):
    """Of every description one copy, rows without it, and a job's is the longest of its open occurrences, of equally long ones the least."""
    table = Versions(spark, tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/v")
    day, long = datetime.datetime(2024, 3, 1), "x" * 5000
    land = lambda rows: spark.createDataFrame([(*r[:3], day, "Kokki", "A", "Oulu", r[3]) for r in rows], "seq long, source_id int, external_id string, published_at timestamp_ntz, title string, employer string, location string, description string")
    whole = lambda *ids: spark.createDataFrame([(i,) for i in ids], "source_id int")
    first = [(1, 1, "a", " bb "), (2, 2, "a", "ab"), (3, 3, "a", "ba"), (4, 4, "a", None), (5, 1, "b", long), (6, 1, "c", long)]
    collection.collect(table, 1, land(first), whole(1, 2, 3, 4))
    of = lambda n=None: {r.job_id: (r.status, r.d) for r in collection.described(table.read("jobs", collection.JOBS, n), table.read("texts", collection.TEXTS, n), d=F.col("description")).collect()}
    texts = lambda n=None: sorted(r.description for r in table.read("texts", collection.TEXTS, n).collect())
    assert of() == {1: ("active", "ab"), 5: ("active", long), 6: ("active", long)} and texts() == sorted([" bb ", "ab", "ba", long])
    assert "description" not in collection.OCCURRENCES and "description" not in collection.JOBS
    # Source 2's does not come again, source 3 has another text, and one is there by its text already.
    for _ in range(2):
        collection.collect(table, 2, land([(7, 1, "a", " bb "), (8, 3, "a", "bbb"), (9, 1, "b", "ab"), (10, 1, "c", long)]), whole(1, 2, 3))
        assert of(3) == {1: ("active", "bbb"), 5: ("active", "ab"), 6: ("active", long)} and texts(3) == sorted([*texts(2), "bbb"])
    assert [b.path for b in table.manifest(2)["texts"]] == [b.path for b in table.manifest(3)["texts"]][:1]


def test_parts_are_written_together(spark, monkeypatch):
    monkeypatch.setattr(versions, "MOST_PARTS", 3)
    table = Versions(spark, tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/v")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    for n in range(1, 6):
        table.commit(n, {}, added={"a": table.add("a", keys(n), n, keys(2, 3, 4))})
        got = sorted(r.k for r in table.read("a", "k long").collect())
        assert got == ([*range(1, n + 1)] if n < 4 else [*range(2, n + 1)]) and len(table.manifest()["a"]) == (n if n < 4 else n - 3)
    assert table.add("a", keys().where("false"), 6, keys()) == table.manifest()["a"]
