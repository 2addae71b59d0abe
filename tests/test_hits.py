"""Phrases and texts that jobs hold, and the plans that find them, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from spindrift.functions import listing as L, text as T
from spindrift.operators import gates, hits, matching, scoring
from spindrift.plans import flagship
from spindrift.plans.binding import Tables


def test_phrases_against_a_loop(spark, monkeypatch):
    texts = [(k, " ".join(random.Random(k).choices(["a", "b", "the", "hand", "kirja"], k=k % 9))) for k in range(60)] + [(90, None)]
    phrases = ["a", "the", "the hand", "a b", "b a b", "hand the kirja", "hand hand", "an", "rja", ""]
    rows, wanted = spark.createDataFrame(texts, "job_id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = sorted((k, p) for k, t in texts for p in phrases if p and f" {p} " in f" {t or ''} ")
    for few in (hits.FEW, 1):
        monkeypatch.setattr(hits, "FEW", few)
        assert sorted(map(tuple, hits.phrases_in(rows, wanted).collect())) == want


def test_texts_by_their_words(spark):
    texts = [(k, "".join(random.Random(k).choices(["kirja", "hand", "the", " ", ", ", "ß", "ss", "å"], k=14))) for k in range(80)] + [(90, "")]
    values = ["kirja", "irjahan", "kirja the", "hand, ", "rjaß", "ssså", "the", " ", "ja, h", "handthe hand", ""]
    rows, wanted = spark.createDataFrame(texts, "job_id long, text string"), spark.createDataFrame([(v,) for v in values], "value string")
    tokens = rows.select("job_id", F.explode(F.array_distinct(F.split("text", T.OTHER))).alias("token")).where("token <> ''")
    want = sorted((k, v) for k, t in texts for v in values if v and v in t)
    assert sorted(map(tuple, hits.texts_within(rows, wanted, tokens).collect())) == want == sorted(map(tuple, hits.texts_within(rows, wanted).collect()))


def test_other_is_what_no_token_is(spark):
    every = "".join(chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000)
    got = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", T.OTHER, "").alias("c")).first().c
    assert got == "".join(re.findall(T.TOKEN, every))


def test_texts_are_cut_once(spark):
    jobs = spark.createDataFrame([(1, "Kirjasto", "x", "Ajokortti vaaditaan. Ruotsin kielen taito vaaditaan.", "Oulu")], "job_id long, title string, employer string, description string, location string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    words = jobs.select("job_id", T.normalized(F.concat_ws(" ", "title", "description")).alias("text"))
    assert plan(hits.phrases_in(words, spark.createDataFrame([("of the",)], "phrase string"))).count("array_distinct") == 1
    checks = spark.createDataFrame([("driver", [], [], [], ["ajokortti"], [], True)], "name string, title_or_text array<string>, reject array<string>, adjacent array<string>, caution array<string>, required array<string>, never_by_title boolean")
    assert [tuple(r) for r in gates.qualification_gate(jobs, checks).collect()] == [(1, "driver", "caution")]


def test_sentences_cut_at_line_ends(spark):
    texts = ["one two three\nfour five six.", "one two\r three four.", "one two\u2028 three four.", "one\vtwo three four.", "one two \n\nthree. Four five", "short. two. three.", "one\u00a0two.\u00a0 \u3000three four.", ""]
    for n in range(5, 16):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.first_sentences(F.col("t"), 2, n).alias("s")).collect()
        for r in got:
            whole = " ".join(x.strip(" \u00a0\u3000") for x in re.findall("[^.!?]+[.!?]", r.t)[:2])
            assert r.s == (whole if len(whole) <= n else re.sub(r"[ \t\n\f\r]+[^ \t\n\f\r]*\Z", "", whole[:n], count=1) + "."), (n, r)


def test_words_of_profiles_without_pairs_are_not_looked_for(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    who, seen = flagship.profiles(t), []
    record = lambda tokens, words, *more: (seen.extend(r.word for r in words.select("word").collect()), hits_words(tokens, words, *more))[1]
    hits_words = hits.words_within
    for module in (hits, scoring):
        monkeypatch.setattr(module, "words_within", record)
    pairs = spark.createDataFrame([(0, 1, None), (0, 2, None)], "profile_id long, job_id long, pool string")
    jobs = flagship.postings(t).where("job_id in (1, 2)")
    got = matching.scored_pairs(pairs, jobs, who, flagship._vectors(t), flagship._policy(t))
    assert {(r.profile_id, r.job_id) for r in got.collect()} == {(0, 1), (0, 2)}
    own = {w for k in ("negatives", "cautions", "exclusions") for r in getattr(who, k).where("profile_id = 0").collect() for w in re.split("[^0-9a-zåäö]+", r.value.lower())}
    assert seen and set(seen) <= own


def test_tokens_and_where_they_stand(spark):
    words = ["Straße", "strasse", "stra", "e", "Oulu", "ßa", "ssa", "MASSE", "maße", "kirja"]
    r = random.Random(3)
    rows = [(k, " ".join(r.choices(words, k=k % 3)), r.choice(words), "-".join(r.choices(words, k=k % 7)), r.choice([None, "Oulu, Straße", "Kemi"])) for k in range(80)] + [(90, None, None, None, None)]
    got = {(x.job_id, x.token): x[2:] for x in hits.job_tokens(spark.createDataFrame(rows, "job_id long, title string, employer string, description string, location string")).select("job_id", "token", "in_title", "in_location", "in_text", "raw").collect()}
    cut = lambda c, fold=True: set(re.findall(T.TOKEN, (c or "").lower().replace("ß", "ss" if fold else "ß")))
    want = {}
    for k, title, firm, text, place in rows:
        whole = " ".join(x for x in (title, firm, text) if x is not None)
        for w in cut(whole) | cut(place) | cut(whole, False):
            inside = w in cut(whole)
            if inside or w in cut(place) or w in cut(whole, False):
                want[k, w] = (inside and w in cut(title), w in cut(place), inside, w in cut(whole, False))
    assert got == want


def test_runs_of_stems_hold_the_phrases_that_all_stems_hold(spark):
    words = ["hammaslääkäri", "Hammaslääkärin", "xhammaslääkäri", "sosiaalityöntekijän", "kelpoisuus", "kelpoisuutta", "ajokortti", "ajokortista", "ajo", "ja", "ßajokortti", "åajokortti"]
    phrases = ["hammaslääkäri", "sosiaalityöntekijän kelpoisuus", "ajokortti", "kelpoisuus ajokortti", "ja"]
    texts = ["".join(w + random.Random(k * 50 + n).choice([" ", ", ", "-", "\n", ". | "]) for n, w in enumerate(random.Random(k).choices(words, k=k % 12))) for k in range(150)] + [None, ""]
    one = lambda c: [r[0] for r in spark.createDataFrame([(c_,) for c_ in c], "t string").select(L.stemmed(F.col("t"))).collect()]
    stems = one(phrases)
    begins = sorted({w for s in stems for w in s.split()})
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.stemmed(F.col("t")).alias("a"), F.coalesce(L.stemmed_runs(F.col("t"), begins), F.lit("")).alias("b")).collect():
        assert [f" {s} " in f" {r.a} " for s in stems] == [f" {s} " in f" {r.b} " for s in stems], r


def test_only_tokens_that_are_looked_for_are_kept(spark):
    tokens = spark.createDataFrame([(k, w, False, False, True, True) for k, w in enumerate(["kirjastossa", "tapahtumia", "xkirjax", "talo", "opettajan", "opettaja", "ab"])], "job_id long, token string, in_title boolean, in_location boolean, in_text boolean, raw boolean")
    words, variants = spark.createDataFrame([("kirja",), ("ab",)], "word string"), spark.createDataFrame([("tapahtuma",), ("opettaja",), ("ab",)], "variant string")
    got, known = hits.only_met(tokens, hits.distinct_tokens(tokens), words, variants)
    assert sorted(r.token for r in got.collect()) == sorted(r.token for r in known.collect()) == ["ab", "kirjastossa", "opettaja", "opettajan", "tapahtumia", "xkirjax"]
