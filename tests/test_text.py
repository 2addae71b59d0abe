"""Literal cases of text functions and gates."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import links, text as T
from spindrift.operators import gates, scoring, state


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Kirjasto- ja kulttuurityö OULU ja") == ["kirjasto", "ja", "kulttuurityö", "oulu"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []


@pytest.mark.parametrize("token, among", [("hallinnon", "hallinto"), ("tapahtumissa", "tapahtuma"), ("opastuksessa", "opastus"), ("kirjastossa", "kirjasto")])
def test_variants(spark, token, among):
    assert among in one(spark, T.token_variants(F.col("t")), t=token)


def test_phrase(spark):
    assert one(spark, T.has_phrase(T.normalized(F.col("t")), F.lit("oulun kaupunki")), t="Oulun, kaupunki!")
    assert not one(spark, T.has_phrase(T.normalized(F.col("t")), F.lit("kaupunki")), t="kaupunkisuunnittelu")


@pytest.mark.parametrize("text, mode", [("täysin etänä", "full_remote"), ("täysin etänä, hybrid", "unknown"), ("hybridimalli", "hybrid"), ("etätyö: ei, hybridi", "none"), ("", "unknown")])
def test_work_mode(spark, text, mode):
    assert one(spark, T.work_mode(T.folded(F.col("t"))), t=text)["mode"] == mode


def test_city(spark):
    assert one(spark, T.city_of(F.col("t")), t="Työ Oulun yliopisto, Helsinki") == "Oulu"
    assert one(spark, T.city_of(F.col("t")), t="töitä Kuopiossa") == "Kuopio"
    assert one(spark, T.city_of(F.col("t")), t="Vaasassa tai Turku") == "Turku"


@pytest.mark.parametrize("days, reason", [(30, "fresh"), (31, "too_old"), (-1, "future_publication_date")])
def test_freshness(spark, days, reason):
    as_of = F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")
    row = spark.range(1).select((as_of - F.expr(f"make_dt_interval({days})")).alias("published_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    assert gates.freshness(row, as_of).first()["reason"] == reason


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (7, 16)], "k int, n int").select(scoring.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert rows[0]["w"] is None and tuple(rows[1]["w"]) == (0.0, 0.278) and tuple(rows[2]["w"]) == (0.231, 0.668)


@pytest.mark.parametrize("rows", [[(1, " long text "), (1, "text")], [(1, "text"), (1, " long text ")]])
def test_canonical_in_any_order(spark, rows):
    assert state.canonical(spark.createDataFrame(rows, "k int, v string"), "k", "v").first()["v"] == "long text"


def test_lane_quotas(spark):
    rows = [(0, k, 100 - k, ["direct_title"]) for k in range(15)] + [(0, 99, 1, ["exploration"])]
    scored = spark.createDataFrame(rows, "profile_id long, job_id long, score long, lanes array<string>")
    place = {r.job_id: r.place for r in scoring.lane_quota_order(scored).collect()}
    assert place[99] == 11 and place[0] == 1 and place[14] == 16
    assert scoring.lane_quota_order(scored.where("job_id < 0")).collect() == []


def test_misses_close(spark):
    rows = [(1, k, k, o) for k, o in enumerate(["missing", "invalid", "missing", "classified", "missing", "missing", "missing"])]
    got = state.miss_runs(spark.createDataFrame(rows, "source_id long, ts long, event_id long, outcome string")).orderBy("ts").collect()
    assert [r.misses for r in got] == [1, 1, 2, 0, 1, 2, 3] and got[-1].state == "closed"


def test_excerpt_against_a_loop(spark):
    import random
    import re

    from spindrift.functions import listing as L

    r = random.Random(1)
    for _ in range(25):
        text = " ".join(r.choice(["We need the skill.", "Nothing here.", "Und so weiter!", "A longer sentence without any mark?"]) for _ in range(r.randint(1, 14)))
        want = text
        if len(text) > 120:
            kept, used = [], 0
            for s in reversed([x for x in re.split(r"(?<=[.!?])\s+", text) if "the " in x.lower() or "und " in x.lower()]):
                if used + len(s) + 1 <= 60:
                    kept.insert(0, s)
                    used += len(s) + 1
            want = (text[:60] + " ".join(kept))[:120] if kept else text[:120]
        assert one(spark, L.excerpt(F.col("t"), 120, ["the ", "und "]), t=text) == want


def test_stems_do_not_depend_on_their_place(spark):
    from spindrift.functions import listing as L

    assert one(spark, L.stemmed(F.col("t")), t="a b c d e f opettajan") == "a b c d e f opettaja"


@pytest.mark.parametrize(
    "url, reason",
    [
        ("\t https://example.org/x\n", None), ("https://example.org/a\tb", "control_characters"), ("https://[::1]:x/", "malformed"), ("https://[::1]:99999/", "malformed"), ("https://[::1]:80/", "private_host"), ("https://[example.org/", "malformed"),
        ("https://example.org]/", "malformed"), ("https://example.org:/x", None), ("https://@example.org/", None), ("https://240.1.2.3/", "private_host"), ("https://172.32.0.1/", None), ("\n", "missing"), (None, "missing"),
    ],
)
def test_addresses(spark, url, reason):
    assert one(spark, links.rejection(F.col("u")), u=url) == reason
    assert one(spark, links.safe_link(F.col("u")), u=url) == (None if reason else url.strip().rstrip("/"))


def test_decisive_sentences_are_made_once(spark):
    from spindrift.functions import listing as L

    text = " Ensin.  Tutkinto vaaditaan! \t\nMuuta. required\n. Ei." + "x" * 60 + ". Licence? "
    row = spark.createDataFrame([(text,)], "t string").select(L.coverage(F.col("t"), 60, ["vaadit", "required", "licence"]).alias("c"), L.decisive(F.col("t"), ["vaadit", "required", "licence"]).alias("d"))
    got = row.first()
    assert got.d == ["Tutkinto vaaditaan!", "required\n.", "Licence?"] and tuple(got.c) == (3, 2, 3)
    plan = spark.range(1).select(L.coverage(F.col("id").cast("string"), 60, ["vaadit"]).alias("c")).select("c.*")._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") == 1


def test_any_of_some_marks(spark):
    marks = ["a+b", "a", "(x", "-", "^z", "å]", "\\d", "ß ", "𝒳y", "]"]
    texts = ["", "b", "xa", "(x)", "x", "z-", "^z", "z", "å", "å]", "d", "\\d", "ß", "ß ", "𝒳", "𝒳y", "]", "&&", "[" ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for some in [marks, marks[2:], ["(x", "&&"], ["b", "bb", "z"], [""], ["x", ""], []]:
        got = [r[0] for r in frame.select(T.has_any(F.col("t"), some)).collect()]
        assert got == [any(m in t for m in some) for t in texts], some
