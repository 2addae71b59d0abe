import os
import tempfile

from pyspark.sql import functions as F

from spindrift.operators import state
from spindrift.plans.binding import Tables
from spindrift.sources import landed, tables
from spindrift.sources.versions import Versions
from spindrift.streaming import ingest


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_payloads(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    put(folder, "one/a.json", '{"title": {"en": "Cook", "sv": "Kock"}, "deadline": "2024-03-01"}\nnot json\n')
    put(folder, "two/b.json", '{"title": {"de": "Koch"}, "deadline": "soon", "endDate": "2024-03-01T10:00:00Z"}\n')
    rows = landed.read_payloads(spark, folder)
    got = {(r.source_name, r.title, str(r.until)) for r in rows.where("payload is not null").select("source_name", landed.localized(F.col("payload"), "title").alias("title"), landed.deadline(F.col("payload")).alias("until")).collect()}
    assert got == {("one", "Cook", "2024-03-01 22:00:00"), ("two", "Koch", "2024-03-01 10:00:00")} and rows.count() == 3


def test_feed_and_sitemap(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    feed = put(folder, "feed.xml", "<rss><channel><item><title>A</title><link>l/jobID:12/</link><pubDate>Mon, 04 Mar 2024 08:00:00 +0200</pubDate></item><item><title>B</title><description>none</description></item><item><title>C</title><link>jobID:13</link><pubDate>odd</pubDate></item></channel></rss>")
    assert {(r.job_id, r.title, r.published_at is None) for r in landed.read_feed(spark, feed).collect()} == {("12", "A", False), ("13", "C", True)}
    site = put(folder, "site.xml", "<urlset><url><loc>https://x/tyopaikka/a-1</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://x/tyopaikka/a-1/</loc><lastmod>2024-01-05</lastmod></url><url><loc>https://x/other</loc></url><url><loc>https://x/tyopaikka/b-2</loc></url></urlset>")
    assert {(r.external_id, r.url) for r in landed.read_sitemap(spark, site, watermark="2024-01-03").collect()} == {("a-1", "https://x/tyopaikka/a-1/"), ("b-2", "https://x/tyopaikka/b-2")}


def test_html(spark):
    page = '<article class="x"><p>One &amp; two</p><script>no()</script><p> </p><ul><li>three</li></ul></article><script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">{"@type": ["JobPosting"], "title": "T"}</script><ul><li><a href="/jobs/12345?x=1"><h3>Cook</h3></a><time datetime="2024-01-01"></time></li><li>no link</li></ul>'
    r = spark.createDataFrame([(page,)], "h string").select(landed.article_text(F.col("h")).alias("text"), F.variant_get(landed.linked_data(F.col("h")), "$.title", "string").alias("title"), landed.listing_cards(F.col("h")).alias("cards")).first()
    assert r.text == "One & two\nthree" and r.title == "T"
    assert [(c.href, c.id, c.title, c.day) for c in r.cards] == [("/jobs/12345", "12345", "Cook", "2024-01-01")]


def test_streams(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    scan = Tables(spark, "/root/testdata/sf0.001").scan.where("source_id < 12")
    for k in range(2):
        part = scan.where(f"ts {'<' if k == 0 else '>='} timestamp_ntz'2024-01-15 00:00:00'")
        part.coalesce(1).write.mode("overwrite").json(f"{folder}/in/{k}")
        for name in os.listdir(f"{folder}/in/{k}"):
            if name.endswith(".json"):
                os.makedirs(f"{folder}/land", exist_ok=True)
                os.rename(f"{folder}/in/{k}/{name}", f"{folder}/land/{k}.json")
                os.utime(f"{folder}/land/{k}.json", (1000 + k, 1000 + k))
    stream = ingest.read_listings(spark, f"{folder}/land", "event_id long, source_id long, ts timestamp_ntz, outcome string", 1)
    run = ingest.member_states(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c1").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {(r.event_id, r.misses, r.state) for r in state.miss_runs(scan).collect()}
    assert {(r.event_id, r.misses, r.state) for r in spark.read.parquet(f"{folder}/out").collect()} == want
    ingest.upsert_each_batch(stream, f"{folder}/table", ["source_id"], "event_id", f"{folder}/c2").awaitTermination(120)
    last = {(r.source_id, r.event_id) for r in tables.current(spark, f"{folder}/table", stream.schema).collect()}
    assert last == {(r.source_id, r.e) for r in scan.groupBy("source_id").agg(F.max("event_id").alias("e")).collect()}


def landed_stream(spark, batches, schema):
    """A stream of lists of rows, a micro-batch each."""
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema)
        text = "\n".join(r[0] for r in frame.select(F.to_json(F.struct("*"))).collect())
        os.utime(put(folder, f"land/{k}.json", text), (1000 + k, 1000 + k))
    return folder, ingest.read_listings(spark, f"{folder}/land", schema, 1)


def ran(stream, folder, mode="append"):
    stream.writeStream.format("parquet" if mode == "append" else "memory").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)


def test_stream_without_repeats(spark):
    rows = [[("a", "1", "h1", "2024-01-01 00:00:00", 1), ("a", "1", "h1", "2024-01-01 01:00:00", 2)], [("a", "1", "h1", "2024-01-01 05:00:00", 3), ("a", "1", "h2", "2024-01-01 06:00:00", 4), ("b", "1", "h1", "2024-01-01 06:00:00", 5)]]
    folder, stream = landed_stream(spark, rows, "source string, external_id string, hash string, fetched_at string, n int")
    ran(ingest.without_repeats(stream.withColumn("fetched_at", F.to_timestamp("fetched_at")), ["source", "external_id", "hash"]), folder)
    got = [r.n for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(got)[1:] == [4, 5] and sorted(got)[0] in (1, 2)


def test_stream_of_weekly_health(spark):
    """Finished windows hold the counts that a batch over the same days gives."""
    rows = [[(k, 1 + k % 2, "error" if k % 3 == 0 else "click", f"2024-01-{1 + k:02d} 12:00:00") for k in range(part, part + 10)] for part in (0, 10, 20)]
    folder, stream = landed_stream(spark, rows, "event_id int, user_id int, event_type string, ts string")
    ran(ingest.rolling_health(stream.withColumn("ts", F.to_timestamp("ts"))), folder)
    import datetime as d

    days = {(1 + k % 2, "error" if k % 3 == 0 else "click", d.date(2024, 1, 1 + k)) for k in range(30)}
    got = {(r.start.date(), r.source_id): (r.errors, r.warnings) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert len(got) > 20
    for (start, source), counts in got.items():
        inside = [e for s, e, day in days if s == source and start <= day < start + d.timedelta(days=7)]
        assert counts == (inside.count("error"), inside.count("click"))


def test_stream_behind_cursors(spark):
    rows = [[(1, 1, "2024-01-01"), (2, 1, "2024-01-03"), (3, 1, None)], [(4, 2, "2020-01-01"), (5, 1, "2024-01-02")]]
    folder, stream = landed_stream(spark, rows, "n int, source_id int, published_at string")
    cursors = spark.createDataFrame([(1, "2024-01-02")], "source_id int, cursor string")
    ran(ingest.newer_than_cursor(stream, cursors), folder)
    assert sorted(r.n for r in spark.read.parquet(f"{folder}/out").collect()) == [2, 3, 4]


def test_upsert_of_versions(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/t"
    make = lambda rows: spark.createDataFrame(rows, "k long, at int, v string")
    have = lambda: {(r.k, r.v) for r in tables.current(spark, folder, "k long, at int, v string").collect()}
    tables.upsert(make([(k, 1, "a") for k in range(40)]), folder, ["k"], "at", 0, 4)
    tables.upsert(make([(3, 2, "b"), (3, 0, "old"), (99, 1, "new")]), folder, ["k"], "at", 1, 4)
    want = {(k, "a") for k in range(40) if k != 3} | {(3, "b"), (99, "new")}
    assert have() == want
    tables.upsert(make([(3, 2, "b"), (3, 0, "old"), (99, 1, "new")]), folder, ["k"], "at", 1, 4)
    assert have() == want
    tables.upsert(make([]), folder, ["k"], "at", 2, 4)
    tables.upsert(make([(3, 3, "c")]), folder, ["k"], "at", 3, 4)
    assert have() == want - {(3, "b")} | {(3, "c")}
    assert Versions(spark, folder).numbers() == [2, 3] and len(os.listdir(f"{folder}/rows")) <= 12


def test_buckets_follow_the_rows(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/t"
    table = Versions(spark, folder, 100)
    make = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    table.commit(0, {"rows": (make(0, 150, 0), ["k"], "v")})
    few = table.manifest()["rows"]
    table.commit(1, {"rows": (make(100, 1500, 1), ["k"], "v")})
    many = table.manifest()["rows"]
    assert 2 <= len(few) <= 8 and len(many) >= 8 * len(few) / 2 and max(b.rows for b in many) <= 100
    assert sum(b.rows for b in many) == 1500 == table.read("rows", "k long, v int").count()
    assert table.read("rows", "k long, v int").where("v = 0").count() == 100
    table.commit(2, {"rows": (make(7, 8, 2), ["k"], "v"), "other": (make(0, 3, 0), ["k"], "v")})
    kept = {b.path for b in table.manifest()["rows"]} & {b.path for b in many}
    assert len(kept) == len(many) - 1 and table.read("other", "k long, v int").count() == 3
    assert table.read("other", "k long, v int", before=2).count() == 0 and table.read("none", "k long").count() == 0


def test_reports(spark):
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-") + "/r"
    metrics = spark.createDataFrame([("a", 1, 0.5), ("b", None, 2.0)], "kind string, n int, share double")
    tables.report(metrics, folder)
    assert {(r.kind, r.n, r.share) for r in spark.read.schema(metrics.schema).json(folder).collect()} == {("a", 1, 0.5), ("b", None, 2.0)}
    assert {tuple(r) for r in tables.long_form(metrics, ["kind"]).collect()} == {("a", "n", "1"), ("a", "share", "0.5"), ("b", "n", None), ("b", "share", "2.0")}
