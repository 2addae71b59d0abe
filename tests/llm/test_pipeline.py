import corpus_pipeline as P

from spindrift.llm import mixing, ngram_join, registry, secrets, sentencepiece_bpe

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = spark.createDataFrame(P.language_id(spark, docs, SF).toPandas(), docs.schema)
    assert kept.columns == columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert all(not any(c.isalpha() for c in r.text or "") for r in docs.collect() if r.doc_id in gone)
    single = P.near_duplicates(spark, kept, SF)
    assert single.columns == columns
    want = {r.doc_id for r in ngram_join.similar_components(kept).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in single.collect()} == want
    clean = spark.createDataFrame(P.secret_scan(spark, single, SF).toPandas(), docs.schema)
    before = {r.doc_id: r.text for r in single.collect()}
    model = secrets.train(words=secrets.learn_words(single))
    for r in clean.collect():
        found = secrets.found_in(before[r.doc_id], model)
        assert r.text == secrets.masked(before[r.doc_id], found) and r.n_chars == len(r.text)
    mixed = P.mix(spark, clean, SF)
    assert mixed.columns == columns
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(clean).collect()}
    ids = [r.doc_id for r in mixed.collect()]
    assert all(ids.count(i) == n for i, n in copies.items())
    out = P.tokens(spark, mixed, SF).collect()
    table = sentencepiece_bpe.model(registry.tokenizer_path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in clean.collect()}
    assert len(out) == len(ids) and all(r.n_tokens == len(table.encode(text[r.doc_id])) for r in out[:40])


def test_run(spark):
    assert P.run(spark, SF).count() > 100 and [name for name, _ in P.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mix", "tokens"]


def test_columns_of_any_name(spark):
    """Extra columns, named like those that operators use, go through all stages but the last."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["score", "lang_pred", "spans", "masked", "secrets", "n_secrets", "__id", "__copies", "id", "size", "component_id", "copies", "rank", "place"]
    docs = docs.select("*", *[F.concat(F.lit(f"{x}-"), F.col("doc_id").cast("string")).alias(x) for x in names])
    for name, stage in P.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == names, name
    rows = docs.collect()
    assert rows and all(r[x] == f"{x}-{r.doc_id}" for r in rows for x in names)
    assert P.tokens(spark, docs, SF).count() == len(rows)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < -1")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_nulls_ties_and_long_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "words of a text without an id", "en", "a", 29), (2, "", "en", "a", 0), (3, "w " * 200_000, "en", None, 400_000), (4, "one two three four five six", None, "b", 27), (4, "one two three four five six", None, "b", 27), (5, "One two three four five six", "en", "a", 27), (6, "...", None, "b", 3)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        ids = [r.doc_id for r in docs.collect()]
        if name == "language_id":
            assert sorted(ids, key=str) == [3, 4, 4, 5, None]
        if name == "near_duplicates":
            assert sorted(ids, key=str) == [3, 4, None]
    assert set(ids) <= {3, 4, None} and ids


def test_run_leaves_its_result_only(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/*"))
    assert P.run(spark, SF).count() > 0
    new = set(glob.glob(f"{folder}/*")) - before
    assert len(new) == 1 and [x.rsplit("/", 1)[1] for x in glob.glob(f"{new.pop()}/*")] == ["tokens"]
