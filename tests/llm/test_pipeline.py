import corpus_pipeline
from corpus_pipeline import STAGES, drop_near_duplicates, drop_repeated_passages, identify_language, mix_sources, run
from helpers import ENGLISH, awkward
from pyspark.sql import functions as F
from test_packing import check
from test_simhash import variants
from test_suffix_dedup import brute, passages


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark, [*variants(), *passages()])
    columns = sorted(docs.columns)
    kept = identify_language(spark, docs, "")
    assert sorted(kept.columns) == columns
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()

    unique = drop_near_duplicates(spark, kept, "")
    assert sorted(unique.columns) == columns
    found = unique.where(F.col("text") == ENGLISH).collect()
    assert [r["doc_id"] for r in found] == [4]
    assert sum(100 <= (r["doc_id"] or 0) <= 220 and "changed" not in r["text"] for r in unique.collect()) >= 12

    left = drop_repeated_passages(spark, unique, "")
    assert sorted(left.columns) == columns
    digest = {i: n - gone for i, n, gone, _, _ in brute([(r["doc_id"], r["text"]) for r in unique.collect()])}
    for r in left.collect():
        assert digest[r["doc_id"]] <= len(r["text"].encode()) <= digest[r["doc_id"]] + 12
        assert r["n_chars"] == len(r["text"])

    mixed = mix_sources(spark, left, "")
    assert sorted(mixed.columns) == columns
    assert set(r["text"] for r in mixed.collect()) <= set(r["text"] for r in left.collect())


def test_whole_run_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = run(spark, "/root/testdata/sf0.001").collect()
    stage = docs
    for _, f in STAGES[:-1]:
        stage = f(spark, stage, "")
        stage = spark.createDataFrame(stage.collect(), stage.schema)
    check(stage, packed)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert run(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_mix_gives_every_copy_of_repeated_rows(spark):
    from loomline.llm.mixing import mix

    rows = [(1, "five words are in here", "en", "a", 1)] * 900 + [(1, "five words are in here", "fr", "a", 1)] * 100
    rows += [(1, "five words are in here", "en", "b", 1)] * 50 + [(i, f"some other text number {i}", "en", "b", 1) for i in range(2, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["source_size"]: r["n"] for r in mix(docs, whole_documents=True).groupBy("source_size").agg(F.expr("sum(taken div size)").alias("n")).collect()}
    got = {(r["source"], r["lang"] if r["doc_id"] == 1 else ""): r["count"] for r in mix_sources(spark, docs, "").groupBy("source", "lang", F.when(F.col("doc_id") == 1, 1).alias("doc_id")).count().collect()}
    a = got["a", "en"] + got["a", "fr"]
    assert a == want[5000] and abs(got["a", "fr"] - a / 10) <= 2
    assert sum(v for k, v in got.items() if k[0] == "b") == want[50 * 5 + 2998 * 5]


def test_near_duplicate_stage_keeps_recall(spark):
    """Of unequal near pairs at least nine tenths lose one document, and no other document goes."""
    from test_near_texts import near

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kept = {r["doc_id"] for r in drop_near_duplicates(spark, docs, "").collect()}
    pairs = near(texts)
    unequal = [p for p in pairs if texts[p[0]] != texts[p[1]]]
    assert sum(not (i in kept and j in kept) for i, j in unequal) >= 0.9 * len(unequal)
    assert set(texts) - kept <= {x for p in pairs for x in p}
