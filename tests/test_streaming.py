from pyspark.sql import functions as F

from loomline.operators.scoring import predictions
from loomline.sources.tables import messages, timeline
from loomline.streaming import live

FOLDER = "/root/testdata/sf0.001"


def as_stream(spark, df, path, files=1):
    df.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_scoring_resumes_and_adds_each_hash_once(spark, tmp_path):
    rows = messages(spark, FOLDER).select("text_hash", "text")
    first, source, sink = rows.limit(20), str(tmp_path / "in"), str(tmp_path / "out")
    for part in (first, rows, rows):
        live.score_stream(as_stream(spark, part, source, 2), sink, str(tmp_path / "ck"), "r").awaitTermination()
    got = spark.read.parquet(sink)
    assert got.count() == rows.select("text_hash").distinct().count() == got.select("text_hash").distinct().count()
    want = predictions(rows, "r").select("text_hash", "label")
    assert got.select("text_hash", "label").exceptAll(want).isEmpty()


def test_windows_match_the_batch(spark, tmp_path):
    rows = timeline(spark, FOLDER)
    stream = as_stream(spark, rows, str(tmp_path / "ev"))
    got = live.collect_stream(spark, live.windowed(stream, "6 hours"), "w", "complete")
    want = rows.groupBy(F.window("ts", "6 hours")["start"].alias("start"), "type").agg(F.count(F.lit(1)).alias("n"))
    assert got.select("start", "type", "n").exceptAll(want).isEmpty() and got.count() == want.count()


def test_state_and_repeats(spark, tmp_path):
    rows = timeline(spark, FOLDER)
    rows.write.parquet(str(tmp_path / "ev"))
    rows.write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    once = live.collect_stream(spark, live.once(stream, ["event_id"], "400 days"), "o")
    assert once.count() == rows.count()
    totals = live.collect_stream(spark, live.running_totals(stream.select("actor", "value")), "t", "update")
    assert {r["actor"]: r["n"] for r in totals.collect()} == {r["actor"]: 2 * r["count"] for r in rows.groupBy("actor").count().collect()}
