import numpy as np
from helpers import awkward
from pyspark.sql import functions as F

from loomline.llm.langid import OVERLAP, WINDOW, identify, predict, windows_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_label_is_no_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    masked = docs.withColumn("lang", F.when(~held, F.col("lang")))
    assert sorted(identify(docs).collect()) == sorted(identify(masked).collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = identify(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 9)] == ["und"] * 4
    assert all(got[i]["lang_pred"] in ("en", "fr") for i in (4, 5, 6, 7, 8, 10, None))
    assert identify(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in predict(docs, None).collect()} == {"und"}


def test_windows_cover_every_byte():
    for n in (0, 1, WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW, 100_003):
        text = bytes(np.random.default_rng(n).integers(65, 90, n, dtype=np.uint8))
        found = windows_of(text)
        joined = b"".join([found[0].tobytes(), *(w[OVERLAP:].tobytes() for w in found[1:])])
        assert joined.rstrip(b" ") == text and len(joined) - n <= WINDOW
