from collections import defaultdict

import duckdb
import pytest
from helpers import awkward
from pyspark.sql import functions as F

from loomline.llm.mixing import CYCLE, MIX_SQL, mix, numbered, source_targets


def filled(sizes, cycle=CYCLE, epochs=3):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > epochs * sizes[s]} if total else set()
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, "c": 5, None: 3}, {"a": 1, "b": 0, "c": 900, "d": 2, "e": 77}, {"z": 4}, {"a": 0, "b": 0}]
)
def test_targets(spark, sizes):
    given = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(given).collect()}
    assert got == pytest.approx(filled(sizes))


def test_taken(spark):
    docs = awkward(spark)
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    per, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source_size"], r["target"]] += r["taken"]
        target[r["source_size"], r["target"]] = r["target"]
    assert all(abs(per[k] - target[k]) <= 1 for k in per)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert mix(docs.limit(0)).collect() == []
    whole = mix(docs, whole_documents=True).collect()
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in whole)


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((r[0], r[1], r[4]) for r in con.sql(MIX_SQL).fetchall())
    got = mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in got) == want


def test_null_and_equal_ids_agree_between_runs_and_are_drawn_apart(spark):
    rows = [(None, "w " * (1 + i % 50), "a") for i in range(2000)] + [(7, "one text of five words", "a")] * 5000
    rows += [(i, "other words here", "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mix(docs).collect()
    assert sorted(map(str, first)) == sorted(map(str, mix(docs.repartition(7)).collect()))
    assert len(first) == len(rows)
    # The rows of one id fall on both sides of the selection.
    assert len({r["taken"] for r in first if r["doc_id"] == 7}) >= 2
    assert len({r["taken"] for r in first if r["doc_id"] is None and r["size"] == 9}) == 2


def test_repeated_rows_are_numbered_without_gaps(spark):
    rows = spark.createDataFrame([(1, "x")] * 10_000 + [(2, None)] * 4096 + [(None, "y")], "id long, t string")
    got = numbered(rows).groupBy("id", "t").agg(F.count("_copy"), F.min("_copy"), F.max("_copy"), F.countDistinct("_copy")).collect()
    assert {tuple(r) for r in got} == {(1, "x", 10_000, 0, 9999, 10_000), (2, None, 4096, 0, 4095, 4096), (None, "y", 1, 0, 0, 1)}


def test_same_as_sql_with_repeats(spark):
    docs = awkward(spark).select("doc_id", "text", "source")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(str, ((r[0], r[1], r[4]) for r in con.sql(MIX_SQL).fetchall())))
    assert sorted(str((r["doc_id"], r["size"], r["taken"])) for r in mix(docs).collect()) == want
