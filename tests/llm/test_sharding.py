from collections import defaultdict

import numpy as np
from helpers import awkward
from pyspark.sql import functions as F

from loomline.llm.queries import op3_sampled_splitters
from loomline.llm.sharding import quantile_splits, range_of, shard


def place(docs, **more):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return shard(docs, key=F.xxhash64(F.coalesce("text", F.lit(""))), size=size, ident="doc_id", **more).collect()


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sizes_near_equal_and_groups_together(spark):
    rows = op3_sampled_splitters(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and gapless(rows)
    sizes, groups = defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8
    assert max(abs(x - mean) for x in sizes.values()) <= 0.05 * mean + max(r["size"] for r in rows)
    assert all(len(g) == 1 for g in groups.values())


def test_hot_key_is_divided(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    rows = place(docs)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(rows) == 4000 and gapless(rows)
    assert max(abs(x - mean) for x in sizes.values()) < 0.06 * mean


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    rows = place(docs)
    assert len(rows) == docs.count() and gapless(rows)
    assert place(docs.limit(0)) == []


def test_quantile_splits_keep_keys_whole_unless_hot():
    sample = [(k, i, 1.0) for k in range(4) for i in range(25)]
    assert quantile_splits(sample, 4) == [(1, -(1 << 63)), (2, -(1 << 63)), (3, -(1 << 63))]
    hot = [(5, i, 1.0) for i in range(100)]
    assert quantile_splits(hot, 4) == [(5, -(1 << 63)), (5, 50), (5, 75)]
    assert quantile_splits([], 4) == []


def test_range_of_counts_splitters(spark):
    rng = np.random.default_rng(2)
    splits = sorted({(int(k), int(i)) for k, i in zip(rng.integers(-50, 50, 300), rng.integers(-9, 9, 300))})
    rows = [(int(k), int(i)) for k, i in zip(rng.integers(-60, 60, 1000), rng.integers(-10, 10, 1000))]
    for some in (splits, splits[:64], splits[:65], splits[:1], []):
        got = spark.createDataFrame(rows, "_key long, _id long").withColumn("r", range_of(some)).collect()
        assert all(r["r"] == sum(s <= (r["_key"], r["_id"]) for s in some) for r in got)


def test_many_ranges(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3000).alias("text"))
    rows = place(docs, rows_per_range=10)
    assert len(rows) == 5000 and gapless(rows)
    sizes, groups = defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        groups[(r["doc_id"] % 3000)].add(r["shard"])
    assert max(sizes.values()) - min(sizes.values()) < 100 and all(len(g) == 1 for g in groups.values())
