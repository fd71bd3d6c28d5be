"""Sharding by sampled splitters.

A size-weighted sample of keys gives the quantile boundaries of many small key ranges; rows are
range-partitioned by them, ranges that turn out overfull are subdivided by a second sample, and
runs of ranges make the shards. Only DataFrame operations are used, and a text never leaves the
scan: what is shuffled is (id, key, size).
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LONG_MIN, checkpoint, literal_array, unit_hash

MAX_SPLIT_ROUNDS = 4
#: Ranges beyond the least number are added for so many rows each, up to the most the driver plans.
ROWS_PER_RANGE = 250_000
MAX_RANGES = 4096
#: Splitters that are compared at a time.
CHUNK = 64


def _count_below(keys: Column, ids: Column, shift: Column) -> Column:
    """How many of the splitters (key, id), of which ``keys`` has some and ``ids`` has all from ``shift`` on, are at or before a row."""
    key, ident = F.col("_key"), F.col("_id")
    return F.size(F.filter(keys, lambda k, j: (k < key) | ((k == key) & (F.get(ids, j + shift) <= ident))))


def range_of(splits: list[tuple[int, int]]) -> Column:
    """The number of ascending splitters at or before a row's (key, id): over chunks of them, then in one chunk."""
    if not splits:
        return F.lit(0)
    keys, ids = (literal_array([s[n] for s in splits], "long") for n in (0, 1))
    heads = splits[::CHUNK]
    chunk = _count_below(literal_array([k for k, _ in heads], "long"), literal_array([i for _, i in heads], "long"), F.lit(0)) - 1
    inside = _count_below(F.slice(keys, chunk * CHUNK + 1, F.lit(CHUNK)), ids, chunk * CHUNK)
    return F.when(chunk < 0, F.lit(0)).otherwise(chunk * CHUNK + inside)


def quantile_splits(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """``parts - 1`` weighted quantiles of sampled (key, id, weight) rows.

    A splitter falls on the start of its key, so that equal keys stay together; only a key that
    several quantiles hit is divided, by id.
    """
    rows = sorted(sample)
    if not rows or parts < 2:
        return []
    ends = list(accumulate(w for _, _, w in rows))
    hits = [rows[min(len(rows) - 1, bisect_right(ends, ends[-1] * i / parts))] for i in range(1, parts)]
    splits: list[tuple[int, int]] = []
    for key, ident, _ in hits:
        splits.append((key, ident if splits and splits[-1][0] == key else LONG_MIN))
    return sorted(set(splits))


def _sample(rows: DataFrame, expected: float, seed: int) -> list[tuple[int, int, float]]:
    """Poisson sample in proportion to ``_weight`` (which sums to 1): about ``expected`` rows."""
    rate = F.col("_weight") * F.lit(float(expected))
    drawn = rows.where(unit_hash(F.lit(seed), "_key", "_id") < rate)
    return [tuple(r) for r in drawn.select("_key", "_id", F.greatest(rate, F.lit(1.0))).collect()]


def shard(
    docs: DataFrame,
    *,
    key: Column,
    size: Column,
    ident: str,
    carry: dict[str, Column] | None = None,
    shards: int = 8,
    ranges_per_shard: int = 16,
    samples_per_range: int = 32,
    rows_per_range: int = ROWS_PER_RANGE,
    tolerance: float = 0.05,
    seed: int = 3,
) -> DataFrame:
    """Deal rows into ``shards`` runs of the order (key, id), of near equal total ``size``.

    Returns ``ident``, ``size``, the ``carry`` columns, ``shard`` and ``slot`` (gapless from 0 in
    each shard). Rows of one key share a shard unless their sizes together exceed ``tolerance`` of
    a shard; such groups are divided by id. So no shard differs from the mean by more than
    ``tolerance`` of it, or by the largest single row if that is more. There are
    ``shards * ranges_per_shard`` ranges, or for a large table one for ``rows_per_range`` rows up
    to ``MAX_RANGES``; the driver holds at most about ``2 * samples_per_range`` sampled keys a range.

    A null id counts as the least; repeated rows each take a slot; an empty table gives no rows;
    further columns of the input, whatever their names, are not read.
    """
    carry = carry or {}
    names = {n: f"_carry_{i}" for i, n in enumerate(carry)}
    rows = docs.select(
        F.coalesce(F.col(ident).cast("long"), F.lit(LONG_MIN)).alias("_id"),
        F.col(ident).alias("_ident"),
        key.cast("long").alias("_key"),
        size.cast("long").alias("_size"),
        *[c.alias(names[n]) for n, c in carry.items()],
    )
    rows = checkpoint(rows)
    total, count = rows.agg(F.sum("_size"), F.count(F.lit(1))).first()
    total, count = total or 0, count or 0
    weight = (F.col("_size") / F.lit(float(max(total, 1))) + F.lit(1.0 / max(count, 1))) / 2
    rows = rows.withColumn("_weight", weight)

    parts = max(shards * ranges_per_shard, min(MAX_RANGES, count // rows_per_range))
    splits = quantile_splits(_sample(rows, parts * samples_per_range, seed), parts)
    for again in range(MAX_SPLIT_ROUNDS + 1):
        ranged = rows.withColumn("_range", range_of(splits))
        stats = ranged.groupBy("_range").agg(
            F.sum("_weight").alias("w"), F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")
        )
        stats = {r["_range"]: r for r in stats.collect()}
        overfull = {k: r["w"] for k, r in stats.items() if r["w"] > 2.0 / parts and r["n"] > 1}
        if not overfull or again == MAX_SPLIT_ROUNDS:
            break
        share = sum(overfull.values())
        inside = ranged.where(F.col("_range").isin(list(overfull)))
        finer = _sample(inside, samples_per_range * parts * max(1.0, 1 / (parts * share)), seed + 1 + again)
        by_range: dict[int, list] = {}
        for x in finer:
            by_range.setdefault(bisect_right(splits, x[:2]), []).append(x)
        found = [s for k, v in by_range.items() for s in quantile_splits(v, 1 + round(overfull.get(k, 0) * parts))]
        grown = sorted({*splits, *found})
        if len(grown) == len(splits):
            break
        splits = grown

    n_ranges = len(splits) + 1
    sizes = [stats[k]["b"] if k in stats else 0 for k in range(n_ranges)]
    counts = [stats[k]["n"] if k in stats else 0 for k in range(n_ranges)]
    first_byte = literal_array([0, *accumulate(sizes)][:-1], "long")
    first_rank = literal_array([0, *accumulate(counts)][:-1], "long")

    order = Window.partitionBy("_range").orderBy("_key", "_id")
    group = Window.partitionBy("_range", "_key")
    placed = (
        ranged.withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rank", F.row_number().over(order).cast("long") - 1 + F.get(first_rank, F.col("_range")))
        .withColumn("_group_end", F.max("_end").over(group))
        .withColumn("_group", F.sum("_size").over(group))
    )
    whole = F.col("_group") <= F.lit(tolerance * max(total, 1) / shards)
    middle = F.when(whole, F.col("_group_end") - F.col("_group") / 2).otherwise(F.col("_end") - F.col("_size") / 2)
    at = F.floor((middle + F.get(first_byte, F.col("_range"))) * shards / F.lit(float(max(total, 1))))
    placed = placed.withColumn("_shard", F.least(at, F.lit(shards - 1)).cast("int"))

    members = {r["_shard"]: r["n"] for r in placed.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = literal_array([0, *accumulate(members.get(s, 0) for s in range(shards))][:-1], "long")
    return placed.select(
        F.col("_ident").alias(ident),
        F.col("_size").alias("size"),
        *[F.col(names[n]).alias(n) for n in carry],
        F.col("_shard").alias("shard"),
        (F.col("_rank") - F.get(starts, F.col("_shard"))).alias("slot"),
    )
