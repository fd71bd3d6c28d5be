"""Comparison of two scoring runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key, as structs l and r; null where a side lacks the key."""
    a = left.select(F.col(key).alias(key), F.struct("*").alias("l"))
    b = right.select(F.col(key).alias(key), F.struct("*").alias("r"))
    return a.join(b, key, "full_outer")


def key_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    side = F.when(F.col("r").isNull(), "left only").when(F.col("l").isNull(), "right only")
    return matched(left, right, key).select(key, side.alias("side")).where(F.col("side").isNotNull())


def top(scores: Column) -> Column:
    """Zero-based place of the greatest score of an array; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def report(left: DataFrame, right: DataFrame, key: str, scores: str) -> DataFrame:
    """One row: pairs, greatest and mean absolute difference, and how many tops agree.

    Raises, when it runs, on a key that one side lacks: rows are never dropped.
    """
    both = matched(left, right, key)
    whole = F.when(F.col("l").isNull() | F.col("r").isNull(), F.raise_error(F.lit("the two runs have different keys"))).otherwise(F.lit(True))
    rows = both.where(whole).select(
        F.zip_with(F.col("l")[scores], F.col("r")[scores], lambda a, b: F.abs(a - b)).alias("d"),
        (top(F.col("l")[scores]) == top(F.col("r")[scores])).alias("same"),
    )
    per_row = rows.select("same", F.array_max("d").alias("most"), F.aggregate("d", F.lit(0.0), lambda x, y: x + y).alias("s"), F.size("d").alias("k"))
    return per_row.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(F.max("most"), 6).alias("max_delta"),
        F.round(F.sum("s") / F.sum("k"), 6).alias("mean_delta"),
        F.count_if("same").alias("same_top"),
    )


def approved(summary: Column, *, least: int = 48, most_delta: float = 0.02) -> Column:
    """Whether a report row allows an import: enough pairs, every top the same, no great difference."""
    return (summary["pairs"] >= least) & (summary["same_top"] == summary["pairs"]) & (summary["max_delta"] <= most_delta)


def label_changes(rows: DataFrame, base: str, others: list[str]) -> DataFrame:
    """(condition, targets, changed): top labels that differ from the base condition of the same target."""
    wide = rows.groupBy("target").pivot("condition", [base, *others]).agg(F.first("label"))
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), (~F.col(c).eqNullSafe(F.col(base))).alias("x")) for c in others])
    return wide.select(F.explode(cells).alias("c")).groupBy("c.condition").agg(F.count(F.lit(1)).alias("targets"), F.count_if("c.x").alias("changed"))


def common_metadata(rows: DataFrame) -> DataFrame:
    """(key, value) that every shard's map has alike; ``rows`` has shard and metadata."""
    total = rows.agg(F.countDistinct("shard").alias("total"))
    cells = rows.select("shard", F.explode("metadata"))
    same = cells.groupBy("key").agg(F.countDistinct("value").alias("v"), F.countDistinct("shard").alias("s"), F.min("value").alias("value"))
    return same.join(F.broadcast(total), (F.col("s") == F.col("total")) & (F.col("v") == 1)).select("key", "value")


def throughput(rows: DataFrame) -> DataFrame:
    """Sums over shards and rows a second, null for no time."""
    sums = rows.agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"))
    return sums.withColumn("per_second", F.try_divide("rows", "seconds"))
