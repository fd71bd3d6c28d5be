"""Ranges of rows ordered by two numbers, for work on neighbouring rows without a global sort task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_MIN

Split = tuple[int, int]


def splits_of(rows: DataFrame, first: str, second: str, ranges: int) -> list[Split]:
    """At most ``ranges - 1`` approximate quantiles of rows in the order of two long columns, distinct and ascending.

    A split lies before all rows of its first number, unless that number has several quantiles'
    share of the rows; then the second number's quantiles divide it.
    """
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx(first, shares, max(10_000, 20 * ranges)).alias("q")).first()["q"] or []
    heavy = {x: n for x, n in Counter(found).items() if n > 1}
    splits = {(x, LONG_MIN) for x in found if x > LONG_MIN}
    if heavy:
        most = max(heavy.values())
        inner = rows.where(F.col(first).isin(list(heavy))).groupBy(first)
        asked = F.percentile_approx(second, [i / (most + 1) for i in range(1, most + 1)], max(10_000, 20 * most))
        for r in inner.agg(asked.alias("q")).collect():
            some = r["q"][:: max(1, most // heavy[r[first]])]
            splits |= {(r[first], x) for x in some}
    return sorted(splits)


def range_number(splits: list[Split]) -> Callable[[Column, Column], Column]:
    """How many splits are at or below a pair of longs."""
    ids = np.array([x for x, _ in splits], np.int64)
    seconds = np.array([y for _, y in splits], np.int64)

    @F.pandas_udf("int")
    def number(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(), b.to_numpy()
        low, high = np.searchsorted(ids, x, "left"), np.searchsorted(ids, x, "right")
        found = high.copy()
        for at in np.unique(low[low < high]):
            mine = np.flatnonzero((low == at) & (high > at))
            found[mine] = at + np.searchsorted(seconds[at : high[mine[0]]], y[mine], "right")
        return pd.Series(found.astype(np.int32))

    return number


def joined(splits: list[Split], sizes: dict[int, int], least: int) -> list[Split]:
    """Fewer splits: neighbouring ranges joined until each has ``least``; ``sizes`` has the ranges' own."""
    kept, held = [], 0
    for number, split in enumerate(splits):
        held += sizes.get(number, 0)
        if held >= least:
            kept.append(split)
            held = 0
    return kept


def dealing_keys(spark: SparkSession, parts: int) -> list[int]:
    """A number for each partition, which Spark's hash partitioning into ``parts`` puts there; its own where none was found."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = {r["p"]: r["k"] for r in spark.range(24 * parts + 64).groupBy(at.alias("p")).agg(F.min("id").alias("k")).collect()}
    return [found.get(p, p) for p in range(parts)]
