"""Profiles of an archive: presence, labels, shapes, time quality, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import AUDIT_PATH, AUDIT_TRAILING, AUDIT_URL, without_trailing
from ..session import checkpointed

# Event types that are known, and the keys that hold identifiers.
TYPES = [
    "USER_TALK",
    "AGENT_TALK",
    "START_USING_COMPUTER",
    "STOP_USING_COMPUTER",
    "WAIT",
    "PAUSE",
    "REQUEST_HUMAN_HELPER",
    "CANCEL_REQUEST_FOR_HUMAN_HELPER",
    "SEARCH_HISTORY",
    "CONSOLIDATE",
]
ID_KEYS = ["agentid", "agent_id", "speakerid", "speaker_id", "instanceid", "instance_id"]


def missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing, total): nulls, and blanks of strings, in one pass over the columns."""
    kinds = dict(rows.dtypes)
    gone = {c: F.col(c).isNull() | (F.col(c) == "") if kinds[c] == "string" else F.col(c).isNull() for c in columns}
    sums = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(v).alias(f"c{i}") for i, v in enumerate(gone.values())])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(columns)])
    return sums.select(F.explode(cells).alias("x"), "total").select("x.field", "x.missing", "total")


def labels(rows: DataFrame, label: str, order: Column) -> DataFrame:
    """Count, first and last order of each label."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def shapes(rows: DataFrame, raw: str = "raw", most: int = 20) -> DataFrame:
    """The most frequent sets of keys of object events."""
    keys = F.array_join(F.array_sort(F.map_keys(F.col(raw).cast("map<string,variant>"))), ",")
    return rows.groupBy(keys.alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape").limit(most)


def id_fields(rows: DataFrame, label: str, raw: str = "raw") -> DataFrame:
    """How many of each label's events carry each identifier key."""
    keys = F.transform(F.map_keys(F.col(raw).cast("map<string,variant>")), F.lower)
    held = rows.select(label, F.explode(F.array_intersect(keys, F.array(*[F.lit(k) for k in ID_KEYS]))).alias("key"))
    return held.groupBy(label, "key").agg(F.count(F.lit(1)).alias("n"))


def ordering(rows: DataFrame, day: str = "date") -> DataFrame:
    """By day: events with a time, adjacent pairs out of order, and ties (one less than each instant's count)."""
    timed = rows.where(F.col("ts").isNotNull())
    before = F.lag("ts").over(Window.partitionBy(day).orderBy("event_index"))
    pairs = timed.withColumn("before", before).groupBy(day).agg(
        F.count(F.lit(1)).alias("timed"), F.count_if(F.col("ts") < F.col("before")).alias("out_of_order"), F.countDistinct("ts").alias("instants")
    )
    return pairs.select(day, "timed", "out_of_order", (F.col("timed") - F.col("instants")).alias("ties"))


def time_quality(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ts_quality").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def links(rows: DataFrame, pattern: str, marks: str | None = None) -> DataFrame:
    """Total and distinct matches of a pattern, the trailing marks cut if there are any."""
    found = rows.select(F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("link"))
    cut = found if marks is None else found.select(without_trailing(F.col("link"), marks).alias("link"))
    return cut.groupBy("link").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")
    )


def url_links(rows: DataFrame) -> DataFrame:
    return links(rows, AUDIT_URL, AUDIT_TRAILING)


def path_links(rows: DataFrame) -> DataFrame:
    """Paths are counted as they stand."""
    return links(rows, AUDIT_PATH)


def objects_with(rows: DataFrame, ident: str, raw: str, keys: list[str]) -> DataFrame:
    """(ident, value) of the objects at any depth of a variant that have all the keys.

    Each round opens the objects and lists of the last; there are as many as the deepest value has levels.
    """
    level = rows.select(ident, F.col(raw).alias("value"))
    found = None
    while True:
        level = checkpointed(level)
        kind = F.schema_of_variant("value")
        held = F.map_keys(F.try_variant_get("value", "$", "map<string,variant>"))
        here = level.where(kind.startswith("OBJECT")).where(F.size(F.array_intersect(held, F.array(*[F.lit(k) for k in keys]))) == len(keys))
        found = here if found is None else found.unionByName(here)
        inside = F.when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get("value", "$", "map<string,variant>")))
        inside = inside.when(kind.startswith("ARRAY"), F.try_variant_get("value", "$", "array<variant>"))
        level = level.select(ident, F.explode(inside).alias("value"))
        level = level.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))
        if level.isEmpty():
            return found


def number_stats(rows: DataFrame, group: str, json: str, path: str) -> DataFrame:
    """Count and mean of a number inside a JSON string, by group; text that does not parse is left out."""
    value = F.try_variant_get(F.try_parse_json(json), path, "double")
    return rows.select(group, value.alias("v")).groupBy(group).agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))
