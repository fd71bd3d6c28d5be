"""Nested transcripts, JSON Lines and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, locator
from ..functions.times import instant, quality

DOCUMENT = "days array<struct<day:int,date:string,events:array<variant>>>"
# The event types that are chat.
TALKS = ("AGENT_TALK", "USER_TALK")
MAX_LINE = 8 << 20
MAX_TOTAL = 128 << 20


def days(spark: SparkSession, path: str) -> DataFrame:
    """(day, date, events) of a whole-file transcript."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select(F.inline("days"))


def write_days(rows: DataFrame, path: str) -> None:
    """Write (day, date, event_index, raw) as one JSON document a line, a folder a day: a layout of which one day is read alone."""
    events = F.transform(F.array_sort(F.collect_list(F.struct("event_index", F.coalesce(F.to_json("raw"), F.lit("null")).alias("raw")))), lambda e: e["raw"])
    whole = rows.groupBy("day", "date").agg(events.alias("events"))
    line = F.concat(F.lit('{"date":'), F.to_json(F.array("date")).substr(F.lit(2), F.length(F.to_json(F.array("date"))) - 2), F.lit(',"events":['), F.array_join("events", ","), F.lit("]}"))
    whole.select("day", line.alias("value")).repartition("day").write.partitionBy("day").mode("errorifexists").text(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """(day, date, events) of days written apart; a filter on day reads its folder alone."""
    return spark.read.schema("date string, events array<variant>, day int").json(path).select("day", "date", "events")


def raw_events(days: DataFrame) -> DataFrame:
    """(day, date, event_index, raw): one row an event, whatever its shape."""
    return days.select("day", "date", F.posexplode("events").alias("event_index", "raw"))


def field(name: str, raw: str = "raw") -> Column:
    return F.try_variant_get(F.col(raw), f"$.{name}", "string")


def is_object(raw: str = "raw") -> Column:
    return F.schema_of_variant(F.col(raw)).startswith("OBJECT")


def split_objects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that are objects, and the quarantine of all others, null ones included."""
    good = F.coalesce(is_object(), F.lit(False))
    return raw.where(good), raw.where(~good)


def timeline(raw: DataFrame) -> DataFrame:
    """Canonical events: actor and text by first filled field, instants where the time has a zone."""
    good, _ = split_objects(raw)
    return good.select(
        "day",
        F.to_date("date").alias("date"),
        "event_index",
        field("type").alias("type"),
        first_filled(field("speakerName"), field("agentName"), default="Unknown").alias("actor"),
        first_filled(field("content"), field("message")).alias("text"),
        field("timestamp").alias("ts_raw"),
        instant(field("timestamp")).alias("ts"),
        quality(field("timestamp")).alias("ts_quality"),
        "raw",
    )


def message_index(rows: DataFrame, source_sha: str, talks: tuple[str, ...] = TALKS) -> DataFrame:
    """(id, day, event_index, date, ts_raw, speaker, source_type, text, text_hash) of the talks of a ``timeline``."""
    text = F.coalesce("text", F.lit(""))
    return rows.where(F.col("type").isin(*talks)).select(
        locator(F.lit(source_sha), F.col("day"), F.col("event_index")).alias("id"), "day", "event_index", "date", "ts_raw",
        F.col("actor").alias("speaker"), F.col("type").alias("source_type"), text.alias("text"), F.sha2(text, 256).alias("text_hash"),
    )


def day_index(rows: DataFrame) -> DataFrame:
    """(day, date, n, types) of each day record."""
    return rows.groupBy("day", "date").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("type")).alias("types"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines, plain or gzip, under a given schema; bad lines are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def bounded_lines(spark: SparkSession, path: str, schema: str, max_line: int = MAX_LINE) -> DataFrame:
    """(value, parsed, problem) of each line that is not blank; problem names what is wrong with it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("parsed", parsed)
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull()
    problem = F.when(F.octet_length("value") > max_line, "line too long").when(bad, "not an object of the schema")
    return rows.withColumn("problem", problem)


def bounded_total(lines: DataFrame, most: int = MAX_TOTAL) -> DataFrame:
    """(file, bytes, problem) of the files whose lines (file, value) sum to more than ``most`` bytes."""
    sums = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    return sums.where(F.col("bytes") > most).withColumn("problem", F.lit("file too long"))


def changelog(spark: SparkSession, path: str) -> DataFrame:
    """(position, date, title, notes) of the sections of a Markdown file that are headed by a date."""
    text = spark.read.text(path, wholetext=True)
    parts = text.select(F.posexplode(F.split("value", r"(?m)^## ")).alias("position", "part"))
    heading = F.regexp_extract("part", r"^([^\n]*)", 1)
    return parts.where(heading.rlike(r"^\d{4}-\d{2}-\d{2}")).select(
        "position",
        F.left(heading, F.lit(10)).alias("date"),
        F.trim(F.substring(heading, 11, 1 << 20)).alias("title"),
        F.regexp_replace("part", r"^[^\n]*\n?\s*|\s+$", "").alias("notes"),
    )


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, definition, hypothesis) of the acts; raises where an id or hypothesis is empty or repeated."""
    schema = "acts array<struct<id:string,definition:string,hypothesis:string>>"
    acts = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("acts"))
    sums = acts.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.nullif(F.trim("id"), F.lit(""))).alias("ids"),
        F.countDistinct(F.nullif(F.trim("hypothesis"), F.lit(""))).alias("texts"),
    ).first()
    if not sums["n"] or {sums["ids"], sums["texts"]} != {sums["n"]}:
        raise ValueError("acts need unique, non-empty ids and hypotheses")
    return acts
