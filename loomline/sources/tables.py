"""Columnar tables, and their views as timeline, messages and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """(date, event_id, ts, type, actor, value, props) of the events table."""
    return table(spark, folder, "events").select(
        F.to_date("ts").alias("date"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("actor"),
        "value",
        "props",
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``timeline`` as a stream of the files that there are."""
    source = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/event[s].parquet")
    return source.select(
        F.to_date("ts").alias("date"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").alias("actor"), "value", "props"
    )


def indexed(rows: DataFrame) -> DataFrame:
    """The zero-based ordinal of each event within its date."""
    return rows.withColumn("event_index", F.row_number().over(Window.partitionBy("date").orderBy("ts", "event_id")) - 1)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(day, event_index, speaker, source_type, text, text_hash) of the conversations."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("day"),
        F.col("turn").alias("event_index"),
        F.col("role").alias("speaker"),
        F.when(F.col("role") == "user", "USER_TALK").otherwise("AGENT_TALK").alias("source_type"),
        "text",
        F.sha2("text", 256).alias("text_hash"),
    )


def document_messages(spark: SparkSession, folder: str, per_day: int = 50) -> DataFrame:
    """Documents as messages: ``per_day`` ids make a day, the source is the speaker."""
    return table(spark, folder, "documents").select(
        F.expr(f"doc_id div {per_day}").alias("day"),
        F.col("doc_id").alias("event_index"),
        F.col("source").alias("speaker"),
        "lang",
        "text",
        F.sha2("text", 256).alias("text_hash"),
    )


def document_predictions(spark: SparkSession, folder: str, run_id: str = "run-a") -> DataFrame:
    """Labels as predictions, one a text hash: the label of the smallest document id."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    rows = docs.join(table(spark, folder, "labels"), "doc_id")
    first = rows.groupBy("text_hash").agg(F.min_by(F.struct("quality", "toxic"), "doc_id").alias("v"))
    label = F.concat(F.lit("q"), F.col("v.quality").cast("string"))
    return first.select(F.lit(run_id).alias("run_id"), "text_hash", label.alias("label"), F.col("v.toxic").alias("needs_review"))
