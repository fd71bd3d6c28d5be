"""Incremental scoring and event-time windows on Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.scoring import Model, lexical_model, predictions


def score_stream(messages: DataFrame, sink: str, checkpoint: str, run: str, model: Model = lexical_model) -> StreamingQuery:
    """Score new texts of a message stream, each hash once, and add them to a Parquet sink.

    The stream's state, not the sink, remembers its hashes. A batch is written under its number in
    the folder of its checkpoint, so a replay overwrites what it wrote; a stopped run resumes from
    the checkpoint. Hashes that other checkpoints have put in the sink before are left out, too.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    scored = predictions(messages.sparkSession.createDataFrame([], "text_hash string, text string"), run, model).schema
    schema = StructType([*scored.fields, StructField("writer", StringType())])

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            others = spark.read.schema(schema).parquet(sink).where((F.col("writer") != writer) & (F.col("run_id") == run))
            batch = batch.join(others.select("text_hash"), "text_hash", "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        predictions(batch, run, model).write.mode("overwrite").parquet(f"{sink}/writer={writer}/batch={number}")

    once = messages.select("text_hash", "text").dropDuplicates(["text_hash"])
    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each actor: events with no pause of ``gap`` between them."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "actor").agg(F.count(F.lit(1)).alias("n"))
    return found.select("actor", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys, as far as the watermark remembers."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """(actor, n, total) of each actor so far, from state."""

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"actor": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("actor").applyInPandasWithState(
        add, "actor long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout
    )


def settled(df: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """An aggregation of a bounded stream after its last batch: every batch writes the whole result in place of the last."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def collect_stream(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, as a table in memory: for tests and small inputs."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


