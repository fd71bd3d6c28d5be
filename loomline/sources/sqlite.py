"""SQLite tables, read as they stood at one moment."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession

BATCH = 50_000


def snapshot(spark: SparkSession, path: str, tables: dict[str, str], folder: str, batch: int = BATCH) -> dict[str, DataFrame]:
    """Tables of a database as DataFrames, from one read transaction; ``tables`` has a schema for each.

    The file is opened read-only. Rows stream through the driver, ``batch`` at a time, into Parquet
    in ``folder``, which must not exist for the table; executors read that and never the database.
    """
    source = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        source.execute("PRAGMA query_only = ON")
        source.execute("BEGIN")
        found = {}
        for name, schema in tables.items():
            empty = spark.createDataFrame([], schema)
            empty.write.mode("errorifexists").parquet(f"{folder}/{name}")
            names = ", ".join('"' + c.replace('"', '""') + '"' for c in empty.columns)
            table = '"' + name.replace('"', '""') + '"'
            rows = source.execute(f"SELECT {names} FROM {table}")
            while part := rows.fetchmany(batch):
                spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/{name}")
            found[name] = spark.read.schema(empty.schema).parquet(f"{folder}/{name}")
        return found
    finally:
        source.close()
