"""Documents for readers: nested rows, compact manifests, one-document results, and a watcher of runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL = ("complete", "incomplete", "interrupted", "paused", "failed", "run_replaced")
MOST_ROWS = 10_000


def message_row(source_sha: str) -> Column:
    """A joined message as the nested row of an export: locator, source digest, text, and prediction or null."""
    locator = F.struct("day", "event_index")
    prediction = F.when(F.col("label").isNotNull(), F.struct("label", "needs_review"))
    return F.struct(
        locator.alias("source_locator"),
        F.lit(source_sha).alias("source_snapshot_sha256"),
        F.col("speaker").alias("speaker_label"),
        F.col("text_hash").alias("text_hash_sha256"),
        F.col("text"),
        prediction.alias("prediction"),
    )


def compacted(rows: DataFrame, bulky: list[str]) -> DataFrame:
    """Rows with the sizes of bulky arrays and maps, under <name>Entries, in their place; null stays null."""
    kept = [F.when(F.col(c).isNotNull(), F.size(c)).alias(f"{c}Entries") if c in bulky else F.col(c) for c in rows.columns]
    return rows.select(*kept)


def document(parts: dict[str, DataFrame], most: int = MOST_ROWS) -> DataFrame:
    """One row ``document``: a JSON object with a sorted array of rows for each part.

    Parts are results of a report, at most ``most`` rows each; more is an error, not a cut.
    """
    whole = None
    for name, rows in parts.items():
        found = rows.limit(most + 1).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in rows.columns]))).alias(name))
        error = F.raise_error(F.lit(f"{name} has more than {most} rows"))
        found = found.select(F.when(F.size(name) > most, error).otherwise(F.col(name)).alias(name))
        whole = found if whole is None else whole.crossJoin(found)  # one row each
    return whole.select(F.to_json(F.struct(*parts)).alias("document"))


def watch(report: Callable[[], dict], *, seconds: float = 30, sleep: Callable[[float], None] = time.sleep, on_poll: Callable[[dict], None] | None = None) -> dict:
    """Poll a report {run_id, state, ...} until its run ends; another run in its place ends it as run_replaced, with the first report's run."""
    if seconds <= 0:
        raise ValueError("the pause between polls must be positive")
    first = seen = report()
    while seen["state"] not in FINAL:
        if on_poll:
            on_poll(seen)
        sleep(seconds)
        seen = report()
        if seen["run_id"] != first["run_id"]:
            return {**first, "state": "run_replaced", "replaced_by": seen["run_id"]}
    return seen
