"""The message index: search, status, coverage, pending work, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import all_of
from .rules import require_snapshot

PAGE = 100


@dataclass(frozen=True)
class Search:
    """Parameters of a page of messages; None leaves a filter out. The limit is held to 1..100, the offset to 0 and more."""

    day: int | None = None
    speaker: str | None = None
    label: str | None = None
    message: int | None = None
    needle: str | None = None
    review: bool = False
    pending: bool = False
    limit: int = 30
    offset: int = 0


def with_predictions(messages: DataFrame, predictions: DataFrame, run_id: str) -> DataFrame:
    """All messages, with the predictions of one run: other runs stay invisible."""
    own = predictions.where(F.col("run_id") == run_id).drop("run_id")
    return messages.join(own, "text_hash", "left")


def search(messages: DataFrame, predictions: DataFrame, run_id: str, s: Search) -> tuple[DataFrame, DataFrame]:
    """The page in order of (day, event_index), and the one-row total of all that match."""
    wanted: list[Column] = []
    for name, value in (("day", s.day), ("speaker", s.speaker), ("label", s.label), ("event_index", s.message)):
        if value is not None:
            wanted.append(F.col(name) == F.lit(value))
    if s.needle:
        wanted.append(F.instr(F.lower("text"), s.needle.lower()) > 0)
    if s.review:
        wanted.append(F.col("needs_review") == 1)
    if s.pending:
        wanted.append(F.col("label").isNull())
    found = with_predictions(messages, predictions, run_id).where(all_of(wanted))
    page = found.orderBy("day", "event_index").offset(max(0, s.offset)).limit(min(PAGE, max(1, s.limit)))
    return page, found.agg(F.count(F.lit(1)).alias("total"))


def holds(needle: str, raw: Column) -> Column:
    """Whether an event's JSON text, or any string value at its top level as it reads, holds the needle in any case of letters."""
    values = F.map_values(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"))
    strings = F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    wanted = needle.strip().lower()
    return F.lower(raw).contains(wanted) | F.coalesce(F.exists(strings, lambda v: F.lower(v).contains(wanted)), F.lit(False))


def event_search(
    rows: DataFrame,
    *,
    day: object = None,
    kind: str | None = None,
    actor: object = None,
    event_index: int | None = None,
    needle: str | None = None,
    raw: Column | None = None,
    snapshot: tuple[str, str] | None = None,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A page of 100 events by date and ordinal, and the one-row total of all that match.

    ``raw`` is the event as JSON, by default made of the row. ``snapshot`` has the digest that a link
    names and the source's own; where they differ the search is refused.
    """
    if snapshot is not None:
        require_snapshot(*snapshot)
    wanted = []
    for name, value in (("date", day), ("type", kind or None), ("actor", actor), ("event_index", event_index)):
        if value is not None:
            wanted.append(F.col(name) == F.lit(value))
    if needle and needle.strip():
        wanted.append(holds(needle, raw if raw is not None else F.to_json(F.struct("*"))))
    found = rows.where(all_of(wanted))
    return found.orderBy("date", "event_index").offset(max(0, offset)).limit(PAGE), found.agg(F.count(F.lit(1)).alias("total"))


def event_page(rows: DataFrame, **wanted: object) -> DataFrame:
    """The page alone of ``event_search``."""
    return event_search(rows, **wanted)[0]


def around(rows: DataFrame, targets: DataFrame, reach: int = 2) -> DataFrame:
    """Events within ``reach`` ordinals of each target (date, event_index), by an equality join."""
    spread = targets.select("date", F.col("event_index").alias("target"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o"))
    return spread.withColumn("event_index", F.col("target") + F.col("o")).drop("o").join(rows, ["date", "event_index"])


def pending(messages: DataFrame, predictions: DataFrame, run_id: str) -> DataFrame:
    """Texts without a prediction of the run: (text_hash, day, event_index), each least by itself."""
    done = predictions.where(F.col("run_id") == run_id).select("text_hash")
    left = messages.select("text_hash", "day", "event_index").join(done, "text_hash", "left_anti")
    return left.groupBy("text_hash").agg(F.min("day").alias("day"), F.min("event_index").alias("event_index"))


def pending_texts(messages: DataFrame, predictions: DataFrame, run_id: str) -> DataFrame:
    """``pending`` with the text of each hash, for export."""
    return messages.groupBy("text_hash").agg(F.min("text").alias("text")).join(pending(messages, predictions, run_id), "text_hash")


def label_totals(messages: DataFrame, predictions: DataFrame, run_id: str) -> DataFrame:
    """By label, most first: source records, and how many need review or were truncated."""
    own = predictions.where(F.col("run_id") == run_id)
    joined = messages.select("text_hash").join(own, "text_hash")
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), total("needs_review"), total("truncated")).orderBy(F.desc("n"), "label")


def untagged(predictions: DataFrame, run_id: str, result: str = "result") -> DataFrame:
    """One row: how many predictions of a run do not name the epoch that made them."""
    own = predictions.where(F.col("run_id") == run_id)
    return own.agg(F.count_if(~F.col(result).contains('"execution_epoch_id"')).alias("untagged"))


def label_counts(messages: DataFrame, predictions: DataFrame, run_id: str) -> DataFrame:
    """By label: source records, unique texts, and records that need review."""
    own = predictions.where(F.col("run_id") == run_id)
    joined = messages.select("text_hash").join(own, "text_hash")
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("text_hash").alias("texts"), F.sum(F.col("needs_review").cast("long")).alias("review")
    )


def coverage(messages: DataFrame, predictions: DataFrame, run_id: str) -> DataFrame:
    """Records and unique texts, in all and classified, with shares; 0 on an empty index."""
    done = predictions.where(F.col("run_id") == run_id).select("text_hash", F.lit(1).alias("done"))
    per_text = messages.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).join(done, "text_hash", "left")
    sums = per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count(F.lit(1)).alias("texts"),
        F.coalesce(F.sum(F.col("n") * F.col("done")), F.lit(0)).alias("classified_records"),
        F.count("done").alias("classified_texts"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return sums.select(
        "*", share("classified_records", "records").alias("record_share"), share("classified_texts", "texts").alias("text_share")
    )


def report_samples(messages: DataFrame, predictions: DataFrame, run_id: str, *, per_label: int = 2, most: int = 24) -> DataFrame:
    """The earliest ``per_label`` classified texts of each label, each hash once, at most ``most`` in label order."""
    own = predictions.where(F.col("run_id") == run_id).select("text_hash", "label")
    first = messages.groupBy("text_hash").agg(F.min(F.struct("day", "event_index")).alias("at")).join(own, "text_hash")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("at"))
    rows = first.withColumn("rank", rank).where(F.col("rank") <= per_label)
    return rows.orderBy("label", "rank").limit(most).select("label", F.col("rank").cast("long").alias("rank"), "at.day", "at.event_index", "text_hash")


def remaining_seconds(done_now: Column, rate: Column, total: Column, done: Column, least: int = 32) -> Column:
    """Seconds that a run still needs at its rate; null before ``least`` texts of this session, and without a rate."""
    return F.when((done_now >= least) & (rate > 0), F.round(F.greatest(F.lit(0), total - done) / rate).cast("long"))


def run_state(recorded: Column, remaining: Column, alive: Column, same_run: Column) -> Column:
    """State of a run: replaced by another, incomplete or interrupted where the record is out of date."""
    return (
        F.when(~same_run, "run_replaced")
        .when((recorded == "complete") & (remaining > 0), "incomplete")
        .when((recorded == "running") & ~alive, "interrupted")
        .otherwise(recorded)
    )
