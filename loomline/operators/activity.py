"""Activity of days: counts, concentration, entropy, shifts between days, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_url, urls
from ..functions.times import minutes_between


def daily_activity(rows: DataFrame, day: str = "date") -> DataFrame:
    """(day, events, active, effective_actors): counts by day and the inverse sum of squared shares."""
    per = rows.groupBy(day, "actor").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(day).agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("active"),
        F.round(F.pow(F.sum("n"), F.lit(2.0)) / F.sum(F.pow("n", F.lit(2.0))), 4).alias("effective_actors"),
    )


def talk_concentration(rows: DataFrame, talk: Column, day: str = "date", digits: int = 2) -> DataFrame:
    """(day, events, messages, active, effective_speakers): the inverse sum of squared shares of the talks, null on a day without."""
    per = rows.groupBy(day, "actor").agg(F.count(F.lit(1)).alias("n"), F.count_if(talk).alias("k"))
    squares = F.sum(F.pow("k", F.lit(2.0)))
    return per.groupBy(day).agg(
        F.sum("n").alias("events"),
        F.sum("k").alias("messages"),
        F.count_if(F.col("k") > 0).alias("active"),
        F.round(F.when(F.sum("k") > 0, F.pow(F.sum("k"), F.lit(2.0)) / squares), digits).alias("effective_speakers"),
    )


def type_counts(rows: DataFrame, day: str = "date") -> DataFrame:
    return rows.groupBy(day, "type").agg(F.count(F.lit(1)).alias("n"))


def type_rollup(rows: DataFrame) -> DataFrame:
    """Counts by month and type, by month, and in all."""
    month = rows.select(F.date_format("date", "yyyy-MM").alias("month"), "type")
    return month.rollup("month", "type").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def entropy(counts: DataFrame, day: str = "date") -> DataFrame:
    """Shannon entropy, natural logarithm, of the type mix of each day."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(day))
    return counts.withColumn("p", share).groupBy(day).agg(F.round(-F.sum(F.col("p") * F.ln("p")), 6).alias("entropy"))


def _term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) / 2


def shifts(counts: DataFrame, day: str = "date", least: int = 100, digits: int = 4) -> DataFrame:
    """(day, previous, score): Jensen-Shannon divergence from the last day that also has ``least`` events.

    Types are few, so each qualifying day is spread over all types and lagged by type.
    """
    totals = counts.groupBy(day).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    lagged = Window.orderBy(day)
    totals = totals.withColumn("previous", F.lag(day).over(lagged)).withColumn("previous_total", F.lag("total").over(lagged))
    totals = totals.where(F.col("previous").isNotNull())
    now = totals.join(counts, day).select(day, "type", (F.col("n") / F.col("total")).alias("p"), F.lit(0.0).alias("q"))
    was = totals.join(counts.withColumnRenamed(day, "previous"), "previous")
    was = was.select(day, "type", F.lit(0.0).alias("p"), (F.col("n") / F.col("previous_total")).alias("q"))
    mixes = now.unionByName(was).groupBy(day, "type").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    scores = mixes.groupBy(day).agg(F.round(F.sum(_term(F.col("p"), middle) + _term(F.col("q"), middle)), digits).alias("score"))
    return totals.select(day, "previous").join(scores, day)


def top_shifts(scores: DataFrame, day: str = "date", k: int = 12) -> DataFrame:
    return scores.orderBy(F.desc("score"), day).limit(k)


def near_entries(scores: DataFrame, entries: DataFrame, *, days: int = 7, first: int = 6) -> DataFrame:
    """The first ``first`` entries (position, date) within ``days`` of each shift (date).

    A shift is filed under every date of its interval, so the join is on equality, and a date with
    many entries or shifts can be split like any other key.
    """
    offsets = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    filed = scores.select(F.col("date").alias("shift_date"), offsets.alias("o"))
    filed = filed.withColumn("date", F.date_add("shift_date", F.col("o")))
    near = filed.join(entries, "date")
    rank = F.row_number().over(Window.partitionBy("shift_date").orderBy("position"))
    return near.withColumn("rank", rank).where(F.col("rank") <= first).select("shift_date", "position", "date")


def period_of(date: Column, bounds: list[tuple[str, str, str]]) -> Column:
    """The name of the half-open period [low, high) that a date lies in."""
    found = F.lit(None).cast("string")
    for name, low, high in bounds:
        found = F.when((date >= F.lit(low).cast("date")) & (date < F.lit(high).cast("date")), name).otherwise(found)
    return found


def periods(rows: DataFrame, bounds: list[tuple[str, str, str]], talk: Column) -> DataFrame:
    """Days, events, messages and mean active actors over days with messages, by period."""
    by_day = rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(talk).alias("messages"), F.countDistinct(F.when(talk, F.col("actor"))).alias("active")
    )
    named = by_day.withColumn("period", period_of(F.col("date"), bounds)).where(F.col("period").isNotNull())
    return named.groupBy("period").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("events").alias("events"),
        F.sum("messages").alias("messages"),
        F.round(F.avg(F.when(F.col("messages") > 0, F.col("active"))), 4).alias("mean_active"),
    )


def weekday_medians(rows: DataFrame) -> DataFrame:
    """Median and mean of events a day, by weekday from Monday to Friday; records of one date are summed first."""
    by_day = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.weekday("date") < 5)
    return by_day.groupBy(F.weekday("date").alias("weekday")).agg(
        F.count(F.lit(1)).alias("days"), F.median("n").alias("median_n"), F.round(F.avg("n"), 4).alias("mean_n")
    )


def hourly(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor").alias("actors"))


def url_mentions(rows: DataFrame, least_path: int = 6) -> DataFrame:
    """(date, key, actor, ts): the URLs of texts in normal form, of a path of ``least_path`` characters and more.

    A text's URLs are told apart as they stand there, so two that become equal are two mentions.
    """
    found = rows.where(F.col("ts").isNotNull()).select("date", "actor", "ts", F.explode(urls(F.col("text"))).alias("url"))
    return found.select("date", normal_url(F.col("url"), least_path).alias("key"), "actor", "ts").where(F.col("key").isNotNull())


def cascades(rows: DataFrame, *, least_actors: int = 3, most_minutes: float = 60.0) -> DataFrame:
    """First mentions of a key by several actors within a day: (date, key, agents, span_minutes, mentions, sequence).

    ``rows`` has date, key, actor, ts. A mention without a time is passed over. The sequence has
    each actor and the minutes from the first mention to theirs; it is as long as the day has actors.
    """
    timed = rows.where(F.col("ts").isNotNull())
    first = timed.groupBy("date", "key", "actor").agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    found = first.groupBy("date", "key").agg(
        F.count(F.lit(1)).alias("agents"),
        F.min("first").alias("begin"),
        F.max("first").alias("end"),
        F.sum("n").alias("mentions"),
    )
    span = minutes_between(F.col("end"), F.col("begin"))
    kept = found.withColumn("span", span).where((F.col("agents") >= least_actors) & (F.col("span") <= most_minutes))
    minutes = F.round(minutes_between(F.col("first"), F.col("begin")), 2)
    step = F.struct(minutes.alias("minutes"), F.col("actor").cast("string").alias("actor"))
    turns = first.join(kept.select("date", "key", "begin"), ["date", "key"]).groupBy("date", "key").agg(F.array_sort(F.collect_list(step)).alias("sequence"))
    return kept.join(turns, ["date", "key"]).select("date", "key", "agents", F.round("span", 2).alias("span_minutes"), "mentions", "sequence")


def top_cascades(found: DataFrame, k: int = 24) -> DataFrame:
    return found.orderBy(F.desc("agents"), "date", "key").limit(k)
