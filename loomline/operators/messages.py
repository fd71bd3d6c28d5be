"""Message analyses: cues, duplicates, topics, samples, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CUES, STOPWORDS, normal, tags, tokens
from ..session import checkpointed
from .export import numbered, running_before


def cue_counts(rows: DataFrame, by: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(by, tag, n) of matching rules, and tag COVERED for rows that match any."""
    found = rows.select(by, tags(F.col("text"), rules).alias("t"))
    marks = F.when(F.size("t") > 0, F.concat("t", F.array(F.lit("COVERED")))).otherwise(F.col("t"))
    return found.select(by, F.explode(marks).alias("tag")).groupBy(by, "tag").agg(F.count(F.lit(1)).alias("n"))


def cue_pairs(rows: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(a, b, n): how often two rules match one row, a before b by name."""
    found = rows.select(F.explode(F.array(tags(F.col("text"), rules))).alias("t")).where(F.size("t") > 1)
    pairs = found.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cue_totals(rows: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(day, tag, n) of matching rules, tag COVERED for rows that match any, and totals of each tag under a null day."""
    found = cue_counts(rows, "day", rules)
    return found.unionByName(found.groupBy("tag").agg(F.sum("n").alias("n")).select(F.lit(None).cast(found.schema["day"].dataType).alias("day"), "tag", "n"))


def cue_examples(rows: DataFrame, rules: dict[str, str] | None = None, *, per_day: int = 2, per_tag: int = 4) -> DataFrame:
    """(tag, day, event_index, day_rank, tag_rank): the first ``per_day`` rows of each day and tag; tag_rank is null beyond the first ``per_tag`` of a tag.

    The first rows of a tag are among the first of its days, so only these are ranked again.
    """
    found = rows.select("day", "event_index", F.explode(tags(F.col("text"), rules)).alias("tag"))
    most = max(per_day, per_tag)
    in_day = F.row_number().over(Window.partitionBy("tag", "day").orderBy("event_index"))
    kept = found.withColumn("day_rank", in_day).where(F.col("day_rank") <= most)
    in_tag = F.row_number().over(Window.partitionBy("tag").orderBy("day", "event_index"))
    kept = kept.withColumn("tag_rank", in_tag).where((F.col("day_rank") <= per_day) | (F.col("tag_rank") <= per_tag))
    return kept.select("tag", "day", "event_index", "day_rank", F.when(F.col("tag_rank") <= per_tag, F.col("tag_rank")).alias("tag_rank"))


def audit_sample(rows: DataFrame, ident: str, rules: dict[str, str] | None = None, *, per_tag: int = 12, no_cue: int = 24, seed: str = "732") -> DataFrame:
    """(tag, ident): of each rule ``per_tag`` of the rows that it matches, and ``no_cue`` of those that none does, under NO_CUE."""
    rules = CUES if rules is None else rules
    found = tags(F.col("text"), rules)
    strata = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NO_CUE")))
    return stratified_sample(rows, strata, ident, {**dict.fromkeys(rules, per_tag), "NO_CUE": no_cue}, seed)


def word_usage(rows: DataFrame, word: str, family: str) -> DataFrame:
    """(month, own, other, ratio): texts that hold the word, by month, of speakers whose name holds ``family`` and of others.

    The row of null month has the totals; ratio is null where no other uses the word.
    """
    used = rows.where(F.lower("text").contains(word.lower()))
    own = F.lower("speaker").contains(family.lower())
    marked = used.select(F.date_format("date", "yyyy-MM").alias("month"), F.coalesce(own, F.lit(False)).alias("own"))
    sums = marked.rollup("month").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("other"))
    return sums.withColumn("ratio", F.round(F.try_divide("own", "other"), 6))


def prehistory(rows: DataFrame, needle: str, day: int, event_index: int) -> DataFrame:
    """(day, event_index, speaker) of all rows before a place that hold the needle, in any case of letters."""
    before = (F.col("day") < day) | ((F.col("day") == day) & (F.col("event_index") < event_index))
    return rows.where(before & F.lower("text").contains(needle.lower())).select("day", "event_index", "speaker")


def duplicates(rows: DataFrame, *, least: int = 80, examples: int = 6) -> DataFrame:
    """Groups of one normal text in a day: (day, norm, n, agents, examples).

    Texts are put in normal form once, for their hashes; of a group only its first row's text is read again.
    """
    keyed = rows.select("day", "event_index", "speaker", normal(F.col("text")).alias("norm")).where(F.length("norm") >= least)
    keyed = checkpointed(keyed.select("day", "event_index", "speaker", F.sha2("norm", 256).alias("key")))
    groups = keyed.groupBy("day", "key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("speaker").alias("agents"), F.min("event_index").alias("event_index")
    ).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("day", "key").orderBy("event_index"))
    firsts = keyed.withColumn("rank", rank).where(F.col("rank") <= examples)
    firsts = firsts.groupBy("day", "key").agg(F.array_sort(F.collect_list("event_index")).alias("examples"))
    found = groups.join(firsts, ["day", "key"]).join(rows.select("day", "event_index", "text"), ["day", "event_index"])
    return found.select("day", normal(F.col("text")).alias("norm"), "n", "agents", "examples")


def top_duplicates(groups: DataFrame, k: int = 16) -> DataFrame:
    """The largest duplicate groups: by size, speakers, day and text."""
    return groups.orderBy(F.desc("n"), F.desc("agents"), "day", "norm").limit(k)


def fingerprint(kind: Column, speaker: Column, content: Column) -> Column:
    """sha256 of kind, speaker ('None' if null) and content, joined by NUL; null for null content."""
    nul = F.lit("\0")
    return F.sha2(F.concat(F.coalesce(kind, F.lit("")), nul, F.coalesce(speaker, F.lit("None")), nul, content), 256)


def duplicate_fingerprints(rows: DataFrame, kind: Column, most: int = 200) -> DataFrame:
    """The largest groups of equal fingerprints: (fingerprint, n, day, event_index) of the first record."""
    keyed = rows.select(fingerprint(kind, F.col("speaker"), F.col("text")).alias("fingerprint"), "day", "event_index")
    groups = keyed.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "event_index")).alias("first")
    )
    groups = groups.where("n > 1").select("fingerprint", "n", "first.day", "first.event_index")
    return groups.orderBy(F.desc("n"), "day", "event_index").limit(most)


def profiles(rows: DataFrame, *, least: int = 20, top: int = 120, stopwords: list[str] | None = None) -> DataFrame:
    """(day, speaker, token, n): the ``top`` tokens of each day and speaker of at least ``least`` tokens.

    Counts are of at most one row a distinct token of a day and speaker when the window ranks them.
    """
    stop = STOPWORDS if stopwords is None else stopwords
    found = rows.select("day", "speaker", F.explode(tokens(F.col("text"))).alias("token"))
    counts = found.where(~F.col("token").isin(stop) if stop else F.lit(True)).groupBy("day", "speaker", "token").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("day", "speaker")
    ranked = counts.withColumn("total", F.sum("n").over(own)).where(F.col("total") >= least)
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "token")))
    return ranked.where(F.col("rank") <= top).select("day", "speaker", "token", "n")


def inverse_frequency(profiles: DataFrame) -> DataFrame:
    """(token, df, idf): ln((1 + N) / (1 + df)) + 1 over the N profiles."""
    sums = profiles.select("day", "speaker").distinct().agg(F.count(F.lit(1)).alias("n_profiles"))
    df = profiles.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(sums)).select("token", "df", (F.ln((1 + F.col("n_profiles")) / (1 + F.col("df"))) + 1).alias("idf"))


def topic_overlap(profiles: DataFrame) -> DataFrame:
    """(day, profiles, pairs, overlap): mean cosine of the day's unordered profile pairs, null below two.

    The mean over n unit vectors is (|sum|^2 - n) / (n (n - 1)), so no pair is ever formed.
    """
    profiles = checkpointed(profiles)  # read three times, and far smaller than the texts
    idf = inverse_frequency(profiles).select("token", "idf")
    weighed = profiles.join(idf, "token").withColumn("w", (1 + F.ln("n")) * F.col("idf"))
    norms = weighed.groupBy("day", "speaker").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.join(norms, ["day", "speaker"]).withColumn("u", F.col("w") / F.col("norm"))
    sums = unit.groupBy("day", "token").agg(F.sum("u").alias("s")).groupBy("day").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    counts = norms.groupBy("day").agg(F.count(F.lit(1)).alias("profiles"))
    n = F.col("profiles")
    overlap = F.when(n >= 2, F.round((F.col("ss") - n) / (n * (n - 1)), 4))
    return counts.join(sums, "day").select("day", "profiles", F.expr("profiles * (profiles - 1) div 2").alias("pairs"), overlap.alias("overlap"))


def first_occurrences(rows: DataFrame) -> DataFrame:
    """The first row of each text hash by (day, event_index); the text is not shuffled by the rank."""
    first = rows.groupBy("text_hash").agg(F.min(F.struct("day", "event_index")).alias("first"))
    return first.select("text_hash", "first.day", "first.event_index")


def first_speakers(rows: DataFrame) -> DataFrame:
    """(day, speakers): who spoke, each once, in the order of their first message."""
    first = rows.groupBy("day", "speaker").agg(F.min("event_index").alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "speaker")))
    return first.groupBy("day").agg(order.alias("x")).select("day", F.array_join(F.transform("x", lambda e: e["speaker"]), ",").alias("speakers"))


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` least text hashes, each once."""
    return rows.select("text_hash").distinct().orderBy("text_hash").limit(n)


def stratified_sample(rows: DataFrame, strata: Column, ident: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """(tag, ident): for each stratum the rows of least sha256 of seed and id. ``strata`` is an array of tags."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(ident).cast("string")), 256)
    rows = rows.select(F.explode(strata).alias("tag"), ident, order.alias("order"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("order", ident))
    size = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))])[F.col("tag")]
    return rows.withColumn("rank", rank).where(F.col("rank") <= size).select("tag", ident)


def shuffled_first(rows: DataFrame, ident: str, n: int, passes: Column, seed: str = "732") -> DataFrame:
    """The first ``n`` rows that pass, in an order shuffled by the sha256 of seed and id."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(ident).cast("string")), 256)
    return rows.where(passes).orderBy(order, ident).limit(n)


def preceding(rows: DataFrame, n: int = 2) -> DataFrame:
    """Each message with the speakers of up to ``n`` before it in its day, and how many came before."""
    order = Window.partitionBy("day").orderBy("event_index")
    return rows.select(
        "day",
        "event_index",
        F.array_join(F.collect_list("speaker").over(order.rowsBetween(-n, -1)), "|").alias("before"),
        (F.row_number().over(order) - 1).cast("long").alias("earlier_today"),
    )


def earlier_days(rows: DataFrame) -> DataFrame:
    """(day, earlier): messages on earlier days, by ranges of days and the sums of the ranges before."""
    daily = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return running_before(daily, "day", "n").select("day", F.col("before").alias("earlier"))


def eligible(rows: DataFrame, least_today: int = 2, least_before: int = 2) -> DataFrame:
    """Rows with enough messages before, not blank, the first such of their text hash."""
    joined = rows.join(preceding(rows).select("day", "event_index", "earlier_today"), ["day", "event_index"]).join(earlier_days(rows), "day")
    kept = joined.where((F.col("earlier_today") >= least_today) & (F.col("earlier") >= least_before) & (F.length(F.trim("text")) > 0))
    first = F.row_number().over(Window.partitionBy("text_hash").orderBy("day", "event_index"))
    return kept.withColumn("rank", first).where("rank = 1").drop("rank")


def word_total(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+")).cast("long")


def matched_pair(pool: DataFrame, targets: DataFrame, *, nearest: int = 32) -> DataFrame:
    """For each target (target, tokens) the pair of pool rows (ident, tokens) whose sum comes nearest.

    Only the ``nearest`` rows by distance from half the target are paired, so the pairs of a target
    are at most ``nearest`` squared over two; ties go to the smaller ids. Each length gives at most
    ``nearest`` rows; what is looked up is a target's half, once for each half that occurs: the
    lengths at and above it, and those below, each in order until ``nearest`` rows are met.
    """
    rank = F.row_number().over(Window.partitionBy("tokens").orderBy("ident"))
    short = checkpointed(pool.withColumn("rank", rank).where(F.col("rank") <= nearest).select("ident", "tokens"))
    halves = targets.select((F.col("tokens") / 2).alias("half")).distinct()
    found = near_lengths(halves, short.select("tokens").distinct(), nearest)
    close = found.join(short, "tokens").withColumn("d", F.abs(F.col("tokens") - F.col("half")))
    order = F.row_number().over(Window.partitionBy("half").orderBy("d", "ident"))
    close = close.withColumn("rank", order).where(F.col("rank") <= nearest).select("half", "ident", "tokens")
    a, b = close.alias("a"), close.alias("b")
    pairs = a.join(b, (F.col("a.half") == F.col("b.half")) & (F.col("a.ident") < F.col("b.ident")))
    gap = lambda wanted: F.abs(F.col("a.tokens") + F.col("b.tokens") - wanted)
    best = F.min(F.struct(gap(F.col("a.half") * 2).cast("long").alias("gap"), F.col("a.ident").alias("first"), F.col("b.ident").alias("second"))).alias("m")
    best = pairs.groupBy(F.col("a.half").alias("half")).agg(best).select("half", "m.gap", "m.first", "m.second")
    return targets.select("target", (F.col("tokens") / 2).alias("half")).join(best, "half").select("target", "gap", "first", "second")


def near_lengths(halves: DataFrame, lengths: DataFrame, nearest: int) -> DataFrame:
    """(half, tokens): for each half the ``nearest`` lengths at or above it, and as many below.

    Halves and lengths are ranked together, so a half knows how many lengths lie below it, and the
    lengths that it wants are those of the ranks around, by equality joins.
    """
    ranked = numbered(lengths, ["tokens"]).select("tokens", "position")
    both = lengths.select(F.col("tokens").cast("double").alias("at"), F.lit(1).alias("n")).unionByName(halves.select(F.col("half").alias("at"), F.lit(0).alias("n")))
    below = running_before(both.groupBy("at").agg(F.sum("n").alias("n"), F.max(F.col("n") == 0).alias("half")), "at", "n").where("half")
    spread = below.select(F.col("at").alias("half"), F.explode(F.sequence(F.col("before") - nearest, F.col("before") + nearest - 1)).alias("position"))
    return spread.join(ranked, "position").select("half", "tokens")


def earlier_samples(rows: DataFrame, days: DataFrame, sample: int, seed: str) -> DataFrame:
    """(for_day, and the columns of ``rows``): for each day (for_day) the ``sample`` rows of earlier days of least hash, of seed and row.

    The days before a day are blocks of 1, 2, 4, ... days, one for each bit of its number. Each block
    keeps its least rows, so that days are joined to blocks by equality and no row to every later day.
    """
    ends = rows.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    levels = F.sequence(F.lit(0), F.lit((high - low + 1).bit_length()))
    coded = rows.withColumn("_code", F.sha2(F.concat_ws(":", F.lit(seed), "day", "event_index"), 256))
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_code", "day", "event_index"))
    kept = coded.withColumn("_rank", least("day")).where(F.col("_rank") <= sample)
    blocks = kept.withColumn("_level", F.explode(levels)).withColumn("_block", F.expr(f"shiftright(cast(day - ({low}) as bigint), _level)"))
    blocks = blocks.withColumn("_rank", least("_level", "_block")).where(F.col("_rank") <= sample)
    count = F.least(F.col("for_day") - F.lit(low), F.lit(high - low + 1)).cast("long")
    asked = days.where(F.col("for_day") > low).withColumn("_count", count).withColumn("_level", F.explode(levels))
    asked = asked.withColumn("_block", F.expr("shiftright(_count, _level) - 1")).where(F.expr("shiftright(_count, _level) & 1 = 1"))
    met = asked.drop("_count").join(blocks, ["_level", "_block"])
    return met.withColumn("_rank", least("for_day")).where(F.col("_rank") <= sample).select("for_day", *rows.columns)


def context_pairs(rows: DataFrame, targets: DataFrame, *, sample: int = 128, nearest: int = 32, seed: str = "732") -> DataFrame:
    """For each target (day, event_index, tokens) a pair of rows (day, event_index, text, tokens) of earlier days whose lengths sum nearest to its own.

    The pool of a day is the ``sample`` rows of least hash among those of all earlier days with a
    text that is not blank; of it the ``nearest`` by distance from half the target are paired; ties
    go to the earlier rows. Targets with fewer than two such rows get no pair.
    """
    usable = rows.where(F.length(F.trim("text")) > 0).select("day", "event_index", "tokens")
    pool = earlier_samples(usable, targets.select(F.col("day").alias("for_day")).distinct(), sample, seed)
    wanted = targets.select(F.col("day").alias("for_day"), F.col("event_index").alias("target"), F.col("tokens").alias("wanted"))
    near = wanted.join(pool.select("for_day", F.struct("day", "event_index").alias("ident"), "tokens"), "for_day")
    close = Window.partitionBy("for_day", "target").orderBy(F.abs(F.col("tokens") - F.col("wanted") / 2), "ident")
    near = near.withColumn("rank", F.row_number().over(close)).where(F.col("rank") <= nearest)
    a, b = near.alias("a"), near.alias("b")
    pairs = a.join(b, (F.col("a.for_day") == F.col("b.for_day")) & (F.col("a.target") == F.col("b.target")) & (F.col("a.ident") < F.col("b.ident")))
    gap = F.abs(F.col("a.tokens") + F.col("b.tokens") - F.col("a.wanted"))
    best = F.min(F.struct(gap.alias("gap"), F.col("a.ident").alias("first"), F.col("b.ident").alias("second"))).alias("m")
    found = pairs.groupBy(F.col("a.for_day").alias("day"), F.col("a.target").alias("event_index")).agg(best)
    names = {f"{n}_{p}": F.col(f"m.{n}.{p}") for n in ("first", "second") for p in ("day", "event_index")}
    return found.select("day", "event_index", "m.gap", *[c.alias(k) for k, c in names.items()])


def context_text(before: Column, target: Column, budget: int) -> Column:
    """Context and target of at most ``budget`` words, cut from the left; null if the target alone is longer."""
    room = F.lit(budget) - F.size(F.split(target, r"\s+"))
    words = F.split(F.trim(before), r"\s+")
    kept = F.when(room <= 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.greatest(F.lit(1), F.size(words) - room + 1), F.greatest(room, F.lit(0))))
    return F.when(room >= 0, F.trim(F.concat_ws(" ", F.array_join(kept, " "), target)))
