"""Integrity rules: named conditions that rows must not meet, and checks that recompute what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CUES, DURATION, READ_CLAIM, normal, tags
from ..session import checkpointed
from .export import numbered

# What the fields of observations and edges may hold.
TRACKS = ["expression", "evidence", "action", "context"]
STANCES = ["mention", "endorsement", "challenge", "qualification", "report"]
BASES = ["direct-logged-event", "explicit-agent-report", "analyst-inference"]
OUTCOMES = ["proposed", "result-reported", "unknown", "contradicted"]
STRENGTHS = ["explicit-attribution", "candidate", "unresolved"]
PHENOMENA = ["idea-lineage", "artifact-pathway", "boundary-case"]
EDGE_TYPES = [
    "replies_to",
    "mentions",
    "attributes_to",
    "proposes",
    "endorses",
    "challenges",
    "reports_attempt",
    "observed_attempt",
    "reports_result",
    "evidences_result",
    "references_artifact",
    "observed_reads_version",
    "observed_modifies_version",
    "candidate_informed_by",
    "retracts",
    "contradicts",
    "strengthens_without_cited_new_evidence",
]
DIRECT_TYPES = ["observed_attempt", "observed_modifies_version", "observed_reads_version", "evidences_result"]
LINEAGE_TYPES = ["attributes_to", "endorses", "mentions", "proposes", "replies_to"]
REQUIRED = ["id", "title", "question", "summary", "phenomenon", "scope", "claims", "events", "roots", "edges", "artifacts"]
BAD_TIMES = ["missing", "malformed", "timezone-unknown", "missing-or-invalid"]
LOCATOR = r"^ev-([0-9a-f]{12})-d([^\s-]+)-e(\d+)$"


def violations(rows: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """(ident, rule): a row for each rule that a row breaks. Null conditions are not met."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(F.col(ident), F.explode(broken).alias("rule"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside(column: str, allowed: list[str]) -> Column:
    return ~F.coalesce(F.col(column).isin(allowed), F.lit(False))


def event_rules(snapshot: str) -> dict[str, Column]:
    """Rules of an observation's events."""
    part = lambda i: F.regexp_extract("id", LOCATOR, i)
    located = F.col("id").rlike(LOCATOR) & (part(1) == snapshot[:12]) & (part(3) == F.col("event_index").cast("string")) & (part(2) == F.col("day").cast("string"))
    endorses = F.coalesce("is_endorsement", F.lit(False))
    return {
        "locator": ~F.coalesce(located, F.lit(False)),
        "source order": ~F.col("source_order").eqNullSafe(F.col("event_index")),
        "track": outside("track", TRACKS),
        "stance": outside("stance", STANCES),
        "basis": outside("basis", BASES),
        "outcome": outside("outcome", OUTCOMES),
        "endorsement flag": endorses != F.col("stance").eqNullSafe("endorsement"),
        "challenge counted as endorsement": (F.col("stance") == "challenge") & endorses,
        "no quote": F.coalesce("quote", F.lit("")) == "",
        "quote not in text": (F.coalesce("quote", F.lit("")) != "") & ~F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)),
        "time of bad quality": F.col("time_quality").isin(BAD_TIMES) & F.col("ts").isNotNull(),
    }


def observation_rules(snapshot: str) -> dict[str, Column]:
    return {
        "status": ~F.col("status").eqNullSafe("exploratory"),
        "review status": ~F.col("review_status").eqNullSafe("awaiting-human-review"),
        "snapshot": ~F.col("snapshot_id").eqNullSafe(snapshot),
        "phenomenon": outside("phenomenon", PHENOMENA),
        "permission": ~F.col("permission_status").eqNullSafe("unconfirmed"),
        "redaction": ~F.col("redaction_review").eqNullSafe("pending"),
    }


def missing_keys(raw: Column, required: list[str] = REQUIRED) -> Column:
    """The required keys that a JSON object lacks, in their order; all of them for text that is no object."""
    held = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]), held)


def unknown_claims(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, rule) of events (id, claim_id) whose claim is none of the claims (claim_id)."""
    named = events.where(F.col("claim_id").isNotNull()).select("id", "claim_id")
    return named.join(claims.select("claim_id"), "claim_id", "left_anti").select("id", F.lit("unknown claim").alias("rule"))


def edge_violations(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(edge, rule) over edges (edge, source, target, evidence array, type, basis, strength, explanation, quote, elapsed).

    Endpoints must exist; else nothing more is said of the edge. An edge must not go back in source
    order; its type, basis and strength are of the known ones; an observed type needs direct
    evidence; a candidate is not explicit. At least one event is cited and all that are exist, else
    no more is said. None of them comes after the target; a quote is given and stands in one of
    them; no time is claimed to have passed, in words or in ``elapsed``, where a time is missing,
    bad or tied; an explicit attribution has an explanation.
    """
    event = lambda a: events.select(
        F.col("id").alias(a), F.struct("day", "event_index").alias(f"{a}_at"), F.col("ts").alias(f"{a}_ts"), F.col("time_quality").alias(f"{a}_quality")
    )
    cited = edges.select("edge", "quote", F.explode_outer("evidence").alias("id")).join(events.select("id", F.struct("day", "event_index").alias("at"), "text"), "id", "left")
    holds = F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False))
    cited = cited.groupBy("edge").agg(F.max("at").alias("last"), F.bool_and(F.col("at").isNotNull()).alias("all_cited"), F.bool_or(holds).alias("quoted"))
    rows = edges.join(event("source"), "source", "left").join(event("target"), "target", "left").join(cited, "edge", "left")
    found = F.col("source_at").isNotNull() & F.col("target_at").isNotNull()
    cites = found & F.coalesce("all_cited", F.lit(False))
    timeless = F.col("source_ts").isNull() | F.col("target_ts").isNull() | (F.col("source_ts") == F.col("target_ts"))
    timeless = timeless | F.coalesce(F.col("target_quality").isin(BAD_TIMES), F.lit(False))
    said = F.concat_ws(" ", F.coalesce("explanation", F.lit("")), F.coalesce("quote", F.lit("")))
    passed = ~F.coalesce(F.col("elapsed").cast("string"), F.lit("")).isin("", "0", "false", "False", "None") | said.rlike(DURATION)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    explicit = F.col("strength").eqNullSafe("explicit-attribution")
    return violations(
        rows,
        "edge",
        {
            "unknown endpoint": ~found,
            "backward": found & (F.col("target_at") < F.col("source_at")),
            "type": found & outside("type", EDGE_TYPES),
            "basis or strength": found & (outside("basis", BASES) | outside("strength", STRENGTHS)),
            "direct evidence needed": found & F.col("type").isin(DIRECT_TYPES) & ~F.col("basis").eqNullSafe("direct-logged-event"),
            "candidate marked explicit": found & F.col("type").eqNullSafe("candidate_informed_by") & explicit,
            "unknown evidence": found & ~F.coalesce("all_cited", F.lit(False)),
            "evidence from the future": cites & (F.col("last") > F.col("target_at")),
            "no quote": cites & blank("quote"),
            "quote not in evidence": cites & ~blank("quote") & ~F.col("quoted"),
            "duration without times": cites & timeless & passed,
            "attribution without explanation": cites & explicit & blank("explanation"),
        },
    )


def root_violations(roots: DataFrame, events: DataFrame) -> DataFrame:
    """(root, rule) over roots (root, basis, caveat, events array): basis, caveat and cited events are needed."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    cited = roots.select("root", F.explode("events").alias("id")).join(events.select("id"), "id", "left_anti").select("root", F.lit(True).alias("absent")).distinct()
    rows = roots.join(cited, "root", "left")
    return violations(
        rows,
        "root",
        {
            "no basis or caveat": blank(F.col("basis")) | blank(F.col("caveat")),
            "cites no event": F.coalesce(F.size("events"), F.lit(0)) <= 0,
            "cites an absent event": F.coalesce("absent", F.lit(False)),
        },
    )


def lineage(roots: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """(root, id) of events that explicit attribution leads to from a root's events, over events no later than they are.

    For each root and event the least of the latest places on a path is kept; a path serves an
    event if that is its own place. Rounds end when no place falls.
    """
    place = events.select("id", F.struct("day", "event_index").alias("place"))
    steps = edges.where(F.col("strength").eqNullSafe("explicit-attribution") & F.col("type").isin(LINEAGE_TYPES))
    steps = checkpointed(steps.select(F.col("source").alias("id"), F.col("target")).join(place.withColumnRenamed("id", "target"), "target").distinct())
    reached = checkpointed(roots.select("root", F.explode("events").alias("id")).distinct().join(place, "id").select("root", "id", "place"))
    while True:
        new = reached.alias("r").join(steps.alias("s"), F.col("r.id") == F.col("s.id"))
        new = new.select("root", F.col("s.target").alias("id"), F.greatest("r.place", "s.place").alias("place"))
        grown = checkpointed(reached.unionByName(new).groupBy("root", "id").agg(F.min("place").alias("place")))
        if grown.join(reached, ["root", "id", "place"], "left_anti").isEmpty():
            break
        reached = grown
    return grown.join(place.withColumnRenamed("place", "own"), "id").where(F.col("place") == F.col("own")).select("root", "id")


def family_violations(events: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rule) of events (id, day, event_index, root_family, root_reason): the family exists, has a reason, and a path leads there."""
    named = events.where(F.col("root_family").isNotNull())
    led = lineage(roots, edges, events).select(F.col("root").alias("root_family"), "id", F.lit(True).alias("led"))
    known = roots.select(F.col("root").alias("root_family"), F.lit(True).alias("known")).distinct()
    rows = named.join(known, "root_family", "left").join(led, ["root_family", "id"], "left")
    exists = F.coalesce("known", F.lit(False))
    return violations(
        rows,
        "id",
        {
            "unknown family": ~exists,
            "family without reason": exists & (F.coalesce("root_reason", F.lit("")) == ""),
            "no explicit path": exists & ~F.coalesce("led", F.lit(False)),
        },
    )


def replay(events: DataFrame) -> DataFrame:
    """(observation, step, id, endorsers, checks, endorsements, rooted): what is known at each step of an observation.

    Counts over the events up to the step, in source order: speakers who endorse, reported results,
    endorsements, and those of them with a documented root. An observation is one person's
    selection; its events are one window.
    """
    order = Window.partitionBy("observation").orderBy("day", "event_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    endorses = F.col("stance").eqNullSafe("endorsement")
    once = F.row_number().over(Window.partitionBy("observation", "speaker", "stance").orderBy("day", "event_index")) == 1
    rows = events.withColumn("_first", endorses & once)
    count = lambda c: F.sum(c.cast("long")).over(so_far)
    return rows.select(
        "observation",
        (F.row_number().over(order) - 1).cast("long").alias("step"),
        "id",
        count(F.col("_first")).alias("endorsers"),
        count(F.col("outcome").eqNullSafe("result-reported")).alias("checks"),
        count(endorses).alias("endorsements"),
        count(endorses & F.col("root_family").isNotNull()).alias("rooted"),
    )


def artifact_violations(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """(artifact, rule): cited events exist, no claim of reading, repeated local paths have a namespace."""
    cited = artifacts.select("artifact", F.explode("events").alias("id")).join(events.select("id"), "id", "left_anti")
    unknown = cited.select("artifact", F.lit("unknown event").alias("rule")).distinct()
    read = artifacts.where(F.col("description").rlike(READ_CLAIM)).select("artifact", F.lit("claims a reading").alias("rule"))
    local = artifacts.where(F.col("path").startswith("/"))
    several = repeated_keys(local, ["path"]).select("path")
    unscoped = local.join(several, "path", "left_semi").where(F.coalesce("namespace", F.lit("")) == "").select("artifact", F.lit("repeated path without namespace").alias("rule"))
    return unknown.unionByName(read).unionByName(unscoped)


def scene_violations(scenes: DataFrame, events: DataFrame) -> DataFrame:
    """(id, rule): every event is shown once, at the step that its source order gives."""
    expected = numbered(events.select("id", "day", "event_index"), ["day", "event_index"]).select("id", F.col("position").alias("expected"))
    shown = scenes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("step"))
    both = expected.join(shown, "id", "full_outer")
    return violations(
        both,
        "id",
        {
            "not shown": F.col("n").isNull(),
            "shown more than once": F.col("n") > 1,
            "unknown event": F.col("expected").isNull(),
            "wrong step": F.col("step") != F.col("expected"),
        },
    )


def verbatim_violations(stored: DataFrame, source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field) of stored copies that differ from their source, or have none."""
    theirs = source.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_found"))
    both = stored.join(theirs, keys, "left")
    broken = F.when(F.col("_found").isNull(), F.array(F.lit("no source"))).otherwise(
        F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    )
    return both.select(*keys, F.explode(broken).alias("field"))


def mismatches(stored: DataFrame, computed: DataFrame, key: str, values: list[str], within: float = 0.0) -> DataFrame:
    """(key, value, stored, computed) that differ by more than ``within``, or that one side lacks."""
    theirs = computed.select(key, *[F.col(v).alias(f"_{v}") for v in values])
    both = stored.join(theirs, key, "full_outer")
    cells = F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("stored"), F.col(f"_{v}").cast("double").alias("computed")) for v in values])
    rows = both.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    far = F.abs(F.col("stored") - F.col("computed")) > within
    return rows.where(F.coalesce(far, ~F.col("stored").eqNullSafe(F.col("computed"))))


def cascade_violations(cascades: DataFrame, *, least_actors: int = 3, most_minutes: float = 60.0) -> DataFrame:
    """(date, key, rule) of stored cascades (date, key, agents, span_minutes, sequence of minutes and actor) that cannot be what they say."""
    rows = cascades.withColumn("place", F.struct("date", "key"))
    minutes = F.transform("sequence", lambda x: x["minutes"])
    actors = F.transform("sequence", lambda x: x["actor"])
    return violations(
        rows,
        "place",
        {
            "too few": F.size(F.array_distinct(actors)) < least_actors,
            "count": F.col("agents") != F.size(F.array_distinct(actors)),
            "order": minutes != F.array_sort(minutes),
            "start": F.get(minutes, F.lit(0)) != 0,
            "span": (F.abs(F.col("span_minutes") - F.array_max(minutes)) > 0.011) | (F.col("span_minutes") > most_minutes),
        },
    ).select("place.*", "rule")


def example_violations(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(day, event_index, rule) of the examples of duplicate groups (day, norm, examples) whose text has another normal form, or none."""
    cited = groups.select("day", "norm", F.explode("examples").alias("event_index"))
    both = cited.join(rows.select("day", "event_index", "text"), ["day", "event_index"], "left")
    return violations(
        both.withColumn("place", F.struct("day", "event_index")),
        "place",
        {"no such row": F.col("text").isNull(), "another normal form": F.col("text").isNotNull() & (normal(F.col("text")) != F.col("norm"))},
    ).select("place.*", "rule")


def sample_violations(sample: DataFrame, rows: DataFrame, ident: str, *, cues: dict[str, str] | None = None, per_tag: int = 12, no_cue: int = 24) -> DataFrame:
    """(tag, rule, n) of an audit sample (tag, ident): strata of another size, texts that their rule does not match, NO_CUE texts that one does."""
    cues = CUES if cues is None else cues
    wanted = F.create_map(*[x for k, v in {**dict.fromkeys(cues, per_tag), "NO_CUE": no_cue}.items() for x in (F.lit(k), F.lit(v))])
    both = sample.join(rows.select(ident, tags(F.col("text"), cues).alias("_tags")), ident, "left")
    fits = F.when(F.col("tag") == "NO_CUE", F.size("_tags") == 0).otherwise(F.array_contains("_tags", F.col("tag")))
    sums = both.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("unfit"))
    cells = F.array_compact(
        F.array(
            F.when(~F.col("n").eqNullSafe(wanted[F.col("tag")].cast("long")), F.struct(F.lit("size").alias("rule"), F.col("n").alias("n"))),
            F.when(F.col("unfit") > 0, F.struct(F.lit("label").alias("rule"), F.col("unfit").alias("n"))),
        )
    )
    return sums.select("tag", F.explode(cells).alias("x")).select("tag", "x.*")


def require_snapshot(expected: str, actual: str) -> None:
    """Refuse work on another snapshot than the one that was asked for."""
    if expected != actual:
        raise ValueError("the source is not the requested snapshot")
