"""Queries of operators whose cases the test tables lack: their rows are planted here, for Spark and for SQL alike."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, prepare, scores, times
from ..functions import text as T
from ..operators import audit, export, graph, index, messages, parity, reports, rules, transfer
from ..session import scratch
from ..sources import transcript
from ..sources.tables import document_messages, document_predictions, event_stream, table, timeline
from ..sources.tables import messages as conversation_messages
from ..streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_planted: dict[str, tuple[str, list[tuple]]] = {}
RUN = "run-a"
SNAPSHOT = "0123456789abcdef"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def plant(name: str, schema: str, rows: list[tuple]) -> None:
    _planted[name] = (schema, rows)


def local(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = _planted[name]
    return spark.createDataFrame(rows, schema)


def _kind(kind: str) -> str:
    if kind.startswith("array<"):
        return _kind(kind[6:-1]) + "[]"
    return {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}[kind]


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str) -> str:
    """The planted rows as a common table expression."""
    schema, rows = _planted[name]
    columns = [c.split(" ") for c in schema.split(", ")]
    cells = (", ".join(f"CAST({_literal(v)} AS {_kind(kind)})" for v, (_, kind) in zip(r, columns)) for r in rows)
    names = ", ".join(f'"{c}"' for c, _ in columns)
    return f"{name}({names}) AS (VALUES ({'), ('.join(cells)}))"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- the nine cue rules -------------------------------------------------------------------------------

plant(
    "cue_texts",
    "i long, speaker string, text string",
    [(i, ["Ada", "Bo", "Cy"][i % 3], t) for i, t in enumerate([
        "I verified the count and cross-checked it", "Independently checked: byte exact", "We should merge; let’s go", "I propose what was published",
        "Could you review this? You're unblocked", "Please run it, volunteer or join me", "Thanks, received and agreed", "I'll follow your plan, thank you",
        "That is incorrect and unsupported", "A reliability issue: please exclude it", "Blocked, permission denied, timed out", "Stuck on a 404, I can’t access it",
        "Shipped and deployed, it is live", "COMMITTED, PUSHED, FINISHED", "Researching it, looking into the cause", "I searched for it and investigated",
        "Abandoned: no longer pursue it", "Shelving it, dropping this", "nothing to see here", "unverifiedly reported, recompleted",
        "recommendation: how about a check", "plain words alone", "assigned to Bo for review", "contradiction found, breach reported",
    ])],
)

_NINE = (
    f"WITH {values('cue_texts')}, m AS (SELECT r % 5 AS day, r * 24 + i AS event_index, speaker, text || ' #' || r AS text FROM cue_texts, range(20) x(r) "
    "UNION ALL SELECT conv_id + 100, turn, role, text FROM conversations), "
)
_TAGGED = (
    _NINE
    + "t AS ("
    + " UNION ALL ".join("SELECT day, event_index, speaker, '{}' AS tag FROM m WHERE regexp_matches(text, '(?i){}')".format(k, v.replace("'", "''")) for k, v in T.CUES.items())
    + ") "
)
_SAMPLE = (
    _TAGGED[:-1]
    + """, s AS (SELECT tag, day * 100000 + event_index AS ident FROM t UNION ALL SELECT 'NO_CUE', day * 100000 + event_index FROM m
    WHERE (day, event_index) NOT IN (SELECT (day, event_index) FROM t)),
    k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sha256('732:' || ident), ident) AS r FROM s),
    a AS (SELECT tag, ident FROM k WHERE r <= CASE WHEN tag = 'NO_CUE' THEN 24 ELSE 12 END) """
)


def _nine(spark: SparkSession, sf: str) -> DataFrame:
    copies = local(spark, "cue_texts").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<long>")))
    rows = copies.select((F.col("r") % 5).alias("day"), (F.col("r") * 24 + F.col("i")).alias("event_index"), "speaker", F.concat("text", F.lit(" #"), F.col("r").cast("string")).alias("text"))
    return rows.unionByName(conversation_messages(spark, sf).select((F.col("day") + 100).alias("day"), "event_index", "speaker", "text"))


@query(
    _TAGGED[:-1]
    + """, c AS (SELECT day, tag, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT day, 'COVERED', count(DISTINCT event_index) FROM t GROUP BY day)
    SELECT day, tag, n FROM c UNION ALL SELECT NULL, tag, sum(n)::BIGINT FROM c GROUP BY tag"""
)
def cue_totals_nine(spark, sf):
    return messages.cue_totals(_nine(spark, sf))


@query(_TAGGED + "SELECT speaker, tag, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT speaker, 'COVERED', count(DISTINCT (day, event_index)) FROM t GROUP BY speaker")
def cue_speakers_nine(spark, sf):
    return messages.cue_counts(_nine(spark, sf), "speaker")


@query(
    _TAGGED[:-1]
    + """, k AS (SELECT tag, day, event_index, row_number() OVER (PARTITION BY tag, day ORDER BY event_index) AS d, row_number() OVER (PARTITION BY tag ORDER BY day, event_index) AS g FROM t)
    SELECT tag, day, event_index, d::INT AS day_rank, CASE WHEN g <= 4 THEN g END::INT AS tag_rank FROM k WHERE d <= 2 OR g <= 4"""
)
def cue_examples(spark, sf):
    return messages.cue_examples(_nine(spark, sf))


def _audit(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _nine(spark, sf).select((F.col("day") * 100_000 + F.col("event_index")).alias("ident"), "text")
    return rows, messages.audit_sample(rows, "ident")


@query(_SAMPLE + "SELECT tag, ident FROM a")
def audit_sample_132(spark, sf):
    return _audit(spark, sf)[1]


@query(
    _SAMPLE[:-1]
    + """, w AS (SELECT CASE WHEN tag = 'VERIFY' AND ident % 2 = 0 THEN 'ABANDON' ELSE tag END AS tag, ident FROM a),
    c AS (SELECT tag, count(*) AS n, count(*) FILTER (CASE WHEN tag = 'NO_CUE' THEN EXISTS (SELECT 1 FROM s WHERE s.ident = w.ident AND s.tag <> 'NO_CUE')
      ELSE NOT EXISTS (SELECT 1 FROM s WHERE s.ident = w.ident AND s.tag = w.tag) END) AS unfit FROM w GROUP BY tag)
    SELECT tag, 'size' AS rule, n FROM c WHERE n <> CASE WHEN tag = 'NO_CUE' THEN 24 ELSE 12 END UNION ALL SELECT tag, 'label', unfit FROM c WHERE unfit > 0"""
)
def dq_audit_sample(spark, sf):
    """The sample with half of one rule's rows under another."""
    rows, sample = _audit(spark, sf)
    moved = F.when((F.col("tag") == "VERIFY") & (F.col("ident") % 2 == 0), "ABANDON").otherwise(F.col("tag"))
    return rules.sample_violations(sample.withColumn("tag", moved), rows, "ident")


# --- names and graphs -----------------------------------------------------------------------------------

plant(
    "talks",
    "day long, event_index long, speaker string, text string",
    [
        (1, 0, "Ada", "GPT-5.1 and gpt-5 differ; Bo agrees, BO does"), (1, 1, "Bo", "Ada, see GPT-5."), (1, 2, "GPT-5", "I am GPT-5; x-Ada is none, nor Ada-x"),
        (2, 0, "Ada", "Bo.txt is a file; Cy?"), (2, 1, "Cy", "(Ada) said: Bo"), (2, 2, "Unknown", "Ada"), (3, 0, "GPT-5.1", "Cy. Bo"), (3, 1, "Cy", "nobody"), (3, 2, "Ada", "adaBo Bo_ _Cy"),
    ],
)
_MENTIONS = (
    f"WITH {values('talks')}, n AS (SELECT DISTINCT speaker AS name FROM talks WHERE speaker NOT IN ('', 'Unknown')), "
    r"""x AS (SELECT day, event_index, speaker AS src, name AS dst FROM talks, n WHERE speaker <> name
    AND regexp_matches(text, '(?i)(^|[^\w-])' || replace(name, '.', '\.') || '($|[^\w.-]|\.$|\.[^\w])')) """
)


def _talks(spark: SparkSession) -> tuple[DataFrame, list[str]]:
    rows = local(spark, "talks")
    return rows, graph.names_of(graph.registry(rows))


@query(_MENTIONS + "SELECT day, src, dst, count(*) AS n FROM x GROUP BY ALL")
def mention_edges(spark, sf):
    return graph.mention_edges(*_talks(spark))


@query(_MENTIONS + "SELECT src, dst, count(*) AS n, min(day) AS day, arg_min(event_index, (day, event_index)) AS event_index FROM x GROUP BY src, dst")
def edge_examples(spark, sf):
    return graph.edge_examples(*_talks(spark))


@query(_MENTIONS + "SELECT day, src, dst, count(*) AS n FROM x WHERE (day, dst) IN (SELECT (day, speaker) FROM talks) GROUP BY ALL")
def active_edges(spark, sf):
    rows, names = _talks(spark)
    return graph.active_edges(graph.mention_edges(rows, names), rows)


_ALIVE = (
    _MENTIONS.replace("WITH talks", "WITH RECURSIVE talks")[:-1]
    + """, a AS (SELECT DISTINCT day, speaker AS v FROM talks), e AS (SELECT day, src AS p, dst AS q FROM x WHERE (day, dst) IN (SELECT (day, v) FROM a)
    UNION SELECT day, dst, src FROM x WHERE (day, dst) IN (SELECT (day, v) FROM a)),
    r(day, v, root) AS (SELECT day, v, v FROM a UNION SELECT r.day, e.q, r.root FROM r JOIN e ON r.day = e.day AND r.v = e.p),
    c AS (SELECT day, v, min(root) AS root FROM r GROUP BY ALL), z AS (SELECT day, root, count(*) AS size FROM c GROUP BY ALL)
    SELECT day, count(*) AS components, max(size) AS largest FROM z GROUP BY day"""
)


@query(_ALIVE)
def speaker_components(spark, sf):
    """Components of each day's speakers, those alone included."""
    rows, names = _talks(spark)
    edges = graph.active_edges(graph.mention_edges(rows, names), rows)
    return graph.components(rows.select("day", F.col("speaker").alias("node")).distinct(), edges)


plant("steps", "src string, dst string, at long", [(f"n{i % 40}", f"n{(i * 7 + 3) % 40}", i * 11 % 29) for i in range(120)])
plant("begins", "node string, at long", [("n0", 2), ("n5", 20), ("n0", 9)])


@query(
    f"""WITH RECURSIVE {values('steps')}, {values('begins')}, r(node, t) AS (SELECT node, "at" FROM begins UNION SELECT s.dst, s."at" FROM r JOIN steps s ON r.node = s.src AND s."at" >= r.t)
    SELECT node, min(t) AS "at" FROM r GROUP BY node"""
)
def reachable_in_time(spark, sf):
    return graph.reachable(local(spark, "begins"), local(spark, "steps"))


@query(
    """SELECT conv_id AS day, string_agg(CASE role WHEN 'user' THEN 'person' ELSE role END, ',' ORDER BY turn) AS ids FROM conversations GROUP BY 1"""
)
def renamed_ids(spark, sf):
    per = conversation_messages(spark, sf).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("event_index", "speaker"))).alias("x"))
    return per.select("day", F.array_join(graph.renamed(F.transform("x", lambda e: e["speaker"]), {"user": "person"}), ",").alias("ids"))


@query("SELECT doc_id // 50 AS day, doc_id AS event_index, source AS speaker FROM documents WHERE doc_id // 50 < 3 AND contains(lower(text), 'ing') OR doc_id // 50 = 3 AND doc_id < 170 AND contains(lower(text), 'ing')")
def prehistory_scan(spark, sf):
    return messages.prehistory(document_messages(spark, sf), "ING", 3, 170)


@query("WITH f AS (SELECT conv_id AS day, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT day, string_agg(role, ',' ORDER BY t) AS speakers FROM f GROUP BY day")
def speakers_in_order(spark, sf):
    return messages.first_speakers(conversation_messages(spark, sf))


@query(
    r"""WITH t AS (SELECT conv_id AS day, turn AS event_index, role, text, len(string_split_regex(trim(text), '\s+')) AS tokens FROM conversations),
    x AS (SELECT day, event_index, tokens FROM t WHERE role = 'system' OR event_index = 2),
    p AS (SELECT x.day AS for_day, x.event_index AS target, x.tokens AS wanted, t.day, t.event_index, t.tokens, sha256('732:' || t.day || ':' || t.event_index) AS code
      FROM x JOIN t ON t.day < x.day WHERE length(trim(t.text)) > 0),
    s AS (SELECT *, row_number() OVER (PARTITION BY for_day, target ORDER BY code, day, event_index) AS r FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY for_day, target ORDER BY abs(tokens - wanted / 2), day, event_index) AS k FROM s WHERE r <= 128),
    c AS (SELECT * FROM n WHERE k <= 32),
    g AS (SELECT a.for_day, a.target, abs(a.tokens + b.tokens - a.wanted) AS gap, a.day AS fd, a.event_index AS fe, b.day AS sd, b.event_index AS se
      FROM c a JOIN c b ON a.for_day = b.for_day AND a.target = b.target AND (a.day, a.event_index) < (b.day, b.event_index)),
    o AS (SELECT *, row_number() OVER (PARTITION BY for_day, target ORDER BY gap, fd, fe, sd, se) AS r FROM g)
    SELECT for_day AS day, target AS event_index, gap, fd AS first_day, fe AS first_event_index, sd AS second_day, se AS second_event_index FROM o WHERE r = 1"""
)
def context_pairs(spark, sf):
    rows = conversation_messages(spark, sf).withColumn("tokens", messages.word_total(F.col("text")))
    targets = rows.where("speaker = 'system' or event_index = 2").select("day", "event_index", "tokens")
    return messages.context_pairs(rows, targets)


# --- observations ---------------------------------------------------------------------------------------

EVENT = "observation string, id string, day long, event_index long, speaker string, source_order long, track string, stance string, basis string, outcome string, is_endorsement boolean, quote string, text string, time_quality string, ts string, claim_id string, root_family string, root_reason string"


def _event(n: int, **change: object) -> tuple:
    row = {
        "observation": f"o{n % 2}", "id": f"ev-0123456789ab-d{n // 4}-e{n}", "day": n // 4, "event_index": n, "speaker": ["Ada", "Bo", "Cy"][n % 3], "source_order": n,
        "track": "action", "stance": ["mention", "endorsement", "report"][n % 3], "basis": "direct-logged-event", "outcome": ["unknown", "result-reported"][n % 2],
        "is_endorsement": n % 3 == 1, "quote": f"word {n}", "text": f"some word {n} here", "time_quality": "valid", "ts": f"2026-01-0{1 + n // 4}T0{n % 4}:00:00Z",
        "claim_id": "c1", "root_family": None, "root_reason": None,
    }
    return tuple((row | change).values())


def _id(n: int) -> str:
    return f"ev-0123456789ab-d{n // 4}-e{n}"


plant(
    "evs",
    EVENT,
    [
        _event(0), _event(1, root_family="r1", root_reason="said so"), _event(2, root_family="r1"), _event(3, root_family="nowhere", root_reason="x"),
        _event(4, id="ev-bad"), _event(5, source_order=9, track="x", claim_id="c9"), _event(6, stance="shout", basis=None, outcome="done"), _event(7, is_endorsement=False),
        _event(8, stance="challenge", is_endorsement=True), _event(9, quote=""), _event(10, quote="absent"), _event(11, time_quality="malformed"), _event(12, root_family="r1", root_reason="later"),
        _event(13, root_family="r2", root_reason="cited"), _event(14, ts="2026-01-04T01:00:00Z"), _event(15, root_family="r1", root_reason="by a way that goes back"),
    ],
)
plant("claim_list", "claim_id string", [("c1",), ("c2",)])
plant(
    "root_list",
    "root string, basis string, caveat string, events array<string>",
    [("r1", "b", "c", [_id(0)]), ("r2", "b", "", [_id(13), "gone"]), ("r3", None, "c", [])],
)


def _edge(name: str, a: int, b: int, **change: object) -> tuple:
    row = {
        "edge": name, "source": _id(a), "target": _id(b), "evidence": [_id(a)], "type": "mentions", "basis": "explicit-agent-report", "strength": "candidate",
        "explanation": "because", "quote": f"word {a}", "elapsed": None,
    }
    return tuple((row | change).values())


plant(
    "edge_list",
    "edge string, source string, target string, evidence array<string>, type string, basis string, strength string, explanation string, quote string, elapsed string",
    [
        _edge("fine", 0, 1), _edge("gone", 0, 1, target="x"), _edge("back", 3, 2, quote="word 3", evidence=[_id(1), _id(2)]), _edge("type", 0, 2, type="likes", basis="guess"),
        _edge("direct", 0, 2, type="observed_attempt"), _edge("cand", 0, 2, type="candidate_informed_by", strength="explicit-attribution"), _edge("none", 0, 2, evidence=[]),
        _edge("null", 0, 2, evidence=None), _edge("lost", 0, 2, evidence=[_id(0), "x"], quote=""), _edge("future", 0, 2, evidence=[_id(0), _id(3)]), _edge("quiet", 0, 2, quote=""),
        _edge("other", 0, 2, quote="never said"), _edge("tied", 13, 14, quote="word 13", explanation="5 minutes later"), _edge("timed", 0, 1, elapsed="30"), _edge("bad", 9, 11, quote="word 9", elapsed="30"),
        _edge("bare", 0, 2, strength="explicit-attribution", explanation=""), _edge("way1", 0, 2, strength="explicit-attribution", type="endorses"),
        _edge("way2", 2, 12, quote="word 2", strength="explicit-attribution", type="attributes_to"), _edge("away", 0, 14, strength="explicit-attribution"),
        _edge("home", 14, 13, quote="word 14", evidence=[_id(13)], strength="explicit-attribution"), _edge("late", 14, 15, quote="word 14", strength="candidate"),
    ],
)


def _in(column: str, allowed: list[str]) -> str:
    return f"coalesce({column} IN ({', '.join(map(_literal, allowed))}), false)"


def _rules_sql(ident: str, source: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {ident}, {_literal(n)} AS rule FROM {source} WHERE {c}" for n, c in conditions.items())


@query(
    f"WITH {values('evs')}, p AS (SELECT *, regexp_extract(id, '{rules.LOCATOR}', 1) AS l1, regexp_extract(id, '{rules.LOCATOR}', 2) AS l2, regexp_extract(id, '{rules.LOCATOR}', 3) AS l3 FROM evs) "
    + _rules_sql(
        "id",
        "p",
        {
            "locator": f"NOT (l1 = '{SNAPSHOT[:12]}' AND l2 = day::VARCHAR AND l3 = event_index::VARCHAR)",
            "source order": "source_order IS DISTINCT FROM event_index",
            "track": "NOT " + _in("track", rules.TRACKS),
            "stance": "NOT " + _in("stance", rules.STANCES),
            "basis": "NOT " + _in("basis", rules.BASES),
            "outcome": "NOT " + _in("outcome", rules.OUTCOMES),
            "endorsement flag": "coalesce(is_endorsement, false) <> (stance IS NOT DISTINCT FROM 'endorsement')",
            "challenge counted as endorsement": "stance = 'challenge' AND coalesce(is_endorsement, false)",
            "no quote": "coalesce(quote, '') = ''",
            "quote not in text": "coalesce(quote, '') <> '' AND NOT coalesce(contains(text, quote), false)",
            "time of bad quality": _in("time_quality", rules.BAD_TIMES) + " AND ts IS NOT NULL",
        },
    )
)
def dq_event_rules(spark, sf):
    return rules.violations(local(spark, "evs"), "id", rules.event_rules(SNAPSHOT))


@query(f"WITH {values('evs')}, {values('claim_list')} SELECT id, 'unknown claim' AS rule FROM evs WHERE claim_id NOT IN (SELECT claim_id FROM claim_list)")
def dq_unknown_claims(spark, sf):
    return rules.unknown_claims(local(spark, "evs"), local(spark, "claim_list"))


_EDGE_FACTS = (
    f"""WITH {values('evs')}, {values('edge_list')}, v AS (SELECT edge, quote AS q, unnest(CASE WHEN len(evidence) > 0 THEN evidence ELSE [NULL] END) AS id FROM edge_list),
    c AS (SELECT v.edge, max((e.day, e.event_index)) AS last, bool_and(e.id IS NOT NULL) AS all_cited, bool_or(coalesce(contains(e.text, v.q), false)) AS quoted
      FROM v LEFT JOIN evs e ON v.id = e.id GROUP BY v.edge),
    f AS (SELECT g.*, s.id IS NOT NULL AND t.id IS NOT NULL AS found, coalesce(c.all_cited, false) AS cited, c.last, coalesce(c.quoted, false) AS quoted, (s.day, s.event_index) AS sat, (t.day, t.event_index) AS tat,
      s.ts IS NULL OR t.ts IS NULL OR s.ts = t.ts OR """
    + _in("t.time_quality", rules.BAD_TIMES)
    + """ AS timeless,
      coalesce(elapsed, '') NOT IN ('', '0', 'false', 'False', 'None') OR regexp_matches(coalesce(explanation, '') || ' ' || coalesce(g.quote, ''), '"""
    + T.DURATION
    + """') AS passed
      FROM edge_list g LEFT JOIN evs s ON g.source = s.id LEFT JOIN evs t ON g.target = t.id LEFT JOIN c USING (edge)) """
)


@query(
    _EDGE_FACTS
    + _rules_sql(
        "edge",
        "f",
        {
            "unknown endpoint": "NOT found",
            "backward": "found AND tat < sat",
            "type": "found AND NOT " + _in("type", rules.EDGE_TYPES),
            "basis or strength": f"found AND (NOT {_in('basis', rules.BASES)} OR NOT {_in('strength', rules.STRENGTHS)})",
            "direct evidence needed": f"found AND {_in('type', rules.DIRECT_TYPES)} AND basis IS DISTINCT FROM 'direct-logged-event'",
            "candidate marked explicit": "found AND type = 'candidate_informed_by' AND strength = 'explicit-attribution'",
            "unknown evidence": "found AND NOT cited",
            "evidence from the future": "found AND cited AND last > tat",
            "no quote": "found AND cited AND coalesce(quote, '') = ''",
            "quote not in evidence": "found AND cited AND coalesce(quote, '') <> '' AND NOT quoted",
            "duration without times": "found AND cited AND timeless AND passed",
            "attribution without explanation": "found AND cited AND strength = 'explicit-attribution' AND coalesce(explanation, '') = ''",
        },
    )
)
def dq_edge_rules(spark, sf):
    return rules.edge_violations(local(spark, "edge_list"), local(spark, "evs"))


@query(
    f"WITH {values('evs')}, {values('root_list')} "
    + _rules_sql(
        "root",
        "root_list",
        {
            "no basis or caveat": "coalesce(basis, '') = '' OR coalesce(caveat, '') = ''",
            "cites no event": "len(events) = 0",
            "cites an absent event": "len(list_filter(events, lambda x: x NOT IN (SELECT id FROM evs))) > 0",
        },
    ).replace("len(list_filter(events, lambda x: x NOT IN (SELECT id FROM evs))) > 0", "EXISTS (SELECT 1 FROM (SELECT unnest(events) AS x) u WHERE x NOT IN (SELECT id FROM evs))")
)
def dq_root_rules(spark, sf):
    return rules.root_violations(local(spark, "root_list"), local(spark, "evs"))


@query(
    f"""WITH RECURSIVE {values('evs')}, {values('root_list')}, {values('edge_list')},
    p AS (SELECT id, (day, event_index) AS place FROM evs), s AS (SELECT source, target FROM edge_list WHERE strength = 'explicit-attribution' AND {_in('type', rules.LINEAGE_TYPES)}),
    b AS (SELECT root, unnest(events) AS id FROM root_list),
    r(root, id, place) AS (SELECT root, id, place FROM b JOIN p USING (id) UNION SELECT r.root, p.id, greatest(r.place, p.place) FROM r JOIN s ON r.id = s.source JOIN p ON p.id = s.target),
    l AS (SELECT DISTINCT r.root, r.id FROM r JOIN p ON p.id = r.id AND p.place = r.place),
    f AS (SELECT e.id, root_family IN (SELECT root FROM root_list) AS known, coalesce(root_reason, '') = '' AS bare, (root_family, e.id) IN (SELECT (root, id) FROM l) AS led FROM evs e WHERE root_family IS NOT NULL) """
    + _rules_sql("id", "f", {"unknown family": "NOT known", "family without reason": "known AND bare", "no explicit path": "known AND NOT led"})
)
def dq_lineage(spark, sf):
    return rules.family_violations(local(spark, "evs"), local(spark, "root_list"), local(spark, "edge_list"))


@query(
    f"""WITH {values('evs')}, k AS (SELECT *, row_number() OVER (PARTITION BY observation, speaker, stance ORDER BY day, event_index) = 1 AS once FROM evs)
    SELECT observation, row_number() OVER w - 1 AS step, id, sum((stance = 'endorsement' AND once)::INT) OVER s::BIGINT AS endorsers, sum((outcome = 'result-reported')::INT) OVER s::BIGINT AS checks,
    sum((stance = 'endorsement')::INT) OVER s::BIGINT AS endorsements, sum((stance = 'endorsement' AND root_family IS NOT NULL)::INT) OVER s::BIGINT AS rooted
    FROM k WINDOW w AS (PARTITION BY observation ORDER BY day, event_index), s AS (PARTITION BY observation ORDER BY day, event_index ROWS UNBOUNDED PRECEDING)"""
)
def replay_metrics(spark, sf):
    return rules.replay(local(spark, "evs"))


plant(
    "observations",
    "id string, raw string, status string, review_status string, snapshot_id string, phenomenon string, permission_status string, redaction_review string",
    [
        ("o1", '{"id": 1, "title": "t", "question": "", "summary": "", "phenomenon": "x", "scope": {}, "claims": [], "events": [], "roots": [], "edges": [], "artifacts": []}', "exploratory", "awaiting-human-review", SNAPSHOT, "idea-lineage", "unconfirmed", "pending"),
        ("o2", '{"id": 2, "claims": null, "extra": 1}', "final", "awaiting-human-review", "x", "boundary-case", "given", "pending"),
        ("o3", "not json", None, "done", SNAPSHOT, "guess", "unconfirmed", None),
    ],
)


@query(
    f"WITH {values('observations')} "
    + _rules_sql(
        "id",
        "observations",
        {
            "status": "status IS DISTINCT FROM 'exploratory'",
            "review status": "review_status IS DISTINCT FROM 'awaiting-human-review'",
            "snapshot": f"snapshot_id IS DISTINCT FROM '{SNAPSHOT}'",
            "phenomenon": "NOT " + _in("phenomenon", rules.PHENOMENA),
            "permission": "permission_status IS DISTINCT FROM 'unconfirmed'",
            "redaction": "redaction_review IS DISTINCT FROM 'pending'",
        },
    )
)
def dq_observation_rules(spark, sf):
    return rules.violations(local(spark, "observations"), "id", rules.observation_rules(SNAPSHOT))


@query(
    f"WITH {values('observations')}, k AS (SELECT id, CASE WHEN json_valid(raw) THEN json_keys(raw) ELSE []::VARCHAR[] END AS held FROM observations), "
    f"r AS (SELECT unnest({_literal(rules.REQUIRED)}) AS field) SELECT id, field FROM k, r WHERE NOT list_contains(held, field)"
)
def dq_required_fields(spark, sf):
    return local(spark, "observations").select("id", F.explode(rules.missing_keys(F.col("raw"))).alias("field"))


@query(f"WITH {values('evs')}, d AS (SELECT observation, speaker, stance FROM evs) SELECT observation, speaker, stance, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1")
def dq_repeated_keys(spark, sf):
    return rules.repeated_keys(local(spark, "evs"), ["observation", "speaker", "stance"])


plant(
    "things",
    "artifact string, events array<string>, description string, path string, namespace string",
    [("a1", [_id(0)], "made", "/tmp/x", ""), ("a2", ["gone"], "verified-read it", "/tmp/x", "n"), ("a3", [_id(1), "gone"], "consumed", "rel/x", None), ("a4", [], "made", "/tmp/y", None)],
)


@query(
    f"""WITH {values('evs')}, {values('things')} SELECT DISTINCT artifact, 'unknown event' AS rule FROM (SELECT artifact, unnest(events) AS id FROM things) WHERE id NOT IN (SELECT id FROM evs)
    UNION ALL SELECT artifact, 'claims a reading' FROM things WHERE regexp_matches(description, '{T.READ_CLAIM}')
    UNION ALL SELECT artifact, 'repeated path without namespace' FROM things WHERE coalesce(namespace, '') = '' AND path IN (SELECT path FROM things WHERE starts_with(path, '/') GROUP BY path HAVING count(*) > 1)"""
)
def dq_artifacts(spark, sf):
    return rules.artifact_violations(local(spark, "things"), local(spark, "evs"))


plant("scenes", "id string, step long", [*((_id(n), n) for n in range(12)), (_id(3), 3), (_id(12), 13), ("ghost", 14), (_id(14), 14)])


@query(
    f"""WITH {values('evs')}, {values('scenes')}, e AS (SELECT id, row_number() OVER (ORDER BY day, event_index) - 1 AS expected FROM evs),
    s AS (SELECT id, count(*) AS n, min(step) AS step FROM scenes GROUP BY id), b AS (SELECT * FROM e FULL JOIN s USING (id)) """
    + _rules_sql("id", "b", {"not shown": "n IS NULL", "shown more than once": "n > 1", "unknown event": "expected IS NULL", "wrong step": "step <> expected"})
)
def dq_scenes(spark, sf):
    return rules.scene_violations(local(spark, "scenes"), local(spark, "evs"))


@query(
    """WITH s AS (SELECT doc_id AS event_index, CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 30 = 0 THEN 'x' ELSE lang END AS lang FROM documents
    UNION ALL SELECT -1, 'x', 'x'), d AS (SELECT doc_id AS event_index, text, lang FROM documents)
    SELECT s.event_index, 'no source' AS field FROM s LEFT JOIN d USING (event_index) WHERE d.event_index IS NULL
    UNION ALL SELECT s.event_index, 'text' FROM s JOIN d USING (event_index) WHERE s.text IS DISTINCT FROM d.text
    UNION ALL SELECT s.event_index, 'lang' FROM s JOIN d USING (event_index) WHERE s.lang IS DISTINCT FROM d.lang"""
)
def dq_verbatim(spark, sf):
    source = document_messages(spark, sf).select("event_index", "text", "lang")
    text = F.when(F.col("event_index") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    lang = F.when(F.col("event_index") % 30 == 0, "x").otherwise(F.col("lang"))
    stored = source.select("event_index", text.alias("text"), lang.alias("lang"))
    stored = stored.union(spark.createDataFrame([(-1, "x", "x")], "event_index long, text string, lang string"))
    return rules.verbatim_violations(stored, source, ["event_index"], ["text", "lang"])


@query(
    """WITH c AS (SELECT ts::DATE AS date, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1),
    s AS (SELECT strftime(date, '%Y-%m-%d') AS day, (n + CASE WHEN day(date) = 3 THEN 1 ELSE 0 END)::DOUBLE AS n, mean + CASE WHEN day(date) % 2 = 0 THEN 0.1 ELSE 0.2 END AS mean FROM c)
    SELECT s.day, 'n' AS value FROM s JOIN c ON s.day = strftime(c.date, '%Y-%m-%d') WHERE abs(s.n - c.n) > 0.11 UNION ALL
    SELECT s.day, 'mean' FROM s JOIN c ON s.day = strftime(c.date, '%Y-%m-%d') WHERE abs(s.mean - c.mean) > 0.11"""
)
def dq_recomputed(spark, sf):
    """Stored statistics of days, some of them off, against those of the events, within 0.11."""
    per = timeline(spark, sf).groupBy(F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"))
    number = F.dayofmonth(F.col("day").cast("date"))
    stored = per.select("day", (F.col("n") + F.when(number == 3, 1.0).otherwise(0.0)).alias("n"), (F.col("mean") + F.when(number % 2 == 0, 0.1).otherwise(0.2)).alias("mean"))
    return rules.mismatches(stored, per, "day", ["n", "mean"], 0.11).select("day", "value")


@query(
    r"""WITH d AS (SELECT doc_id // 50 AS day, doc_id AS event_index, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents),
    g AS (SELECT day, norm || CASE WHEN day % 2 = 0 THEN '' ELSE '?' END AS norm, list(event_index ORDER BY event_index)[1:6] || [-1] AS examples FROM d WHERE length(norm) >= 80 GROUP BY day, d.norm HAVING count(*) > 1),
    c AS (SELECT day, norm, unnest(examples) AS event_index FROM g)
    SELECT c.day, c.event_index, 'no such row' AS rule FROM c LEFT JOIN d USING (day, event_index) WHERE d.day IS NULL
    UNION ALL SELECT c.day, c.event_index, 'another normal form' FROM c JOIN d USING (day, event_index) WHERE d.norm <> c.norm"""
)
def dq_duplicate_examples(spark, sf):
    """Duplicate groups of which every second day's norm is off and each cites one row that there is not."""
    rows = document_messages(spark, sf)
    found = messages.duplicates(rows)
    norm = F.when(F.col("day") % 2 == 0, F.col("norm")).otherwise(F.concat("norm", F.lit("?")))
    return rules.example_violations(found.select("day", norm.alias("norm"), F.concat("examples", F.array(F.lit(-1).cast("long"))).alias("examples")), rows)


plant(
    "cascade_list",
    "date string, key string, agents long, span_minutes double, minutes array<double>, actors array<string>",
    [
        ("d1", "fine", 3, 40.0, [0.0, 10.5, 40.0], ["a", "b", "c"]), ("d1", "few", 2, 5.0, [0.0, 5.0], ["a", "b"]), ("d2", "twice", 3, 5.0, [0.0, 1.0, 5.0], ["a", "b", "b"]),
        ("d2", "late", 3, 50.0, [2.0, 1.0, 50.0], ["a", "b", "c"]), ("d3", "long", 3, 61.0, [0.0, 1.0, 61.0], ["a", "b", "c"]), ("d3", "off", 3, 9.0, [0.0, 1.0, 8.0], ["a", "b", "c"]),
    ],
)


@query(
    f"WITH {values('cascade_list')} "
    + _rules_sql(
        "date, key",
        "cascade_list",
        {
            "too few": "len(list_distinct(actors)) < 3",
            "count": "agents <> len(list_distinct(actors))",
            "order": "minutes <> list_sort(minutes)",
            "start": "minutes[1] <> 0",
            "span": "abs(span_minutes - list_max(minutes)) > 0.011 OR span_minutes > 60",
        },
    )
)
def dq_cascades(spark, sf):
    sequence = F.zip_with("minutes", "actors", lambda m, a: F.struct(m.alias("minutes"), a.alias("actor")))
    return rules.cascade_violations(local(spark, "cascade_list").withColumn("sequence", sequence))


# --- transfer of work -----------------------------------------------------------------------------------

_PRED = """WITH m AS (SELECT doc_id // 50 AS day, doc_id AS event_index, source AS speaker, text, sha256(text) AS text_hash FROM documents),
    f AS (SELECT sha256(d.text) AS text_hash, arg_min(l.quality, d.doc_id) AS quality, arg_min(l.toxic, d.doc_id) AS needs_review FROM documents d JOIN labels l USING (doc_id) GROUP BY 1),
    p AS (SELECT text_hash, 'q' || quality AS label, needs_review FROM f) """


@query(
    _PRED[:-1]
    + """, u AS (SELECT text_hash, min(day) AS day, min(event_index) AS e, min(text) AS text FROM m WHERE text_hash NOT IN (SELECT text_hash FROM p) GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY day, e, text_hash) - 1 AS position FROM u)
    SELECT 'pending-' || lpad((position // 256)::VARCHAR, 5, '0') AS shard, position, text_hash, length(text) AS n_chars FROM n"""
)
def pending_shards(spark, sf):
    found = transfer.pending_shards(document_messages(spark, sf), document_predictions(spark, sf), RUN)
    return found.select("shard", "position", "text_hash", F.length("text").cast("long").alias("n_chars"))


@query(
    """WITH t AS (SELECT sha256(text) AS text_hash, min(doc_id // 50) AS day, min(doc_id) AS e FROM documents GROUP BY 1), a AS (SELECT text_hash FROM t ORDER BY text_hash LIMIT 48),
    b AS (SELECT text_hash FROM t WHERE text_hash NOT IN (SELECT text_hash FROM a) ORDER BY day, e LIMIT 20)
    SELECT 'pilot-48' AS pilot, text_hash FROM a UNION ALL SELECT 'pilot-68', text_hash FROM a UNION ALL SELECT 'pilot-68', text_hash FROM b"""
)
def pilot_texts(spark, sf):
    return transfer.pilots(document_messages(spark, sf))


plant("pilot_list", "id string, count long, importable boolean", [("pilot-48", 48, False), ("pilot-68", 68, False), ("pilot-90", 90, False), ("pending-00000", 256, True)])


@query(f"WITH {values('pilot_list')} SELECT id, count, importable FROM pilot_list WHERE NOT importable ORDER BY count <> 68, count DESC, id LIMIT 1")
def chosen_pilot(spark, sf):
    return transfer.chosen_pilot(local(spark, "pilot_list"))


plant(
    "shard_lines",
    "line long, value string",
    [
        (1, f'{{"text_hash": "{_sha("one")}", "text": "one"}}'), (2, ""), (3, '{"text_hash": "abc", "text": "two"}'), (4, f'{{"text_hash": "{_sha("x")}", "text": 5}}'),
        (5, f'{{"text_hash": "{_sha("five")}", "text": "six"}}'), (6, f'{{"text_hash": "{_sha("one")}", "text": "one"}}'), (7, f'{{"text_hash": "{_sha("é")}", "text": "é"}}'), (8, "   "),
    ],
)


@query(
    f"""WITH {values('shard_lines')}, p AS (SELECT line, trim(value) = '' AS blank, CASE WHEN trim(value) <> '' THEN value END AS v FROM shard_lines),
    q AS (SELECT line, blank, json_extract_string(v, '$.text_hash') AS h, json_extract_string(v, '$.text') AS t, json_type(v, '$.text') AS k FROM p),
    r AS (SELECT *, coalesce(regexp_matches(h, '{transfer.HASH}'), false) AS hashed, coalesce(k = 'VARCHAR', false) AS string, count(*) OVER (PARTITION BY h) AS n FROM q) """
    + _rules_sql(
        "line",
        "r",
        {
            "blank": "blank",
            "bad hash": "NOT blank AND NOT hashed",
            "text is no string": "NOT blank AND NOT string",
            "text hashes otherwise": "hashed AND string AND sha256(t) <> h",
            "repeated hash": "hashed AND n > 1",
        },
    )
)
def dq_strict_shard(spark, sf):
    return transfer.strict_violations(local(spark, "shard_lines"))


plant("manifest_files", "file string, count long, sha256 string", [(f"f{i}", 10 + i, _sha(str(i))) for i in range(6)] + [("f9", 1, "short")])
plant("real_files", "file string, rows long, sha256 string", [(f"f{i}", 10 + i + (i == 2), _sha(str(i + (i == 3)))) for i in range(1, 6)] + [("x", 1, _sha("x")), ("f9", 1, "short")])


@query(
    f"""WITH {values('manifest_files')}, {values('real_files')}, j AS (SELECT coalesce(m.file, f.file) AS file, m.file IS NOT NULL AS named, f.file IS NOT NULL AS there, m.count, f.rows, m.sha256 AS a, f.sha256 AS b
    FROM manifest_files m FULL JOIN real_files f ON m.file = f.file) """
    + _rules_sql(
        "file",
        "j",
        {
            "missing": "named AND NOT there",
            "not in the manifest": "there AND NOT named",
            "bad digest": f"named AND NOT regexp_matches(a, '{transfer.HASH}')",
            "another digest": "named AND there AND a <> b",
            "another count": "named AND there AND count <> rows",
        },
    )
)
def dq_manifest(spark, sf):
    return transfer.manifest_violations(local(spark, "manifest_files"), local(spark, "real_files"))


def _condition(ident: str, base: str, condition: str, text: str, **change: object) -> tuple:
    row = {"id": ident, "base_text_hash": _sha(base), "condition": condition, "speaker": "Ada", "target": base, "text": text, "text_hash": _sha(text)}
    return tuple((row | change).values())


plant(
    "experiment",
    "id string, base_text_hash string, condition string, speaker string, target string, text string, text_hash string",
    [
        _condition("a1", "hi", "isolated", "hi"), _condition("a2", "hi", "real_context", "before hi"), _condition("a3", "hi", "shuffled_context", "other hi"),
        _condition("b1", "yo", "isolated", "Previous messages:\n\nCurrent message:\nAda: yo"), _condition("b2", "yo", "real_context", "yo there"), _condition("b2", "yo", "shuffled_context", "a yo"),
        _condition("c1", "so", "isolated", "x so", base_text_hash="XY"), _condition("c2", "so", "invented", "x so"), _condition("", "so", "real_context", "x so", text_hash="0"),
        _condition("d1", "", "isolated", ""),
    ],
)


@query(
    f"""WITH {values('experiment')}, b AS (SELECT base_text_hash, count(DISTINCT CASE WHEN {_in('condition', transfer.CONDITIONS)} THEN condition END) AS c, count(*) AS k FROM experiment GROUP BY 1),
    r AS (SELECT x.*, b.c, b.k, count(*) OVER (PARTITION BY id) AS n FROM experiment x JOIN b USING (base_text_hash)) """
    + _rules_sql(
        "id",
        "r",
        {
            "id": "id = '' OR n > 1",
            "condition": "NOT " + _in("condition", transfer.CONDITIONS),
            "target": "coalesce(target, '') = '' OR text IS NULL",
            "isolated text": "condition = 'isolated' AND text <> target AND text <> 'Previous messages:\n\nCurrent message:\n' || speaker || ': ' || target",
            "target not at the end": "condition <> 'isolated' AND NOT ends_with(text, target)",
            "text hash": "sha256(text) <> text_hash",
            "base hash": f"NOT regexp_matches(base_text_hash, '{transfer.HASH}')",
            "conditions of the base": "c <> 3 OR k <> 3",
        },
    )
)
def dq_experiment(spark, sf):
    return transfer.experiment_violations(local(spark, "experiment"))


plant("sent", "text_hash string, text string", [(_sha(t), t) for t in ("one", "two", "three", "four")])
plant("indexed_texts", "text_hash string, text string", [(_sha("one"), "one"), (_sha("one"), "one"), (_sha("two"), "TWO"), (_sha("four"), "four"), (_sha("nine"), "nine")])
plant("answers", "text_hash string, low double, n_acts long", [(_sha("one"), 0.1, 12), (_sha("two"), 0.1, 12), (_sha("two"), 0.2, 12), (_sha("four"), -0.1, 12), (_sha("nine"), 0.1, 11)])


@query(
    f"""WITH {values('sent')}, {values('indexed_texts')}, {values('answers')}, a AS (SELECT text_hash, count(*) AS n, bool_and(low >= 0 AND n_acts = 12) AS fit FROM answers GROUP BY 1),
    k AS (SELECT text_hash, min(text) AS known FROM indexed_texts WHERE text_hash IN (SELECT text_hash FROM sent) GROUP BY 1),
    r AS (SELECT text_hash, n, fit, text AS sent, known FROM a FULL JOIN sent USING (text_hash) LEFT JOIN k USING (text_hash)) """
    + _rules_sql(
        "text_hash",
        "r",
        {
            "no result": "n IS NULL",
            "not of the shard": "sent IS NULL",
            "more than one result": "n > 1",
            "invalid scores": "NOT fit",
            "not in the index": "sent IS NOT NULL AND known IS NULL",
            "another text in the index": "sent <> known",
        },
    )
)
def dq_import(spark, sf):
    """Why a shard of results is not imported."""
    acts = F.slice(F.array(*[F.lit(a) for a in scores.ACTS]), 1, F.col("n_acts").cast("int"))
    told = local(spark, "answers").select("text_hash", F.map_from_arrays(acts, F.transform(acts, lambda _: F.col("low"))).alias("scores"))
    return transfer.result_violations(told, local(spark, "sent"), local(spark, "indexed_texts"))


plant("waves", "id string, seconds double, rate double, rows long", [("w1", 621.742, 0.000309, 78576), ("w2", 471.33, 0.000309, 68164), ("w3", 0.0, 0.001, 0)])


@query(f"WITH {values('waves')} SELECT id, round(8 * (seconds + 20) * rate, 3) AS ceiling FROM waves UNION ALL SELECT 'all', round(sum(round(8 * (seconds + 20) * rate, 3)), 3) FROM waves")
def cost_ceilings(spark, sf):
    per = local(spark, "waves").select("id", transfer.cost_ceiling(F.col("seconds"), F.col("rate")).alias("ceiling"))
    return per.union(per.agg(F.lit("all"), F.round(F.sum("ceiling"), 3)))


@query(f"WITH {values('waves')} SELECT sum(rows)::BIGINT AS rows, sum(seconds) AS seconds, CASE WHEN sum(seconds) > 0 THEN round(sum(rows) / sum(seconds), 6) END AS per_second FROM waves")
def throughput(spark, sf):
    return parity.throughput(local(spark, "waves")).withColumn("per_second", F.round("per_second", 6))


plant("progress", "id string, recorded string, done_now long, rate double, total long, done long, alive boolean, same_run boolean", [
    ("a", "running", 31, 2.0, 100, 31, True, True), ("b", "running", 32, 2.0, 100, 40, True, True), ("c", "running", 64, 0.0, 100, 64, False, True),
    ("d", "complete", 64, 3.0, 100, 64, False, True), ("e", "complete", 64, 3.0, 64, 64, False, True), ("f", "running", 64, 3.0, 64, 70, True, False),
])


@query(
    f"""WITH {values('progress')} SELECT id, CASE WHEN NOT same_run THEN 'run_replaced' WHEN recorded = 'complete' AND total - done > 0 THEN 'incomplete'
    WHEN recorded = 'running' AND NOT alive THEN 'interrupted' ELSE recorded END AS state,
    CASE WHEN done_now >= 32 AND rate > 0 THEN round(greatest(0, total - done) / rate)::BIGINT END AS remaining FROM progress"""
)
def run_progress(spark, sf):
    c = F.col
    state = index.run_state(c("recorded"), c("total") - c("done"), c("alive"), c("same_run"))
    left = index.remaining_seconds(c("done_now"), c("rate"), c("total"), c("done"))
    return local(spark, "progress").select("id", state.alias("state"), left.alias("remaining"))


@query(_PRED + "SELECT label, count(*) AS n, sum(needs_review)::BIGINT AS needs_review, count(*) FILTER (needs_review = 1 AND label = 'q0') AS truncated FROM m JOIN p USING (text_hash) GROUP BY label ORDER BY n DESC, label")
def label_totals(spark, sf):
    found = document_predictions(spark, sf).withColumn("truncated", ((F.col("needs_review") == 1) & (F.col("label") == "q0")).cast("long"))
    return index.label_totals(document_messages(spark, sf), found, RUN)


plant("tagged", "run_id string, result string", [("r", '{"execution_epoch_id": 1}'), ("r", '{"a": 1}'), ("r", "{}"), ("s", "{}"), ("r", None)])


@query(f"WITH {values('tagged')} SELECT count(*) FILTER (result NOT LIKE '%\"execution_epoch_id\"%') AS untagged FROM tagged WHERE run_id = 'r'")
def untagged_predictions(spark, sf):
    return index.untagged(local(spark, "tagged"), "r")


@query(_PRED + "SELECT DISTINCT day, event_index FROM m WHERE text_hash IN (SELECT text_hash FROM p WHERE label = 'q1')")
def classified_semi(spark, sf):
    good = document_predictions(spark, sf).where("label = 'q1'").select("text_hash")
    return document_messages(spark, sf).join(good, "text_hash", "left_semi").select("day", "event_index")


# --- scores -------------------------------------------------------------------------------------------------

plant(
    "votes",
    "id string, s array<double>, text string, truncated boolean",
    [
        ("clear", [0.1] * 3 + [0.9] + [0.05] * 8, "words", False), ("edge", [0.55, 0.4] + [0.1] * 10, "words", False), ("low", [0.54] + [0.1] * 11, "words", False),
        ("tie", [0.7, 0.7] + [0.6] * 2 + [0.1] * 8, "words", False), ("cut", [0.8] + [0.1] * 11, "words", True), ("blank", [0.2] * 11 + [0.9], "  ", False), ("null", [0.2] * 11 + [0.9], None, True),
        ("over", [1.2] + [0.1] * 11, "words", False), ("short", [0.9] + [0.1] * 10, "words", False), ("one", [0.12] * 5 + [0.05] * 6 + [0.1], "words", False),
    ],
)
_ACTS = _literal(scores.ACTS)


def _votes(spark: SparkSession) -> DataFrame:
    acts = F.slice(F.array(*[F.lit(a) for a in scores.ACTS]), 1, F.size("s"))
    return local(spark, "votes").withColumn("scores", F.map_from_arrays(acts, "s"))


@query(
    f"""WITH {values('votes')}, o AS (SELECT *, list_reverse_sort(s) AS d FROM votes),
    k AS (SELECT *, ({_ACTS})[list_position(s, d[1])] AS label, list_filter([CASE WHEN d[1] < 0.55 THEN 'low_top_score' END, CASE WHEN d[1] - d[2] < 0.15 THEN 'small_margin' END,
      CASE WHEN truncated THEN 'truncated' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' END], lambda x: x IS NOT NULL) AS reasons FROM o WHERE len(s) = 12),
    t AS (SELECT id, string_agg(({_ACTS})[i], ',' ORDER BY s[i] DESC, i) AS templates FROM votes, range(1, 13) x(i) WHERE len(s) = 12 AND s[i] >= 0.5 GROUP BY id)
    SELECT id, label, d[1] AS top_score, round(d[1] - d[2], 6) AS margin, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS needs_review,
    CASE WHEN len(reasons) > 0 THEN 'uncertain' ELSE label END AS primary_act, coalesce(templates, '') AS templates FROM k LEFT JOIN t USING (id)"""
)
def review_rule(spark, sf):
    rows = _votes(spark).where(F.size("s") == 12)
    found = rows.select("id", scores.review(F.col("scores"), F.col("text"), F.col("truncated")).alias("r")).select("id", "r.*")
    return found.withColumns({"margin": F.round("margin", 6), "reasons": F.array_join("reasons", ","), "templates": F.array_join("templates", ",")})


@query(
    f"""WITH {values('votes')} SELECT id, len(s) = 12 AND len(list_filter(s, lambda x: x < 0 OR x > 1)) = 0 AS valid,
    len(s) = 12 AND len(list_filter(s, lambda x: x < 0 OR x > 1)) = 0 AND abs(list_sum(s) - 1) <= 0.001 AS one_choice FROM votes"""
)
def dq_scores(spark, sf):
    return _votes(spark).select("id", scores.valid(F.col("scores")).alias("valid"), scores.forced_choice(F.col("scores")).alias("one_choice"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda a: exp(a - list_max(v))) AS r FROM e)
    SELECT vec_id, round(list_max(r) / list_sum(r), 9) AS top, round(list_min(r) / list_sum(r), 9) AS least FROM x"""
)
def softmax_shares(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", scores.softmax(F.col("embedding").cast("array<double>")).alias("s"))
    return rows.select("vec_id", F.round(F.array_max("s"), 9).alias("top"), F.round(F.array_min("s"), 9).alias("least"))


plant(
    "cuts",
    "id string, raw string",
    [
        ("old", '{"truncated": true, "perHypothesis": {"a": {"message": true, "message_tokens_dropped": 7}, "b": {"message": false}}}'),
        ("new", '{"message": true, "message_tokens_dropped_max": 3, "per_hypothesis": {"a": {"message": true, "message_tokens_dropped": 3, "hypothesis": false, "hypothesis_tokens_dropped": 0}}}'),
        ("bare", "{}"), ("both", '{"truncated": false, "message": true, "perHypothesis": {}}'), ("list", "[1]"), ("bad", "{oops"), ("null", None),
    ],
)


@query(
    f"""WITH {values('cuts')}, j AS (SELECT id, CASE WHEN json_valid(raw) AND raw LIKE '{{%' THEN raw END AS r FROM cuts),
    p AS (SELECT id, r, coalesce(json_extract(r, '$.perHypothesis'), json_extract(r, '$.per_hypothesis'), '{{}}'::JSON) AS per FROM j WHERE r IS NOT NULL),
    k AS (SELECT id, r, list_transform(json_keys(per), lambda a: coalesce(json_extract(per, '$.' || a || '.message_tokens_dropped')::BIGINT, 0)) AS dropped, json_keys(per) AS acts,
      list_transform(json_keys(per), lambda a: coalesce(json_extract(per, '$.' || a || '.message')::BOOLEAN, false)) AS flags FROM p)
    SELECT id, coalesce(json_extract(r, '$.truncated')::BOOLEAN, json_extract(r, '$.message')::BOOLEAN, false) AS message,
    coalesce(json_extract(r, '$.message_tokens_dropped_max')::BIGINT, list_max(dropped), 0)::INT AS dropped_max, array_to_string(acts, ',') AS acts, len(list_filter(flags, lambda x: x)) AS cut FROM k"""
)
def truncation_reports(spark, sf):
    rows = local(spark, "cuts").select("id", scores.truncation(F.col("raw")).alias("t")).where(F.col("t").isNotNull())
    per = F.col("t.per_hypothesis")
    cut = F.size(F.filter(F.map_values(per), lambda d: d["message"])).cast("long")
    return rows.select("id", F.col("t.message").alias("message"), F.col("t.message_tokens_dropped_max").alias("dropped_max"), F.array_join(F.array_sort(F.map_keys(per)), ",").alias("acts"), cut.alias("cut"))


_SPLIT = r"WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '') AS t FROM documents) "


@query(
    _SPLIT
    + r"""SELECT doc_id, md5(CASE WHEN len(t) > 64 THEN array_to_string(t[1:32], ' ') || chr(10) || '[... ' || (len(t) - 64) || ' middle message tokens omitted ...]' || chr(10) || array_to_string(t[-32:], ' ') ELSE text END) AS body,
    len(t) > 64 AS message, len(t)::INT AS message_tokens, greatest(0, len(t) - 64)::INT AS message_tokens_dropped FROM w"""
)
def middle_omitted(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", prepare.middle_omitted(F.col("text"), 64).alias("b"))
    return rows.select("doc_id", F.md5("b.text").alias("body"), "b.message", "b.message_tokens", "b.message_tokens_dropped")


@query(_SPLIT + "SELECT doc_id, md5(array_to_string(t[1:53], ' ')) AS body, len(t)::INT AS message_tokens, greatest(0, len(t) - 53)::INT AS message_tokens_dropped FROM w")
def pair_first_cut(spark, sf):
    """Message and hypothesis for 64 tokens, of which 8 are the hypothesis's and 3 the model's."""
    made = prepare.pair(F.col("text"), F.lit("This message asks somebody to do some thing"), 64)
    rows = table(spark, sf, "documents").select("doc_id", made.alias("p"))
    return rows.select("doc_id", F.md5("p.text").alias("body"), "p.message_tokens", "p.message_tokens_dropped")


@query(
    r"""WITH w AS (SELECT conv_id * 1000 + turn AS ident, text, list_filter(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '') AS t FROM conversations)
    SELECT ident, md5(CASE WHEN len(t) > 0 THEN 'question: ' || array_to_string(t[1:9], ' ') || ' option: a b c' ELSE 'question: option: a b c' END) AS body, len(t) > 9 AS shortened FROM w"""
)
def question_first(spark, sf):
    rows = conversation_messages(spark, sf).select((F.col("day") * 1000 + F.col("event_index")).alias("ident"), prepare.question_first(F.col("text"), F.lit("a b c"), 18).alias("q"))
    return rows.select("ident", F.md5("q.text").alias("body"), "q.shortened")


plant("condition_labels", "target long, condition string, label string", [(t, c, "ab"[(t * k + k) % 2]) for t in range(30) for k, c in enumerate(["isolated", "real_context", "shuffled_context"]) if (t, k) != (7, 2)])


@query(
    f"""WITH {values('condition_labels')}, w AS (SELECT target, max(label) FILTER (condition = 'isolated') AS i, max(label) FILTER (condition = 'real_context') AS r, max(label) FILTER (condition = 'shuffled_context') AS s
    FROM condition_labels GROUP BY 1) SELECT 'real_context' AS condition, count(*) AS targets, count(*) FILTER (r IS DISTINCT FROM i) AS changed FROM w
    UNION ALL SELECT 'shuffled_context', count(*), count(*) FILTER (s IS DISTINCT FROM i) FROM w"""
)
def label_changes(spark, sf):
    return parity.label_changes(local(spark, "condition_labels"), "isolated", ["real_context", "shuffled_context"])


plant("shard_meta", "shard long, key string, value string", [(s, k, v) for s in range(3) for k, v in (("model", "m"), ("device", f"d{s % 2}"), ("batch", "16")) if (s, k) != (2, "batch")])


@query(f"WITH {values('shard_meta')} SELECT key, min(value) AS value FROM shard_meta GROUP BY key HAVING count(DISTINCT value) = 1 AND count(DISTINCT shard) = (SELECT count(DISTINCT shard) FROM shard_meta)")
def common_metadata(spark, sf):
    rows = local(spark, "shard_meta").groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    return parity.common_metadata(rows)


@query("SELECT doc_id, 'left only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 1000000000, 'right only' FROM labels WHERE toxic = 1")
def key_mismatches(spark, sf):
    right = table(spark, sf, "labels").select("doc_id")
    more = table(spark, sf, "labels").where("toxic = 1").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"))
    return parity.key_mismatches(table(spark, sf, "documents").select("doc_id"), right.union(more), "doc_id")


plant("reports", "id string, pairs long, same_top long, max_delta double", [("good", 48, 48, 0.02), ("few", 47, 47, 0.0), ("flip", 68, 67, 0.001), ("far", 68, 68, 0.0201)])


@query(f"WITH {values('reports')} SELECT id, pairs >= 48 AND same_top = pairs AND max_delta <= 0.02 AS approved FROM reports")
def parity_gate(spark, sf):
    return local(spark, "reports").select("id", parity.approved(F.struct("*")).alias("approved"))


# --- audits ---------------------------------------------------------------------------------------------------

plant(
    "raw_events",
    "n long, label string, raw string",
    [
        (0, "Ada", '{"type": "AGENT_TALK", "agentId": 1, "content": "a", "day": 1, "index": 2, "text": "x"}'), (1, "Ada", '{"type": "WAIT", "AGENTID": 2}'),
        (2, "Bo", '{"speaker_id": 5, "agentId": 1, "type": "WAIT"}'), (3, "Bo", '{"type": "AGENT_TALK", "content": "b", "agentId": 4, "day": {"text": "y", "index": 3, "day": 2}}'),
        (4, None, '{"instance_id": null, "list": [{"day": 1, "index": 0, "text": "z"}, 5, [{"text": "deep", "index": 9, "day": 9}]]}'), (5, "Cy", "{}"),
    ],
)


def _raw(spark: SparkSession) -> DataFrame:
    return local(spark, "raw_events").withColumn("raw", F.parse_json("raw"))


@query(f"WITH {values('raw_events')} SELECT array_to_string(list_sort(json_keys(raw)), ',') AS shape, count(*) AS n FROM raw_events GROUP BY 1 ORDER BY n DESC, shape LIMIT 20")
def key_shapes(spark, sf):
    return audit.shapes(_raw(spark))


@query(
    f"WITH {values('raw_events')}, k AS (SELECT label, unnest(list_distinct(list_transform(json_keys(raw), lambda x: lower(x)))) AS key FROM raw_events) SELECT label, key, count(*) AS n FROM k WHERE key IN ({', '.join(map(_literal, audit.ID_KEYS))}) GROUP BY ALL"
)
def id_fields(spark, sf):
    return audit.id_fields(_raw(spark), "label")


@query(
    f"""WITH {values('raw_events')}, t AS (SELECT n, x.value AS v FROM raw_events, json_tree(raw) x WHERE x.type = 'OBJECT')
    SELECT n, json_extract_string(v, '$.day') AS day, json_extract_string(v, '$.index') AS index, json_extract_string(v, '$.text') AS text FROM t
    WHERE list_contains(json_keys(v), 'day') AND list_contains(json_keys(v), 'index') AND list_contains(json_keys(v), 'text')"""
)
def evidence_walk(spark, sf):
    """Objects at any depth that have the keys of evidence."""
    found = audit.objects_with(_raw(spark), "n", "raw", ["day", "index", "text"])
    shown = lambda k: F.try_variant_get("value", f"$.{k}", "string").alias(k)
    return found.select("n", shown("day"), shown("index"), shown("text"))


plant(
    "link_texts",
    "i long, text string",
    [
        (0, "See https://a.example/x/y. and (http://B.example/z), or HTTPS://c.example?q=1!"), (1, "https://a.example/x/y; https://a.example/x/y) twice"),
        (2, "run ./tools/make.py on /var/data/in.csv, then read notes.md."), (3, "a/b.txt and x.json: report.pdf!"), (4, "none here, v1.2.3"),
    ],
)


@query(
    f"""WITH {values('link_texts')}, u AS (SELECT regexp_replace(unnest(regexp_extract_all(text, '(?i)https?://[^\\s\\]\\[()<>"'']+')), '[.,!?;:]+$', '') AS u FROM link_texts)
    SELECT count(*) AS total, count(DISTINCT u) AS distinct FROM u"""
)
def url_links(spark, sf):
    return audit.url_links(local(spark, "link_texts"))


# RE2 has no lookaround, so the planted texts' paths are found by another engine and planted, too.
plant("paths", "path string", [(m,) for _, t in _planted["link_texts"][1] for m in re.findall(T.AUDIT_PATH, t)])


@query(f"WITH {values('paths')} SELECT count(*) AS total, count(DISTINCT path) AS distinct FROM paths")
def path_links(spark, sf):
    return audit.path_links(local(spark, "link_texts"))


plant(
    "stamps",
    "n long, raw string",
    [
        (0, "2026-03-01T12:00:00Z"), (1, "2026-03-01T02:00:00+05:30"), (2, "2026-03-01T12:00:00"), (3, ""), (4, None), (5, "yesterday"), (6, "2026-03-01T07:59:59.5Z"), (7, "2026-07-01T06:59:59Z"),
        (8, "2026-07-01T07:00:00Z"), (9, "2026-13-01T00:00:00Z"),
    ],
)
_STAMPS = f"""WITH {values('stamps')}, q AS (SELECT n, raw, CASE WHEN regexp_matches(raw, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN try_cast(raw AS TIMESTAMPTZ) END AS t FROM stamps),
    k AS (SELECT n, t, CASE WHEN trim(coalesce(raw, '')) = '' THEN 'missing' WHEN t IS NULL THEN 'malformed-or-no-timezone' ELSE 'valid' END AS quality FROM q) """


def _stamps(spark: SparkSession) -> DataFrame:
    raw = F.col("raw")
    return local(spark, "stamps").select("n", times.instant(raw).alias("ts"), times.quality(raw).alias("ts_quality"))


@query(_STAMPS + "SELECT quality AS ts_quality, count(*) AS n, epoch_us(min(t)) AS first, epoch_us(max(t)) AS last FROM k GROUP BY quality")
def time_quality(spark, sf):
    return audit.time_quality(_stamps(spark)).withColumns({c: F.unix_micros(c) for c in ("first", "last")})


@query(
    _STAMPS
    + """SELECT n, strftime(CASE WHEN t IS NOT NULL THEN make_timestamp(epoch_us(t) - 3600000000 * CASE WHEN epoch_us(t) >= epoch_us(TIMESTAMP '2026-03-08 10:00:00') THEN 7 ELSE 8 END) END, '%Y-%m-%d') AS date FROM k"""
)
def pacific_dates(spark, sf):
    """Dates on the Pacific coast; the SQL has the offsets of the planted season."""
    return _stamps(spark).select("n", times.pacific_date(F.col("ts")).cast("string").alias("date"))


# --- texts, links, documents ------------------------------------------------------------------------------------

plant("raw_labels", "i long, label string", [(0, " Check-Report "), (1, "check  report"), (2, "INSTRUCTION\tRequest"), (3, "a--b c"), (4, ""), (5, None), (6, "-x-")])


@query(f"WITH {values('raw_labels')} SELECT i, regexp_replace(trim(regexp_replace(lower(label), '[-\\s]+', ' ', 'g')), ' ', '_', 'g') AS key FROM raw_labels")
def label_keys(spark, sf):
    return local(spark, "raw_labels").select("i", T.label_key(F.col("label")).alias("key"))


@query(
    """SELECT doc_id, '/events?day=' || (doc_id // 50) || '&type=AGENT_TALK&q=' || replace(url_encode(left(text, 110)), '%20', '+') AS link, length(text) > 2800 AS truncated FROM documents"""
)
def evidence_links(spark, sf):
    link = T.link("/events", day=F.col("day"), type=F.lit("AGENT_TALK"), q=F.left("text", F.lit(110)))
    return document_messages(spark, sf).select(F.col("event_index").alias("doc_id"), link.alias("link"), T.evidence(F.col("text"))["truncated"].alias("truncated"))


@query(
    """WITH d AS (SELECT doc_id // 50 AS day, doc_id, sha256('snapshot') AS s FROM documents) SELECT doc_id, 'ev-' || left(s, 12) || '-d' || day || '-e' || doc_id AS locator, left(s, 12) AS prefix, day::VARCHAR AS day, doc_id::VARCHAR AS event FROM d"""
)
def locators(spark, sf):
    rows = document_messages(spark, sf).select(F.col("event_index").alias("doc_id"), T.locator(F.sha2(F.lit("snapshot"), 256), F.col("day"), F.col("event_index")).alias("locator"))
    part = lambda i: F.regexp_extract("locator", rules.LOCATOR, i)
    return rows.select("doc_id", "locator", part(1).alias("prefix"), part(2).alias("day"), part(3).alias("event"))


@query(
    _PRED
    + "SELECT day, event_index, 'sha' AS source_snapshot_sha256, speaker AS speaker_label, text_hash AS text_hash_sha256, label, needs_review::INT AS needs_review FROM m LEFT JOIN p USING (text_hash)"
)
def export_rows(spark, sf):
    joined = index.with_predictions(document_messages(spark, sf), document_predictions(spark, sf), RUN)
    row = joined.select(reports.message_row("sha").alias("x")).select("x.*")
    return row.select("source_locator.*", "source_snapshot_sha256", "speaker_label", "text_hash_sha256", "prediction.label", F.col("prediction.needs_review").cast("int").alias("needs_review"))


@query(
    _PRED
    + """, t AS (SELECT text_hash, count(*) AS n FROM m GROUP BY 1), j AS (SELECT t.*, p.label FROM t LEFT JOIN p USING (text_hash)),
    l AS (SELECT string_agg(label || '=' || n, ',' ORDER BY label) AS labels FROM (SELECT label, sum(n)::BIGINT AS n FROM j WHERE label IS NOT NULL GROUP BY label))
    SELECT sum(n)::BIGINT AS records, count(*) AS texts, coalesce(sum(n) FILTER (label IS NOT NULL), 0)::BIGINT AS classified_records, count(label) AS classified_texts,
    round(sum(n) FILTER (label IS NOT NULL) / sum(n), 6) AS record_share, round(count(label) / count(*), 6) AS text_share, any_value(labels) AS labels,
    CASE WHEN count(*) > count(label) THEN 'incomplete' ELSE 'complete' END AS state FROM j, l"""
)
def run_manifest(spark, sf):
    found = export.run_manifest(document_messages(spark, sf), document_predictions(spark, sf), RUN)
    shown = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return found.withColumn("labels", F.array_join(shown, ","))


plant("answers_json", "i long, result string", [(0, '{"primary_act": "q", "scores": {"a": 0.5}, "secret": 1, "runtime": {"truncation": {"message": true}, "host": "h"}, "run_id": "r"}'), (1, "{bad"), (2, None), (3, "{}")])


@query(
    f"""WITH {values('answers_json')}, v AS (SELECT i, CASE WHEN json_valid(result) THEN result END AS r FROM answers_json)
    SELECT i, json_extract(r, '$.primary_act')::VARCHAR AS primary_act, json_extract(r, '$.scores')::VARCHAR AS scores, json_extract(r, '$.template')::VARCHAR AS template, json_extract(r, '$.run_id')::VARCHAR AS run_id,
    json_extract(r, '$.runtime.truncation')::VARCHAR AS runtime_truncation, r IS NULL AS parse_error FROM v"""
)
def prediction_projection(spark, sf):
    row = local(spark, "answers_json").select("i", export.prediction_fields(F.col("result")).alias("p"))
    return row.select("i", *[f"p.{c}" for c in ("primary_act", "scores", "template", "run_id", "runtime_truncation", "parse_error")])


plant("classified", "i long, message string, answer string", [
    (0, "please check it", '{"primary_act": "q", "evidence_spans": ["check it", "never"], "abstain": false}'), (1, "so", "[]"), (2, "so", '{"abstain": true}'), (3, None, '{"evidence_spans": ["x"]}'),
])


@query(
    f"""WITH {values('classified')}, v AS (SELECT i, message, answer FROM classified WHERE json_type(answer) = 'OBJECT'),
    s AS (SELECT i, unnest(json_extract(answer, '$.evidence_spans')::VARCHAR[]) AS span FROM v)
    SELECT i, json_extract_string(answer, '$.primary_act') AS primary_act, json_extract(answer, '$.abstain')::BOOLEAN AS abstain,
    coalesce((SELECT string_agg(span, '|') FROM s WHERE s.i = v.i AND NOT coalesce(contains(v.message, span), false)), '') AS unsupported FROM v"""
)
def contract_answers(spark, sf):
    row = local(spark, "classified").withColumn("a", contracts.parsed(F.col("answer"), "classify")).where(F.col("a").isNotNull())
    return row.select("i", "a.primary_act", "a.abstain", F.coalesce(F.array_join(contracts.unsupported(F.col("a"), F.col("message")), "|"), F.lit("")).alias("unsupported"))


@query(
    f"""WITH {values('raw_events')}, e AS (SELECT n, json_extract_string(raw, '$.type') AS t, coalesce(nullif(json_extract_string(raw, '$.content'), ''), nullif(json_extract_string(raw, '$.message'), ''), '') AS c FROM raw_events)
    SELECT 'ev-' || left(sha256('s'), 12) || '-d1-e' || n AS id, t AS source_type, sha256(c) AS text_hash FROM e WHERE t IN ('AGENT_TALK', 'USER_TALK')"""
)
def talk_index(spark, sf):
    raw = _raw(spark).select(F.lit(1).alias("day"), F.lit("2026-01-01").alias("date"), F.col("n").alias("event_index"), "raw")
    return transcript.message_index(transcript.timeline(raw), _sha("s")).select("id", "source_type", "text_hash")


@query(
    r"""WITH d AS (SELECT doc_id // 50 AS day, source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents)
    SELECT day, md5(norm) AS body, count(*) AS n, count(DISTINCT source) AS agents FROM d WHERE length(norm) >= 80 GROUP BY day, norm HAVING count(*) > 1 ORDER BY n DESC, agents DESC, day, norm LIMIT 16"""
)
def top_duplicates(spark, sf):
    return messages.top_duplicates(messages.duplicates(document_messages(spark, sf))).select("day", F.md5("norm").alias("body"), "n", "agents")


@query(_MENTIONS + "SELECT src, dst, count(*) AS n FROM x GROUP BY ALL ORDER BY n DESC, src, dst LIMIT 5")
def top_edges(spark, sf):
    return graph.top_edges(graph.edge_examples(*_talks(spark)).select("src", "dst", "n"), 5)


@query("SELECT doc_id FROM documents WHERE n_chars > 500 ORDER BY sha256('732:' || doc_id), doc_id LIMIT 128")
def shuffled_first(spark, sf):
    return messages.shuffled_first(table(spark, sf, "documents"), "doc_id", 128, F.col("n_chars") > 500).select("doc_id")


plant("sections", "name string, days array<string>, total long", [("coverage", ["1", "2", "3"], 3), ("identity", [], 0), ("none", None, 1)])


@query(f"WITH {values('sections')} SELECT name, len(days)::INT AS daysEntries, total FROM sections")
def compact_manifest(spark, sf):
    return reports.compacted(local(spark, "sections"), ["days"])


@query(
    """WITH l AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), t AS (SELECT count(*) AS labels FROM labels)
    SELECT '{"languages":[' || (SELECT string_agg('{"lang":"' || lang || '","n":' || n || '}', ',' ORDER BY lang) FROM l) || '],"totals":[{"labels":' || (SELECT labels FROM t) || '}]}' AS document"""
)
def result_document(spark, sf):
    langs = table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    totals = table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("labels"))
    return reports.document({"languages": langs, "totals": totals})


plant("stored", "k string, v long, at long", [("a", 1, 0), ("b", 2, 0), ("c", 3, 0)])
plant("written", "k string, v long, at long", [("a", 9, 1), ("a", 7, 2), ("d", 4, 1), ("d", 5, 0)])


@query(f"""WITH {values('stored')}, {values('written')} SELECT * FROM stored WHERE k NOT IN (SELECT k FROM written) UNION ALL SELECT k, arg_max(v, "at"), max("at") FROM written GROUP BY k""")
def upserted(spark, sf):
    return export.upsert(local(spark, "stored"), local(spark, "written"), "k", order="at")


@query("WITH l AS (SELECT doc_id FROM labels) SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN l USING (doc_id)) GROUP BY 2")
def insert_new(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    stored = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    new = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return export.insert_new(stored, new, ["key"]).select("doc_id", "key")


# --- sources and streams -------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT *, ts::DATE AS date, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT day(date)::INT AS day, i::INT AS event_index, event_type AS type, user_id::VARCHAR AS actor, epoch_us(ts) AS at, 'valid' AS quality FROM e WHERE day(date) = 3"""
)
def transcript_day(spark, sf):
    """Events written as day documents, of which one day's are read back."""
    with scratch(spark) as folder:
        event = F.struct(F.col("type"), F.col("actor").cast("string").alias("agentName"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))
        rows = timeline(spark, sf).withColumn("event_index", F.row_number().over(_by_date()) - 1)
        rows = rows.select(F.dayofmonth("date").alias("day"), F.col("date").cast("string").alias("date"), "event_index", F.parse_json(F.to_json(event)).alias("raw"))
        transcript.write_days(rows, f"{folder}/days")
        found = transcript.timeline(transcript.raw_events(transcript.read_days(spark, f"{folder}/days").where("day = 3")))
        found = found.select("day", "event_index", "type", "actor", F.unix_micros("ts").alias("at"), F.col("ts_quality").alias("quality"))
        return found.checkpoint(eager=True)


def _by_date():
    from pyspark.sql.window import Window

    return Window.partitionBy("date").orderBy("ts", "event_id")


plant("odd_lines", "file string, value string", [("a", '{"k": 1}'), ("a", "[1]"), ("a", "{bad"), ("a", '{"k": "' + "x" * 60 + '"}'), ("b", "x" * 100), ("b", "y" * 120)])


@query(f"WITH {values('odd_lines')} SELECT file, sum(strlen(value) + 1)::BIGINT AS bytes, 'file too long' AS problem FROM odd_lines GROUP BY file HAVING sum(strlen(value) + 1) > 200")
def bounded_files(spark, sf):
    return transcript.bounded_total(local(spark, "odd_lines"), 200)


@query(
    """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def stream_window_counts(spark, sf):
    """Tumbling windows of the events as a stream, read to its end."""
    with scratch(spark) as folder:
        found = live.settled(live.windowed(event_stream(spark, sf), "6 hours", late="400 days"), f"{folder}/out", f"{folder}/state")
        found = found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "type", "n", F.round("total", 4).alias("total"))
        return found.checkpoint(eager=True)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id AS actor, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, sf):
    """Sessions of each actor, with pauses of less than two hours, of the events as a stream."""
    with scratch(spark) as folder:
        found = live.settled(live.sessions(event_stream(spark, sf), "2 hours", "400 days"), f"{folder}/out", f"{folder}/state")
        return found.select("actor", F.unix_micros("start").alias("start"), "n").checkpoint(eager=True)
