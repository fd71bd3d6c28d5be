import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import scores
from loomline.operators import activity, audit, export, graph, index, messages, parity, reports, rules, scoring, transfer
from loomline.sources import transcript


@pytest.fixture
def archive(spark, tmp_path):
    events = [
        {"type": "AGENT_TALK", "timestamp": "2026-01-01T00:00:00Z", "speakerName": "", "agentName": "Ada", "content": "hello"},
        {"type": "AGENT_TALK", "timestamp": "2026-01-01T00:00:00Z", "speakerName": "Bo", "message": "late"},
        {"type": "WAIT", "timestamp": "2025-12-31T00:00:00Z"},
        {"type": "NEW", "timestamp": "2026-01-01T10:00:00"},
        "not an object",
        None,
    ]
    file = tmp_path / "t.json"
    file.write_text(json.dumps({"days": [{"day": 1, "date": "2026-01-01", "events": events}, {"day": 2, "date": "2026-01-02", "events": []}]}, indent=1))
    return transcript.raw_events(transcript.days(spark, str(file)))


def test_transcript(spark, archive):
    good, bad = transcript.split_objects(archive)
    assert (good.count(), bad.count()) == (4, 2)
    rows = transcript.timeline(archive).orderBy("event_index").collect()
    assert [r["actor"] for r in rows] == ["Ada", "Bo", "Unknown", "Unknown"]
    assert [r["text"] for r in rows] == ["hello", "late", None, None]
    assert [r["ts_quality"] for r in rows] == ["valid", "valid", "valid", "malformed-or-no-timezone"]
    order = audit.ordering(transcript.timeline(archive)).first()
    assert (order["timed"], order["out_of_order"], order["ties"]) == (3, 1, 1)
    index_row = transcript.day_index(transcript.timeline(archive)).first()
    assert index_row["types"] == ["AGENT_TALK", "NEW", "WAIT"]
    shapes = audit.shapes(good).collect()
    assert sum(r["n"] for r in shapes) == 4
    assert [tuple(r) for r in audit.id_fields(good.withColumn("type", transcript.field("type")), "type").collect()] == []


def test_line_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as file:
        file.write('{"text_hash": "h", "text": "t"}\n\n[1]\n{"text_hash": "' + "x" * 50 + '"}\n')
    rows = transcript.bounded_lines(spark, str(tmp_path / "a.jsonl.gz"), "text_hash string, text string", max_line=40).collect()
    assert sorted(str(r["problem"]) for r in rows) == ["None", "line too long", "not an object of the schema"]
    (tmp_path / "CHANGELOG.md").write_text("# Log\n\n## 2026-01-02 - Second\nnotes\n## Other\nx\n## 2026-01-01\nfirst\n")
    found = transcript.changelog(spark, str(tmp_path / "CHANGELOG.md")).orderBy("position").collect()
    assert [(r["date"], r["notes"]) for r in found] == [("2026-01-02", "notes"), ("2026-01-01", "first")]
    (tmp_path / "acts.json").write_text(json.dumps({"acts": [{"id": "a", "hypothesis": "x"}, {"id": "a", "hypothesis": "y"}]}))
    with pytest.raises(ValueError, match="unique"):
        transcript.taxonomy(spark, str(tmp_path / "acts.json"))


def test_shifts_skip_small_and_missing_days(spark):
    rows = [("2026-01-01", "a", 100), ("2026-01-02", "a", 99), ("2026-01-04", "a", 50), ("2026-01-04", "b", 50), ("2026-01-05", "c", 101)]
    counts = spark.createDataFrame(rows, "date string, type string, n long").withColumn("date", F.to_date("date"))
    found = {str(r["date"]): (str(r["previous"]), r["score"]) for r in activity.shifts(counts).collect()}
    assert found == {"2026-01-04": ("2026-01-01", 0.3113), "2026-01-05": ("2026-01-04", 1.0)}


def test_cascades_at_the_hour(spark):
    def rows(minutes):
        times = [("2026-01-01 00:00:00", "a"), ("2026-01-01 00:10:00", "b"), (f"2026-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00", "c"), ("2026-01-01 05:00:00", "a")]
        df = spark.createDataFrame([("2026-01-01", "k", actor, ts) for ts, actor in times] + [("2026-01-01", "k", "d", None)], "date string, key string, actor string, ts string")
        return activity.cascades(df.withColumn("ts", F.to_timestamp("ts"))).collect()

    assert [(r["agents"], r["span_minutes"], r["mentions"]) for r in rows(60)] == [(3, 60.0, 4)]
    assert rows(61) == []


def test_duplicates_by_length_and_case(spark):
    long = "word " * 16  # 79 characters when normal
    rows = [(1, 0, "a", long), (1, 1, "b", long.upper()), (1, 2, "a", long + "x"), (1, 3, "b", " " + long + " X"), (2, 0, "a", long + "x")]
    found = messages.duplicates(spark.createDataFrame(rows, "day int, event_index int, speaker string, text string")).collect()
    assert [(r["day"], r["n"], r["agents"], r["examples"]) for r in found] == [(1, 2, 2, [2, 3])]


def test_topic_overlap_is_the_mean_of_pairs(spark):
    rows = [(1, "a", "cat dog bird " * 7), (1, "b", "cat fish " * 10), (1, "c", "dog fish cat " * 7), (2, "a", "cat dog " * 10), (2, "b", "too short")]
    df = spark.createDataFrame(rows, "day int, speaker string, text string")
    profiles = messages.profiles(df)
    got = {r["day"]: (r["profiles"], r["pairs"], r["overlap"]) for r in messages.topic_overlap(profiles).collect()}
    idf = {r["token"]: r["idf"] for r in messages.inverse_frequency(profiles).collect()}
    import math
    from collections import defaultdict
    from itertools import combinations

    vectors = defaultdict(dict)
    for r in profiles.where("day = 1").collect():
        vectors[r["speaker"]][r["token"]] = (1 + math.log(r["n"])) * idf[r["token"]]

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(a[t] * b.get(t, 0) for t in a) / norm(a) / norm(b)

    pairs = [cosine(vectors[a], vectors[b]) for a, b in combinations("abc", 2)]
    assert got[1] == (3, 3, round(sum(pairs) / 3, 4))
    assert got[2] == (1, 0, None)


@pytest.fixture
def store(spark):
    rows = [("ev-a", 1, 2, "Ada", "same"), ("ev-b", 1, 3, "Bo", "same"), ("ev-c", 2, 1, "Ada", "other")]
    texts = spark.createDataFrame(rows, "id string, day int, event_index int, speaker string, text string")
    texts = texts.withColumn("text_hash", F.sha2("text", 256))
    done = [("run-a", hashlib.sha256(b"same").hexdigest(), "question", 1), ("run-b", hashlib.sha256(b"other").hexdigest(), "assertion", 0)]
    return texts, spark.createDataFrame(done, "run_id string, text_hash string, label string, needs_review int")


def test_index(spark, store):
    texts, done = store
    page = lambda **p: [r["id"] for r in index.search(texts, done, "run-a", index.Search(**p))[0].collect()]
    assert page() == ["ev-a", "ev-b", "ev-c"]
    assert page(pending=True) == ["ev-c"]
    assert page(review=True, speaker="Bo") == ["ev-b"]
    assert page(needle="OTHER") == ["ev-c"]
    assert page(limit=0) == ["ev-a"] and page(offset=-5, limit=2) == ["ev-a", "ev-b"]
    status = index.coverage(texts, done, "run-a").first()
    assert (status["records"], status["texts"], status["classified_records"], status["classified_texts"]) == (3, 2, 2, 1)
    assert index.coverage(texts.limit(0), done, "run-a").first()["record_share"] == 0.0
    assert [r["day"] for r in index.pending(texts, done, "run-a").collect()] == [2]
    states = spark.createDataFrame([("complete", 3, True, True), ("running", 0, False, True), ("running", 1, True, False), ("complete", 0, False, True)], "s string, r int, a boolean, o boolean")
    got = [r[0] for r in states.select(index.run_state(F.col("s"), F.col("r"), F.col("a"), F.col("o"))).collect()]
    assert got == ["incomplete", "interrupted", "run_replaced", "complete"]


def test_graph(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcde"], "day int, node string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a")], "day int, src string, dst string")
    assert tuple(graph.components(nodes, edges).first()) == (1, 3, 3)
    talks = spark.createDataFrame([(1, "Ada", "Bo and bo, Cy"), (1, "Bo", "Bo Ada"), (2, "Ada", "Cy")], "day int, speaker string, text string")
    found = graph.mention_edges(talks, ["Ada", "Bo", "Cy"])
    assert sorted(map(tuple, found.collect())) == [(1, "Ada", "Bo", 1), (1, "Ada", "Cy", 1), (1, "Bo", "Ada", 1), (2, "Ada", "Cy", 1)]
    assert sorted((r["day"], r["src"], r["dst"]) for r in graph.active_edges(found, talks).collect()) == [(1, "Ada", "Bo"), (1, "Bo", "Ada")]
    steps = spark.createDataFrame([("r", "x", 2), ("x", "y", 1), ("x", "z", 3), ("z", "r", 4), ("q", "w", 5)], "src string, dst string, at int")
    roots = spark.createDataFrame([("r", 0)], "node string, at int")
    assert {r["node"]: r["at"] for r in graph.reachable(roots, steps).collect()} == {"r": 0, "x": 2, "z": 3}
    assert spark.range(1).select(graph.renamed(F.array(F.lit("a"), F.lit("b")), {"a": "z"})).first()[0] == ["z", "b"]


def test_parity(spark):
    left = spark.createDataFrame([("a", [0.8, 0.1]), ("b", [0.2, 0.6])], "k string, s array<double>")
    right = spark.createDataFrame([("a", [0.81, 0.1]), ("b", [0.7, 0.61])], "k string, s array<double>")
    row = parity.report(left, right, "k", "s").first()
    assert (row["pairs"], row["max_delta"], row["same_top"]) == (2, 0.5, 1)
    assert not parity.report(left, right, "k", "s").select(parity.approved(F.struct("*"), least=2)).first()[0]
    short = right.where("k = 'a'")
    assert [tuple(r) for r in parity.key_mismatches(left, short, "k").collect()] == [("b", "left only")]
    with pytest.raises(Exception, match="different keys"):
        parity.report(left, short, "k", "s").collect()
    rows = spark.createDataFrame([(1, "iso", "a"), (1, "ctx", "b"), (2, "iso", "a"), (2, "ctx", "a")], "target int, condition string, label string")
    assert tuple(parity.label_changes(rows, "iso", ["ctx"]).first()) == ("ctx", 2, 1)


def test_shards_and_manifest(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).alias("day"), F.col("id").alias("event_index"), F.lit("t").alias("text"))
    path = str(tmp_path / "out")
    found = sorted(export.write_shards(rows, path, ["day", "event_index"], 32).collect(), key=lambda r: r["shard"])
    assert [r["rows"] for r in found] == [32, 32, 32, 4]
    with gzip.open(next((tmp_path / "out" / "shard=0").glob("*.json.gz")), "rt") as file:
        order = [(r["day"], r["event_index"]) for r in map(json.loads, file)]
    assert order == sorted(((i % 7), i) for i in range(100))[:32]
    with pytest.raises(Exception, match="(?i)exists"):
        export.write_shards(rows, path, ["day", "event_index"], 32)
    export.publish(rows, str(tmp_path / "table"))
    export.publish(rows.limit(5), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 5
    (tmp_path / "table").rename(tmp_path / "table.old")  # as a publication leaves it that stops between its renames
    export.publish(rows.limit(6), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6
    assert not (tmp_path / "table.old").exists() and not (tmp_path / "table.staging").exists()
    ledger = str(tmp_path / "ledger")
    notes = spark.createDataFrame([("x",), ("y",)], "note string")
    assert [export.append_ledger(notes, spark, ledger), export.append_ledger(notes, spark, ledger)] == [2, 4]
    assert sorted(r["id"] for r in spark.read.json(ledger).collect()) == [f"review-{i}" for i in range(1, 5)]


def test_small_sinks(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, export.insert_new(old, new, ["k"]).collect())) == [("b", 3)]
    assert sorted(map(tuple, export.upsert(old, new, "k").collect())) == [("a", 2), ("b", 3)]
    twice = spark.createDataFrame([("a", 2, 1), ("a", 5, 3), ("a", 4, 2)], "k string, v int, at int")
    assert sorted(map(tuple, export.upsert(old.withColumn("at", F.lit(0)), twice, "k", order="at").collect())) == [("a", 5, 3)]
    with pytest.raises(Exception, match="more than once"):
        export.upsert(old, twice.drop("at"), "k").collect()
    pruned = export.prune({"raw": 1, "list": list(range(41)), "s": "x" * 5000, "in": [{"path": 1, "k": 2}]})
    assert pruned == {"list": {"omitted": 41}, "s": "x" * 4000, "in": [{"k": 2}]}
    rows = spark.createDataFrame([('{"primary_act": "q", "scores": {"a": 0.5}, "secret": 1}',), ("{bad",)], "r string")
    got = [r["p"].asDict() for r in rows.select(export.prediction_fields(F.col("r")).alias("p")).collect()]
    assert (got[0]["primary_act"], got[0]["parse_error"], got[1]["parse_error"]) == ('"q"', False, True)
    assert "secret" not in got[0] and json.loads(got[0]["scores"]) == {"a": 0.5}


EVENT = "id string, day int, event_index int, source_order int, track string, stance string, basis string, outcome string, is_endorsement boolean, quote string, text string, time_quality string, ts string"
SNAPSHOT = "0123456789abcdef"


def event(**change):
    row = {
        "id": "ev-0123456789ab-d1-e2", "day": 1, "event_index": 2, "source_order": 2, "track": "action", "stance": "mention", "basis": "direct-logged-event",
        "outcome": "unknown", "is_endorsement": False, "quote": "wo", "text": "words", "time_quality": "valid", "ts": "t",
    }
    return tuple((row | change).values())


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []),
        ({"id": "ev-fff-d1-e2"}, ["locator"]),
        ({"source_order": 3}, ["source order"]),
        ({"track": "x"}, ["track"]),
        ({"stance": "endorsement"}, ["endorsement flag"]),
        ({"stance": "challenge", "is_endorsement": True}, ["endorsement flag", "challenge counted as endorsement"]),
        ({"quote": ""}, ["no quote"]),
        ({"quote": "zz"}, ["quote not in text"]),
        ({"time_quality": "missing"}, ["time of bad quality"]),
        ({"basis": None, "outcome": "x"}, ["basis", "outcome"]),
    ],
)
def test_event_rules(spark, change, broken):
    df = spark.createDataFrame([event(**change)], EVENT)
    assert [r["rule"] for r in rules.violations(df, "id", rules.event_rules(SNAPSHOT)).collect()] == broken


def test_edges_artifacts_scenes(spark):
    events = spark.createDataFrame(
        [("a", 1, 1, "t1", "said this", "valid"), ("b", 1, 2, "t2", "then", "valid"), ("c", 1, 3, "t2", "more", "valid")],
        "id string, day int, event_index int, ts string, text string, time_quality string",
    )
    kind = "edge string, source string, target string, evidence array<string>, type string, basis string, strength string, explanation string, quote string, elapsed int"
    basis, said = "direct-logged-event", ["a"]
    rows = [
        ("ok", "a", "b", said, "mentions", basis, "explicit-attribution", "why", "said", None),
        ("back", "b", "a", said, "mentions", basis, "unresolved", "", "said", None),
        ("gone", "a", "x", None, "mentions", basis, "unresolved", "", "", None),
        ("future", "a", "b", ["c"], "mentions", basis, "unresolved", "", "more", None),
        ("cand", "a", "b", said, "candidate_informed_by", basis, "explicit-attribution", "why", "said", None),
        ("quote", "a", "b", said, "mentions", basis, "candidate", "", "never", None),
        ("tied", "b", "c", said, "mentions", basis, "unresolved", "5 minutes later", "said", None),
        ("timed", "b", "c", said, "mentions", basis, "unresolved", "", "said", 30),
        ("uncited", "a", "b", None, "mentions", basis, "unresolved", "", "said", 0),
    ]
    found = {r["edge"]: r["rule"] for r in rules.edge_violations(spark.createDataFrame(rows, kind), events).collect()}
    assert found == {
        "back": "backward", "gone": "unknown endpoint", "future": "evidence from the future", "cand": "candidate marked explicit",
        "quote": "quote not in evidence", "tied": "duration without times", "timed": "duration without times", "uncited": "unknown evidence",
    }
    artifacts = spark.createDataFrame([("p", ["a"], "made", "/tmp/x", ""), ("q", ["z"], "verified read", "/tmp/x", "n")], "artifact string, events array<string>, description string, path string, namespace string")
    assert sorted(map(tuple, rules.artifact_violations(artifacts, events).collect())) == [
        ("p", "repeated path without namespace"), ("q", "claims a reading"), ("q", "unknown event"),
    ]
    scenes = spark.createDataFrame([("a", 0), ("b", 2), ("b", 2)], "id string, step int")
    assert sorted(map(tuple, rules.scene_violations(scenes, events).collect())) == [("b", "shown more than once"), ("b", "wrong step"), ("c", "not shown")]
    stored = spark.createDataFrame([(1, 1, "said that"), (9, 9, "x")], "day int, event_index int, text string")
    assert sorted((r["day"], r["field"]) for r in rules.verbatim_violations(stored, events, ["day", "event_index"], ["text"]).collect()) == [(1, "text"), (9, "no source")]
    a, b = spark.createDataFrame([("k", 1.0), ("l", 2.0)], "k string, v double"), spark.createDataFrame([("k", 1.1), ("m", 2.0)], "k string, v double")
    assert sorted(r["k"] for r in rules.mismatches(a, b, "k", ["v"], 0.11).collect()) == ["l", "m"]
    with pytest.raises(ValueError, match="snapshot"):
        rules.require_snapshot("a", "b")


def test_context(spark):
    rows = [(d, i, "s", f"text {d} {i}") for d in range(4) for i in range(5)]
    df = spark.createDataFrame(rows, "day int, event_index int, speaker string, text string").withColumn("text_hash", F.sha2("text", 256))
    got = messages.eligible(df).select("day", "event_index").collect()
    assert sorted(map(tuple, got)) == [(d, i) for d in (1, 2, 3) for i in (2, 3, 4)]
    texts = spark.createDataFrame([("a b c d", "x y")], "b string, t string")
    shown = lambda n: texts.select(messages.context_text(F.col("b"), F.col("t"), n)).first()[0]
    assert [shown(9), shown(4), shown(2), shown(1)] == ["a b c d x y", "c d x y", "x y", None]


def test_scoring_is_repeatable_and_once_a_hash(spark, store):
    texts, _ = store
    first = sorted(map(str, scoring.predictions(texts, "r").collect()))
    assert len(first) == 2 and first == sorted(map(str, scoring.predictions(texts.repartition(3), "r").collect()))
    assert scoring.run_id({"b": 1, "a": 2}) == scoring.run_id({"a": 2, "b": 1})
    assert len(scoring.next_epoch(scoring.next_epoch([], {"m": 1, "batch": 2}), {"m": 1, "batch": 3})) == 2
    with pytest.raises(ValueError, match="another run"):
        scoring.next_epoch([{"config": {"m": 1}}], {"m": 2})


def test_reachable_tells_that_its_bound_was_met(spark):
    roots = spark.createDataFrame([("0", 0)], "node string, at int").coalesce(1)
    chain = spark.createDataFrame([(str(i), str(i + 1), 1) for i in range(6)], "src string, dst string, at int").coalesce(1)
    assert graph.reachable(roots, chain).count() == 7
    with pytest.raises(RuntimeError):
        graph.reachable(roots, chain, most_rounds=3)


def test_ranges_without_one_task_for_all(spark):
    rows = spark.createDataFrame([(None if i % 11 == 0 else i * 37 % 100, i) for i in range(500)], "k int, v long")
    got = export.numbered(rows, ["k", "v"], parts=7).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(500))
    assert [(r["k"], r["v"]) for r in got] == sorted(((r["k"], r["v"]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    sums = export.running_before(rows.groupBy("k").agg(F.sum("v").alias("v")).where("k is not null"), "k", "v", parts=7).orderBy("k").collect()
    total = 0
    for r in sums:
        assert r["before"] == total
        total += r["v"]


def test_matched_pairs_as_by_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(4)
    pool = [(i, rng.choice([3, 5, 5, 8, 20, 21, 90])) for i in range(60)]
    targets = [(1000 + i, n) for i, n in enumerate([1, 7, 10, 10, 41, 60, 500])]
    got = {r["target"]: (r["gap"], r["first"], r["second"]) for r in messages.matched_pair(
        spark.createDataFrame(pool, "ident long, tokens long"), spark.createDataFrame(targets, "target long, tokens long"), nearest=6
    ).collect()}
    for t, wanted in targets:
        near = sorted(pool, key=lambda r: (abs(r[1] - wanted / 2), r[0]))[:6]
        pairs = [(abs(a[1] + b[1] - wanted), *sorted((a[0], b[0]))) for a, b in itertools.combinations(near, 2)]
        assert got[t] == min(pairs)


def test_earlier_samples_are_the_least_of_all_days_before(spark):
    import hashlib

    rows = [(d, i) for d in (0, 1, 2, 5, 9, 10, 17, 40) for i in range(7)]
    days = [-3, 0, 1, 2, 3, 9, 10, 18, 40, 41, 900]
    got = messages.earlier_samples(spark.createDataFrame(rows, "day long, event_index long"), spark.createDataFrame([(d,) for d in days], "for_day long"), 5, "s").collect()
    code = lambda r: hashlib.sha256(f"s:{r[0]}:{r[1]}".encode()).hexdigest()
    for d in days:
        want = sorted((r for r in rows if r[0] < d), key=code)[:5]
        assert sorted((r["day"], r["event_index"]) for r in got if r["for_day"] == d) == sorted(want)


def test_components_of_a_long_path(spark):
    nodes = spark.createDataFrame([(1, f"n{i:03d}") for i in range(120)] + [(2, "x")], "day int, node string")
    edges = spark.createDataFrame([(1, f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 119) if i != 60], "day int, src string, dst string")
    assert sorted(map(tuple, graph.components(nodes, edges).collect())) == [(1, 2, 61), (2, 1, 1)]
    with pytest.raises(ValueError, match="more than 2"):
        graph.names_of(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), 2)


def test_event_search_reads_strings_as_they_are(spark):
    rows = [(1, 0, "a", 7, json.dumps({"text": 'say "Hi" \u00e9t\u00e9', "n": 5})), (1, 1, "b", 7, '{"text": "other"}'), (2, 0, "a", 8, "not json \u00e9t\u00e9")]
    df = spark.createDataFrame(rows, "date int, event_index int, type string, actor int, raw string")
    found = lambda **w: [(r["date"], r["event_index"]) for r in index.event_search(df, raw=F.col("raw"), **w)[0].collect()]
    assert found(needle='say "hi"') == [(1, 0)] and found(needle=" \u00c9T\u00c9 ") == [(1, 0), (2, 0)]
    assert found(needle="say \\") == [(1, 0)] and found(day=1, event_index=1) == [(1, 1)] and found(actor=8) == [(2, 0)]
    assert index.event_search(df, kind="a")[1].first()[0] == 2
    with pytest.raises(ValueError, match="snapshot"):
        index.event_search(df, snapshot=("a", "b"))


def test_transfer(spark, tmp_path):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = [f"text {i}" for i in range(70)]
    rows = [(1 + i // 40, i, t, sha(t)) for i, t in enumerate(texts)] + [(3, 0, texts[0], sha(texts[0]))]
    index_rows = spark.createDataFrame(rows, "day long, event_index long, text string, text_hash string")
    done = spark.createDataFrame([("r", sha(texts[5]))], "run_id string, text_hash string")
    shards = transfer.pending_shards(index_rows, done, "r", 32)
    assert sorted(r["count"] for r in shards.groupBy("shard").count().collect()) == [5, 32, 32]
    assert [r["text"] for r in shards.where("shard = 'pending-00000'").orderBy("position").limit(3).collect()] == texts[:3]
    assert {r["pilot"]: r["count"] for r in transfer.pilots(index_rows).groupBy("pilot").count().collect()} == {"pilot-48": 48, "pilot-68": 68}
    assert {r["pilot"] for r in transfer.pilots(index_rows, 48, 30).collect()} == {"pilot-48"}
    with pytest.raises(Exception, match="needs 90"):
        transfer.pilots(index_rows, 90).collect()
    with pytest.raises(Exception, match="hash mismatch"):
        transfer.pending_shards(index_rows.withColumn("text", F.lit("x")), done, "r").collect()

    path = tmp_path / "shard.jsonl.gz"
    with gzip.open(path, "wt") as file:
        file.write("".join(json.dumps({"text_hash": sha(t), "text": t}) + "\n" for t in texts[:4]))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    shard = transfer.strict_shard(spark, str(path), 4, digest)
    assert shard.count() == 4
    for count, of, message in ((5, digest, "4 rows"), (4, "0" * 64, "not the file")):
        with pytest.raises(ValueError, match=message):
            transfer.strict_shard(spark, str(path), count, of)
    results = scoring.score_texts(shard).select("text_hash", "scores")
    assert transfer.imported(results, shard, index_rows, done, "r").count() == 4
    with pytest.raises(ValueError, match="no result"):
        transfer.imported(results.limit(3), shard, index_rows, done, "r")
    known = spark.createDataFrame([("r", sha(texts[1]))], "run_id string, text_hash string")
    with pytest.raises(ValueError, match="scored already"):
        transfer.imported(results, shard, index_rows, known, "r")
    assert transfer.imported(results, shard, index_rows, known, "r", preserve=True).count() == 3


def test_engines_and_deadlines(spark):
    texts = spark.createDataFrame([(f"h{i}", f"some words {i} and more {i * i}") for i in range(300)], "text_hash string, text string")
    for model, one_choice in scoring.ENGINES.values():
        row = scoring.score_texts(texts.limit(20), model).select(scores.valid(F.col("scores")).alias("v"), scores.forced_choice(F.col("scores")).alias("c")).distinct().collect()
        assert [r["v"] for r in row] == [True] and (not one_choice or [r["c"] for r in row] == [True])
    late = scoring.score_within(texts, 0.0)
    assert late.count() == 300 and late.where("scores is not null").count() == 0
    assert scoring.score_within(texts, 600).where("scores is null").count() == 0


def test_reports(spark):
    seen = iter([{"run_id": "a", "state": "running"}, {"run_id": "a", "state": "complete"}])
    assert reports.watch(lambda: next(seen), sleep=lambda _: None) == {"run_id": "a", "state": "complete"}
    other = iter([{"run_id": "a", "state": "running", "n": 1}, {"run_id": "b", "state": "running", "n": 2}])
    assert reports.watch(lambda: next(other), sleep=lambda _: None) == {"run_id": "a", "state": "run_replaced", "n": 1, "replaced_by": "b"}
    rows = spark.range(5)
    assert json.loads(reports.document({"a": rows, "b": rows.limit(0)}).first()[0]) == {"a": [{"id": i} for i in range(5)], "b": []}
    with pytest.raises(Exception, match="more than 4 rows"):
        reports.document({"a": rows}, most=4).collect()
