import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomline.sources import sqlite, transcript


def test_sqlite_tables_as_of_one_moment(spark, tmp_path):
    path = str(tmp_path / "index.sqlite")
    base = sqlite3.connect(path)
    base.execute("PRAGMA journal_mode = WAL")
    base.execute('CREATE TABLE messages (id TEXT, day INTEGER, "odd ""name" REAL)')
    base.executemany("INSERT INTO messages VALUES (?, ?, ?)", [(f"m{i}", i % 3, i / 2) for i in range(25)])
    base.execute("CREATE TABLE metadata (key TEXT, value TEXT)")
    base.commit()
    schema = {"messages": 'id string, day long, `odd "name` double', "metadata": "key string, value string"}
    got = sqlite.snapshot(spark, path, schema, str(tmp_path / "out"), batch=10)
    base.execute("DELETE FROM messages")
    base.commit()
    assert got["messages"].count() == 25 and got["metadata"].count() == 0
    assert {r["id"]: r[2] for r in got["messages"].collect()}["m7"] == 3.5
    with pytest.raises(Exception, match="(?i)exists"):
        sqlite.snapshot(spark, path, schema, str(tmp_path / "out"))
    with pytest.raises(sqlite3.OperationalError):
        sqlite.snapshot(spark, str(tmp_path / "none.sqlite"), schema, str(tmp_path / "out2"))


def test_days_written_apart_are_read_alone(spark, tmp_path):
    whole = {"days": [
        {"day": 1, "date": "2026-01-01", "events": [{"type": "AGENT_TALK", "agentName": "Ada", "content": 'a "q" \u00e9'}, None, 5, {"type": "WAIT"}]},
        {"day": 2, "date": None, "events": [{"type": "USER_TALK", "speakerName": "Bo"}]},
        {"day": 3, "date": "2026-01-03", "events": []},
    ]}
    (tmp_path / "t.json").write_text(json.dumps(whole))
    days = transcript.days(spark, str(tmp_path / "t.json"))
    raw = transcript.raw_events(days)
    transcript.write_days(raw, str(tmp_path / "days"))
    back = transcript.raw_events(transcript.read_days(spark, str(tmp_path / "days")))
    shown = lambda df: sorted((r["day"], r["date"] or "", r["event_index"], r["j"] or "") for r in df.select("day", "date", "event_index", F.to_json("raw").alias("j")).collect())
    assert shown(back) == shown(raw) and len(shown(raw)) == 5
    one = transcript.read_days(spark, str(tmp_path / "days")).where("day = 2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: .*day#\d+ = 2", plan) and one.count() == 1
    good, odd = transcript.split_objects(back)
    assert (good.count(), odd.count()) == (3, 2)
