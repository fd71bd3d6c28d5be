"""The registered queries: each with its DataFrame plan and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.scores import LEAST_MARGIN, LEAST_TOP
from ..operators import activity, audit, export, graph, index, messages, parity, rules, scoring
from ..sources.tables import document_messages, document_predictions, indexed, table, timeline
from ..sources.tables import messages as conversation_messages

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
RUN = "run-a"
#: Cue rules for the invented prose of the test tables.
LEXICON = {k: rf"(^|[^\p{{L}}])({w})($|[^\p{{L}}])" for k, w in {"ARTICLE": "the|a|an", "LINK": "and|or|of", "PRONOUN": "it|that|this"}.items()}
PERIODS = [("early", "1900-01-01", "2024-01-11"), ("middle", "2024-01-11", "2024-01-21"), ("late", "2024-01-21", "9999-01-01")]


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query by its function's name; ``dates`` are shown as ISO text on both sides."""

    def add(f: Query) -> Query:
        shown = lambda spark, sf: f(spark, sf).withColumns({d: F.col(d).cast("string") for d in dates})
        _queries[f.__name__] = shown if dates else f
        if sql is not None:
            casts = ", ".join(f"{d}::VARCHAR AS {d}" for d in dates)
            _sql[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if dates else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- activity over the events table -----------------------------------------------------------

_DAILY = "WITH p AS (SELECT ts::DATE AS date, user_id, count(*) AS n FROM events GROUP BY ALL) "


@query(
    _DAILY
    + """SELECT date, sum(n)::BIGINT AS events, count(*) AS active,
    round(pow(sum(n), 2) / sum(n * n), 4) AS effective_actors FROM p GROUP BY date""", dates=("date",))
def daily_activity(spark, sf):
    return activity.daily_activity(timeline(spark, sf))


@query(
    """WITH p AS (SELECT ts::DATE AS date, user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY ALL)
    SELECT date, sum(n)::BIGINT AS events, sum(k)::BIGINT AS messages, count(*) FILTER (k > 0) AS active,
    round(CASE WHEN sum(k) > 0 THEN pow(sum(k), 2) / sum(k * k) END, 2) AS effective_speakers FROM p GROUP BY date""", dates=("date",))
def daily_effective_speakers(spark, sf):
    return activity.talk_concentration(timeline(spark, sf), F.col("type") == "error")


@query("SELECT ts::DATE AS date, event_type AS type, count(*) AS n FROM events GROUP BY ALL", dates=("date",))
def daily_type_counts(spark, sf):
    return activity.type_counts(timeline(spark, sf))


@query(
    """SELECT ts::DATE AS date, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
    count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""", dates=("date",))
def daily_type_pivot(spark, sf):
    rows = timeline(spark, sf).groupBy("date").pivot("type", ["click", "view", "error"]).count()
    return rows.fillna(0, ["click", "view", "error"])


@query(
    """SELECT strftime(ts, '%Y-%m') AS month, event_type AS type, count(*) AS n, grouping(strftime(ts, '%Y-%m'), event_type)::INT AS level
    FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m'), event_type)"""
)
def type_rollup_month(spark, sf):
    return activity.type_rollup(timeline(spark, sf))


@query("SELECT hour(ts)::INT AS hour, count(*) AS n, count(DISTINCT user_id) AS actors FROM events GROUP BY 1")
def hourly_rhythm(spark, sf):
    return activity.hourly(timeline(spark, sf))


@query("SELECT ts::DATE AS date, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1", dates=("date",))
def day_index(spark, sf):
    rows = timeline(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("type")).alias("t"))
    return rows.select("date", "n", F.array_join("t", ",").alias("types"))


@query(
    """SELECT ts::DATE AS date, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS speakers FROM events GROUP BY 1""", dates=("date",))
def day_speakers(spark, sf):
    rows = timeline(spark, sf).groupBy("date").agg(F.array_sort(F.collect_set(F.col("actor").cast("string"))).alias("s"))
    return rows.select("date", F.array_join("s", ",").alias("speakers"))


_INDEXED = """WITH e AS (SELECT *, ts::DATE AS date, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS event_index FROM events) """


@query(_INDEXED + "SELECT event_id, date, event_index::INT AS event_index FROM e WHERE event_type = 'click' ORDER BY date, event_index LIMIT 100 OFFSET 100", dates=("date",))
def event_page(spark, sf):
    page = index.event_page(indexed(timeline(spark, sf)), kind="click", offset=100)
    return page.select("event_id", "date", "event_index")


@query(_INDEXED + "SELECT event_id, date, event_index::INT AS event_index FROM e WHERE contains(lower(props), '\"k\": 7') ORDER BY date, event_index LIMIT 100", dates=("date",))
def event_search(spark, sf):
    page = index.event_page(indexed(timeline(spark, sf)), needle='"K": 7 ', raw=F.col("props"))
    return page.select("event_id", "date", "event_index")


@query(_INDEXED + "SELECT count(*) AS total FROM e WHERE date = DATE '2024-01-03' AND event_type = 'view' AND contains(lower(props), '7')")
def event_total(spark, sf):
    """The total beside a page, under the filters of day, type and needle, for a link to this snapshot."""
    import datetime

    rows = indexed(timeline(spark, sf))
    return index.event_search(rows, day=datetime.date(2024, 1, 3), kind="view", needle=" 7", raw=F.col("props"), snapshot=("a" * 64, "a" * 64))[1]


@query(_INDEXED + "SELECT event_id, date, event_index::INT AS event_index FROM e WHERE event_index = 4 ORDER BY date, event_index LIMIT 100", dates=("date",))
def event_by_ordinal(spark, sf):
    return index.event_page(indexed(timeline(spark, sf)), event_index=4).select("event_id", "date", "event_index")


@query(
    _INDEXED
    + """SELECT t.date, t.event_index::INT AS target, e.event_index::INT AS event_index, e.event_id, e.event_type AS type
    FROM e t JOIN e ON t.date = e.date AND e.event_index BETWEEN t.event_index - 2 AND t.event_index + 2 WHERE t.event_type = 'error'""", dates=("date",))
def event_context(spark, sf):
    rows = indexed(timeline(spark, sf)).select("date", "event_index", "event_id", "type")
    return index.around(rows, rows.where("type = 'error'"))


_COUNTS = "WITH c AS (SELECT ts::DATE AS date, event_type AS type, count(*) AS n FROM events GROUP BY ALL), "
_JSD = (
    _COUNTS
    + """t AS (SELECT date, sum(n) AS total FROM c GROUP BY date HAVING sum(n) >= 100),
    l AS (SELECT date, total, lag(date) OVER (ORDER BY date) AS previous, lag(total) OVER (ORDER BY date) AS ptotal FROM t),
    m AS (SELECT l.date, l.previous, k.type, coalesce(a.n / l.total, 0) AS p, coalesce(b.n / l.ptotal, 0) AS q
      FROM l CROSS JOIN (SELECT DISTINCT type FROM c) k LEFT JOIN c a ON a.date = l.date AND a.type = k.type
      LEFT JOIN c b ON b.date = l.previous AND b.type = k.type WHERE l.previous IS NOT NULL),
    s AS (SELECT date, previous, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 4) AS score FROM m GROUP BY date, previous) """
)


@query(_JSD + "SELECT date, previous, score FROM s", dates=("date", "previous",))
def regime_shift_jsd(spark, sf):
    return activity.shifts(activity.type_counts(timeline(spark, sf)))


@query(_JSD + "SELECT date, previous, score FROM s ORDER BY score DESC, date LIMIT 12", dates=("date", "previous",))
def top_shifts(spark, sf):
    return activity.top_shifts(activity.shifts(activity.type_counts(timeline(spark, sf))))


@query(
    """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), s AS (SELECT date FROM d WHERE dayofmonth(date) = 1),
    e AS (SELECT date, row_number() OVER (ORDER BY date) AS position FROM d WHERE dayofmonth(date) % 2 = 0),
    n AS (SELECT s.date AS shift_date, e.position, e.date, row_number() OVER (PARTITION BY s.date ORDER BY e.position) AS r
      FROM s JOIN e ON abs(date_diff('day', s.date, e.date)) <= 7)
    SELECT shift_date, position::INT AS position, date FROM n WHERE r <= 6""", dates=("date", "shift_date",))
def shift_context_7d(spark, sf):
    """Shifts and entries are made of order dates: a shift on each first of a month, an entry on each even day."""
    dates = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    entries = export.numbered(dates.where(F.dayofmonth("date") % 2 == 0), ["date"]).withColumn("position", (F.col("position") + 1).cast("int"))
    return activity.near_entries(dates.where(F.dayofmonth("date") == 1), entries)


@query(_COUNTS[:-2] + " SELECT date, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT date, n / sum(n) OVER (PARTITION BY date) AS p FROM c) GROUP BY date", dates=("date",))
def type_entropy(spark, sf):
    return activity.entropy(activity.type_counts(timeline(spark, sf)))


@query(
    """WITH d AS (SELECT ts::DATE AS date, count(*) AS events, count(*) FILTER (event_type = 'click') AS messages,
      count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS active FROM events GROUP BY 1)
    SELECT CASE WHEN date < '2024-01-11' THEN 'early' WHEN date < '2024-01-21' THEN 'middle' ELSE 'late' END AS period, count(*) AS days,
      sum(events)::BIGINT AS events, sum(messages)::BIGINT AS messages, round(avg(active) FILTER (messages > 0), 4) AS mean_active FROM d GROUP BY 1"""
)
def period_compare(spark, sf):
    return activity.periods(timeline(spark, sf), PERIODS, F.col("type") == "click")


@query(
    """WITH d AS (SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1)
    SELECT (isodow(date) - 1)::INT AS weekday, count(*) AS days, median(n) AS median_n, round(avg(n), 4) AS mean_n FROM d WHERE isodow(date) < 6 GROUP BY 1"""
)
def weekday_medians(spark, sf):
    return activity.weekday_medians(timeline(spark, sf))


_DISORDER = """WITH e AS (SELECT event_id, ts::DATE AS date, CASE WHEN event_id % 17 <> 0 THEN
    date_trunc(CASE WHEN event_id % 3 = 0 THEN 'hour' ELSE 'second' END, ts) - INTERVAL 1 MINUTE * (event_id * 7919 % 90) END AS ts FROM events), """


def _disordered(spark, sf):
    """Events by id, as logged late by up to 90 minutes, a third by the hour and some without a time."""
    cut = F.when(F.col("event_id") % 3 == 0, F.date_trunc("hour", "ts")).otherwise(F.date_trunc("second", "ts"))
    late = F.timestamp_micros(F.unix_micros(cut) - F.col("event_id") * 7919 % 90 * 60_000_000)
    return timeline(spark, sf).select("event_id", F.col("event_id").alias("event_index"), "date", F.when(F.col("event_id") % 17 != 0, late).alias("ts"))


@query(
    _DISORDER
    + """p AS (SELECT date, ts, lag(ts) OVER (PARTITION BY date ORDER BY event_id) AS b FROM e WHERE ts IS NOT NULL)
    SELECT date, count(*) AS timed, count(*) FILTER (ts < b) AS out_of_order, count(*) - count(DISTINCT ts) AS ties FROM p GROUP BY date""", dates=("date",))
def out_of_order_ties(spark, sf):
    return audit.ordering(_disordered(spark, sf))


@query("SELECT event_type AS type, count(json_extract(props, '$.k')) AS n, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS mean_v FROM events GROUP BY 1")
def json_props_stats(spark, sf):
    return audit.number_stats(timeline(spark, sf), "type", "props", "$.k")


_URL_TEXT = """WITH m AS (SELECT page_id // 50 AS date, 's' || (page_id % 7) AS actor, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (page_id * 531 % 6007) AS ts,
    'See ' || regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/notes/' || (page_id % 2) || '#part' || page_id || '), or (' || upper(regexp_extract(url, '^([a-z]+://[^/]+)', 1))
    || '/x and ' || url || '.' AS text FROM pages), """
_CASCADE = (
    _URL_TEXT
    + r"""u AS (SELECT date, actor, ts, regexp_replace(unnest(list_distinct(regexp_extract_all(text, 'https?://[^\s<>\[\]"`]+'))), '[.,;:!?)\]}’'']+$', '') AS u FROM m),
    n AS (SELECT date, actor, ts, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS key FROM u
      WHERE length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) >= 6),
    f AS (SELECT date, key, actor, min(ts) AS first, count(*) AS n FROM n GROUP BY ALL),
    g AS (SELECT date, key, count(*) AS agents, min(first) AS b, (epoch_us(max(first)) - epoch_us(min(first))) / 6e7 AS span, sum(n)::BIGINT AS mentions FROM f GROUP BY ALL),
    k AS (SELECT * FROM g WHERE agents >= 3 AND span <= 60),
    q AS (SELECT date, key, string_agg(round((epoch_us(first) - epoch_us(b)) / 6e7, 2)::DECIMAL(9, 2)::VARCHAR || ' ' || actor, '; ' ORDER BY round((epoch_us(first) - epoch_us(b)) / 6e7, 2), actor) AS sequence
      FROM f JOIN k USING (date, key) GROUP BY ALL) """
)


def _cascades(spark, sf):
    site, page = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.col("page_id")
    text = F.concat(
        F.lit("See "), site, F.lit("/notes/"), (page % 2).cast("string"), F.lit("#part"), page.cast("string"), F.lit("), or ("), F.upper(site), F.lit("/x and "), F.col("url"), F.lit(".")
    )
    ts = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + page * 531 % 6007 * 1_000_000)
    rows = table(spark, sf, "pages").select(F.expr("page_id div 50").alias("date"), F.concat(F.lit("s"), (page % 7).cast("string")).alias("actor"), ts.alias("ts"), text.alias("text"))
    found = activity.cascades(activity.url_mentions(rows))
    shown = F.transform("sequence", lambda x: F.concat_ws(" ", x["minutes"].cast("decimal(9,2)").cast("string"), x["actor"]))
    return found.withColumn("sequence", F.array_join(shown, "; "))


@query(_CASCADE + "SELECT date, key, agents, round(span, 2) AS span_minutes, mentions, sequence FROM k JOIN q USING (date, key)")
def url_cascade(spark, sf):
    return _cascades(spark, sf)


@query(_CASCADE + "SELECT date, key, agents, round(span, 2) AS span_minutes, mentions, sequence FROM k JOIN q USING (date, key) ORDER BY agents DESC, date, key LIMIT 24")
def top_cascades(spark, sf):
    return activity.top_cascades(_cascades(spark, sf))


@query(
    """WITH m AS (SELECT strftime(DATE '2024-01-01' + (doc_id % 300)::INT, '%Y-%m') AS month, contains(lower(source), 'src0') AS own FROM documents WHERE contains(lower(text), 'the'))
    SELECT month, count(*) FILTER (coalesce(own, false)) AS own, count(*) FILTER (NOT coalesce(own, false)) AS other,
    CASE WHEN count(*) FILTER (NOT coalesce(own, false)) > 0 THEN round(count(*) FILTER (coalesce(own, false)) / count(*) FILTER (NOT coalesce(own, false)), 6) END AS ratio
    FROM m GROUP BY ROLLUP (month)"""
)
def word_by_month_family(spark, sf):
    rows = table(spark, sf, "documents")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    return messages.word_usage(rows.select(date.alias("date"), F.col("source").alias("speaker"), "text"), "The", "src0")


@query(
    """SELECT 'event_id' AS field, count(*) FILTER (event_id IS NULL) AS missing, count(*) AS total FROM events
    UNION ALL SELECT 'type', count(*) FILTER (event_type IS NULL OR event_type = ''), count(*) FROM events
    UNION ALL SELECT 'ts', count(*) FILTER (ts IS NULL), count(*) FROM events
    UNION ALL SELECT 'props', count(*) FILTER (props IS NULL OR props = ''), count(*) FROM events"""
)
def missing_fields(spark, sf):
    return audit.missing(timeline(spark, sf), ["event_id", "type", "ts", "props"])


@query("SELECT event_type AS type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def audit_profile(spark, sf):
    return audit.labels(timeline(spark, sf), "type", F.col("event_id"))


# --- the message index over documents and labels ------------------------------------------------

_DOCS = "WITH m AS (SELECT doc_id // 50 AS day, doc_id AS event_index, source AS speaker, lang, text, sha256(text) AS text_hash FROM documents), "
_PRED = (
    _DOCS
    + """f AS (SELECT sha256(d.text) AS text_hash, arg_min(l.quality, d.doc_id) AS quality, arg_min(l.toxic, d.doc_id) AS needs_review
      FROM documents d JOIN labels l USING (doc_id) GROUP BY 1),
    p AS (SELECT text_hash, 'q' || quality AS label, needs_review FROM f) """
)


@query(_DOCS[:-2] + " SELECT day, event_index, speaker, text_hash, left(text, 2800) AS shown, length(text) > 2800 AS truncated FROM m")
def message_index(spark, sf):
    shown = T.evidence(F.col("text"))
    return document_messages(spark, sf).select("day", "event_index", "speaker", "text_hash", shown["text"].alias("shown"), shown["truncated"].alias("truncated"))


@query(_DOCS[:-2] + " SELECT count(*) AS records, count(DISTINCT text_hash) AS texts FROM m")
def unique_texts(spark, sf):
    return document_messages(spark, sf).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("text_hash").alias("texts"))


@query(_PRED + "SELECT label, count(*) AS records, count(DISTINCT text_hash) AS texts, sum(needs_review)::BIGINT AS review FROM m JOIN p USING (text_hash) GROUP BY label")
def label_counts(spark, sf):
    return index.label_counts(document_messages(spark, sf), document_predictions(spark, sf), RUN)


@query(
    _PRED
    + """, t AS (SELECT text_hash, count(*) AS n FROM m GROUP BY 1), j AS (SELECT t.*, p.label FROM t LEFT JOIN p USING (text_hash))
    SELECT sum(n)::BIGINT AS records, count(*) AS texts, coalesce(sum(n) FILTER (label IS NOT NULL), 0)::BIGINT AS classified_records,
    count(label) AS classified_texts, round(sum(n) FILTER (label IS NOT NULL) / sum(n), 6) AS record_share, round(count(label) / count(*), 6) AS text_share FROM j"""
)
def coverage_two_denominators(spark, sf):
    return index.coverage(document_messages(spark, sf), document_predictions(spark, sf), RUN)


@query(_PRED + "SELECT text_hash, min(day) AS day, min(event_index) AS event_index FROM m WHERE text_hash NOT IN (SELECT text_hash FROM p) GROUP BY 1")
def pending_texts(spark, sf):
    return index.pending(document_messages(spark, sf), document_predictions(spark, sf), RUN)


_PAGE = "SELECT day, event_index, speaker, label FROM m LEFT JOIN p USING (text_hash) "


@query(_PRED + _PAGE + "ORDER BY day, event_index LIMIT 100 OFFSET 50")
def classified_left_page(spark, sf):
    page, _ = index.search(document_messages(spark, sf), document_predictions(spark, sf), RUN, index.Search(limit=500, offset=50))
    return page.select("day", "event_index", "speaker", "label")


@query(_PRED + _PAGE + "WHERE label IS NULL AND instr(lower(text), 'the') > 0 ORDER BY day, event_index LIMIT 30")
def pending_search(spark, sf):
    wanted = index.Search(needle="The", pending=True)
    page, _ = index.search(document_messages(spark, sf), document_predictions(spark, sf), RUN, wanted)
    return page.select("day", "event_index", "speaker", "label")


@query(_PRED + "SELECT count(*) AS total FROM m LEFT JOIN p USING (text_hash) WHERE needs_review = 1 AND speaker = 'src0'")
def review_total(spark, sf):
    wanted = index.Search(speaker="src0", review=True)
    return index.search(document_messages(spark, sf), document_predictions(spark, sf), RUN, wanted)[1]


@query(_DOCS + "r AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY day, event_index) AS r FROM m) SELECT text_hash, day, event_index FROM r WHERE r = 1")
def first_occurrence(spark, sf):
    return messages.first_occurrences(document_messages(spark, sf))


@query(
    _PRED
    + """, r AS (SELECT text_hash, day, event_index, row_number() OVER (PARTITION BY text_hash ORDER BY day, event_index) AS o FROM m),
    k AS (SELECT label, day, event_index, text_hash, row_number() OVER (PARTITION BY label ORDER BY day, event_index) AS rank FROM r JOIN p USING (text_hash) WHERE o = 1)
    SELECT label, rank, day, event_index, text_hash FROM k WHERE rank <= 2 ORDER BY label, rank LIMIT 24"""
)
def sample_two_per_label(spark, sf):
    return index.report_samples(document_messages(spark, sf), document_predictions(spark, sf), RUN)


@query(_DOCS[:-2] + " SELECT DISTINCT text_hash FROM m ORDER BY text_hash LIMIT 48")
def hash_sample_48(spark, sf):
    return messages.hash_sample(document_messages(spark, sf), 48)


@query(
    """WITH r AS (SELECT lang AS tag, doc_id AS event_index, row_number() OVER (PARTITION BY lang ORDER BY sha256('732:' || doc_id), doc_id) AS r FROM documents)
    SELECT tag, event_index FROM r WHERE r <= CASE WHEN tag = 'en' THEN 24 ELSE 12 END"""
)
def stratified_audit_sample(spark, sf):
    sizes = {"en": 24, "de": 12, "es": 12, "fr": 12}
    return messages.stratified_sample(document_messages(spark, sf), F.array("lang"), "event_index", sizes, "732")


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_GROUPS = (
    _DOCS
    + f"""k AS (SELECT day, event_index, speaker, {_NORM} AS norm FROM m),
    d AS (SELECT day, norm, count(*) AS n, count(DISTINCT speaker) AS agents,
      array_to_string(list(event_index ORDER BY event_index)[1:6], ',') AS examples FROM k WHERE length(norm) >= 80 GROUP BY day, norm HAVING count(*) > 1) """
)


@query(_GROUPS + "SELECT day, norm, n, agents, examples FROM d")
def dup_groups_day(spark, sf):
    found = messages.duplicates(document_messages(spark, sf))
    return found.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(_GROUPS + "SELECT day, sum(n - 1)::BIGINT AS repeated FROM d GROUP BY day")
def dup_repeated_by_day(spark, sf):
    return messages.duplicates(document_messages(spark, sf)).groupBy("day").agg(F.sum(F.col("n") - 1).alias("repeated"))


@query(
    _DOCS
    + """k AS (SELECT sha256(lang || chr(0) || coalesce(speaker, 'None') || chr(0) || text) AS fingerprint, day, event_index FROM m)
    SELECT fingerprint, count(*) AS n, min(day) AS day, min(event_index) AS event_index FROM k GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, day, event_index LIMIT 200"""
)
def dup_fingerprints(spark, sf):
    return messages.duplicate_fingerprints(document_messages(spark, sf), F.col("lang"))


_TOKENS = (
    _DOCS
    + r"""w AS (SELECT day, speaker, unnest(regexp_extract_all(lower(regexp_replace(text, 'https?://[^\s<>\[\]"`]+', ' ', 'g')), '[a-z]{3,}')) AS token FROM m),
    c AS (SELECT day, speaker, token, count(*) AS n FROM w WHERE token NOT IN ("""
    + ", ".join(f"'{w}'" for w in T.STOPWORDS)
    + """) GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY day, speaker) AS total, row_number() OVER (PARTITION BY day, speaker ORDER BY n DESC, token) AS r FROM c),
    f AS (SELECT day, speaker, token, n FROM r WHERE total >= 20 AND r <= 120),
    i AS (SELECT token, count(*) AS df, ln((1 + (SELECT count(*) FROM (SELECT DISTINCT day, speaker FROM f))) / (1 + count(*))) + 1 AS idf FROM f GROUP BY token) """
)


@query(_TOKENS + "SELECT day, speaker, token, n FROM f")
def token_top(spark, sf):
    return messages.profiles(document_messages(spark, sf))


@query(_TOKENS + "SELECT token, df, round(idf, 6) AS idf FROM i")
def idf(spark, sf):
    found = messages.inverse_frequency(messages.profiles(document_messages(spark, sf)))
    return found.withColumn("idf", F.round("idf", 6))


@query(
    _TOKENS
    + """, v AS (SELECT day, speaker, token, (1 + ln(n)) * idf AS w FROM f JOIN i USING (token)), nn AS (SELECT day, speaker, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
    s AS (SELECT day, token, sum(w / norm) AS s FROM v JOIN nn USING (day, speaker) GROUP BY ALL), q AS (SELECT day, sum(s * s) AS ss FROM s GROUP BY day),
    k AS (SELECT day, count(*) AS profiles FROM nn GROUP BY day)
    SELECT day, profiles, (profiles * (profiles - 1) // 2) AS pairs, CASE WHEN profiles >= 2 THEN round((ss - profiles) / (profiles * (profiles - 1)), 4) END AS overlap FROM k JOIN q USING (day)"""
)
def topic_overlap(spark, sf):
    return messages.topic_overlap(messages.profiles(document_messages(spark, sf)))


# --- conversations --------------------------------------------------------------------------------

_CUES = "WITH c AS (SELECT role AS speaker, text, " + ", ".join(f"regexp_matches(text, '(?i){r}') AS {k.lower()}" for k, r in LEXICON.items()) + " FROM conversations), "
_LONG = " UNION ALL ".join(f"SELECT speaker, '{k}' AS tag, {k.lower()} AS hit FROM c" for k in LEXICON)


@query(
    _CUES + f"l AS ({_LONG} UNION ALL SELECT speaker, 'COVERED', {' OR '.join(k.lower() for k in LEXICON)} FROM c) SELECT speaker, tag, count(*) AS n FROM l WHERE hit GROUP BY ALL"
)
def cue_rates_by_speaker(spark, sf):
    return messages.cue_counts(conversation_messages(spark, sf), "speaker", LEXICON)


@query(
    _CUES
    + """l AS (SELECT 'ARTICLE' AS a, 'LINK' AS b, article AND link AS hit FROM c UNION ALL SELECT 'ARTICLE', 'PRONOUN', article AND pronoun FROM c
    UNION ALL SELECT 'LINK', 'PRONOUN', link AND pronoun FROM c) SELECT a, b, count(*) AS n FROM l WHERE hit GROUP BY ALL"""
)
def cue_cooccurrence(spark, sf):
    return messages.cue_pairs(conversation_messages(spark, sf), LEXICON)


_CONV = "WITH m AS (SELECT conv_id AS day, turn AS event_index, role AS speaker, text, sha256(text) AS text_hash FROM conversations), "


@query(
    _CONV[:-2]
    + """ SELECT day, event_index, coalesce(array_to_string(list(speaker) OVER w, '|'), '') AS before, row_number() OVER (PARTITION BY day ORDER BY event_index) - 1 AS earlier_today
    FROM m WINDOW w AS (PARTITION BY day ORDER BY event_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)"""
)
def prev_two_context(spark, sf):
    return messages.preceding(conversation_messages(spark, sf))


@query(
    _CONV
    + """d AS (SELECT day, count(*) AS n FROM m GROUP BY day)
    SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM d"""
)
def running_counts(spark, sf):
    return messages.earlier_days(conversation_messages(spark, sf))


@query(
    _CONV
    + """d AS (SELECT day, count(*) AS n FROM m GROUP BY day), e AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM d),
    r AS (SELECT m.*, row_number() OVER (PARTITION BY day ORDER BY event_index) - 1 AS today FROM m),
    k AS (SELECT r.*, row_number() OVER (PARTITION BY text_hash ORDER BY day, event_index) AS o FROM r JOIN e USING (day) WHERE today >= 2 AND earlier >= 2 AND length(trim(text)) > 0)
    SELECT day, event_index, text_hash FROM k WHERE o = 1"""
)
def eligible_first(spark, sf):
    return messages.eligible(conversation_messages(spark, sf)).select("day", "event_index", "text_hash")


@query(
    r"""WITH t AS (SELECT conv_id * 1000 + turn AS ident, role, len(string_split_regex(trim(text), '\s+')) AS tokens FROM conversations),
    x AS (SELECT ident AS target, tokens AS wanted FROM t WHERE role = 'system'),
    n AS (SELECT target, wanted, ident, tokens, row_number() OVER (PARTITION BY target ORDER BY abs(tokens - wanted / 2), ident) AS r FROM x CROSS JOIN t WHERE role = 'user'),
    c AS (SELECT * FROM n WHERE r <= 8), p AS (SELECT a.target, abs(a.tokens + b.tokens - a.wanted) AS gap, a.ident AS first, b.ident AS second FROM c a JOIN c b ON a.target = b.target AND a.ident < b.ident),
    o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gap, first, second) AS r FROM p) SELECT target, gap, first, second FROM o WHERE r = 1"""
)
def length_matched_pair(spark, sf):
    rows = conversation_messages(spark, sf).select((F.col("day") * 1000 + F.col("event_index")).alias("ident"), "speaker", messages.word_total(F.col("text")).alias("tokens"))
    targets = rows.where("speaker = 'system'").select(F.col("ident").alias("target"), "tokens")
    return messages.matched_pair(rows.where("speaker = 'user'").select("ident", "tokens"), targets, nearest=8)


@query(
    r"""WITH t AS (SELECT conv_id * 1000 + turn AS ident, role, len(string_split_regex(trim(text), '\s+')) AS tokens FROM conversations),
    x AS (SELECT ident AS target, tokens AS wanted FROM t WHERE role = 'system'),
    n AS (SELECT target, wanted, ident, tokens, row_number() OVER (PARTITION BY target ORDER BY abs(tokens - wanted / 2), ident) AS r FROM x CROSS JOIN t WHERE role = 'user'),
    c AS (SELECT * FROM n WHERE r <= 32), p AS (SELECT a.target, abs(a.tokens + b.tokens - a.wanted) AS gap, a.ident AS first, b.ident AS second FROM c a JOIN c b ON a.target = b.target AND a.ident < b.ident),
    o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gap, first, second) AS r FROM p) SELECT target, gap, first, second FROM o WHERE r = 1"""
)
def length_matched_pair_32(spark, sf):
    rows = conversation_messages(spark, sf).select((F.col("day") * 1000 + F.col("event_index")).alias("ident"), "speaker", messages.word_total(F.col("text")).alias("tokens"))
    targets = rows.where("speaker = 'system'").select(F.col("ident").alias("target"), "tokens")
    return messages.matched_pair(rows.where("speaker = 'user'").select("ident", "tokens"), targets)


# --- score vectors ----------------------------------------------------------------------------------


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse_sort(embedding::DOUBLE[]) AS s FROM embeddings)
    SELECT vec_id, (list_position(v, s[1]) - 1)::INT AS label, round(s[1], 6) AS top_score, round(s[1] - s[2], 6) AS margin,
    s[1] < {LEAST_TOP} OR s[1] - s[2] < {LEAST_MARGIN} AS needs_review FROM e"""
)
def top_label_margin_review(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    order = F.sort_array("v", asc=False)
    top, margin = order[0], order[0] - order[1]
    return rows.select(
        "vec_id", parity.top(F.col("v")).alias("label"), F.round(top, 6).alias("top_score"), F.round(margin, 6).alias("margin"),
        ((top < LEAST_TOP) | (margin < LEAST_MARGIN)).alias("needs_review"),
    )


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: round(x, 2)) AS r FROM embeddings),
    d AS (SELECT list_position(v, list_max(v)) = list_position(r, list_max(r)) AS same, list_transform(list_zip(v, r), lambda z: abs(z[1] - z[2])) AS d FROM e)
    SELECT count(*) AS pairs, round(max(list_max(d)), 6) AS max_delta, round(sum(list_sum(d)) / sum(len(d)), 6) AS mean_delta, count(*) FILTER (same) AS same_top FROM d"""
)
def parity_stats(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return parity.report(rows, rows.withColumn("v", F.transform("v", lambda x: F.round(x, 2))), "vec_id", "v")


@query()
def score_udf(spark, sf):
    found = scoring.predictions(conversation_messages(spark, sf), RUN)
    return found.select("text_hash", "label", F.round("top_score", 6).alias("top_score"), F.round("margin", 6).alias("margin"), "needs_review", "primary_act")


# --- pages: URLs and graphs -------------------------------------------------------------------------

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


@query(
    f"""SELECT page_id, lower(regexp_extract(url, '{_PARTS}', 1)) || '://' || lower(regexp_extract(url, '{_PARTS}', 2)) || regexp_extract(url, '{_PARTS}', 3)
    || regexp_extract(url, '{_PARTS}', 4) AS url FROM pages WHERE length(regexp_extract(url, '{_PARTS}', 3)) >= 6"""
)
def url_normalise(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", T.normal_url(F.col("url"), 6).alias("url"))
    return rows.where(F.col("url").isNotNull())


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_mentions(spark, sf):
    return table(spark, sf, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_EDGES = f"WITH e AS (SELECT page_id // 25 AS day, {_HOST} AS src, unnest(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) AS dst FROM pages) "


def _edges(spark, sf):
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1))
    rows = table(spark, sf, "pages").select(F.expr("page_id div 25").alias("day"), T.host(F.col("url")).alias("src"), F.explode(hrefs).alias("dst"))
    return rows.groupBy("day", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(_EDGES + "SELECT day, src, dst, count(*) AS n FROM e GROUP BY ALL")
def link_edges(spark, sf):
    return _edges(spark, sf)


@query(
    _EDGES.replace("WITH", "WITH RECURSIVE")
    + """, s AS (SELECT DISTINCT day, src, dst FROM e), n AS (SELECT day, src AS v FROM s UNION SELECT day, dst FROM s),
    b AS (SELECT day, src AS a, dst AS b FROM s UNION SELECT day, dst, src FROM s),
    r(day, v, root) AS (SELECT day, v, v FROM n UNION SELECT r.day, b.b, r.root FROM r JOIN b ON r.day = b.day AND r.v = b.a),
    c AS (SELECT day, v, min(root) AS root FROM r GROUP BY ALL), z AS (SELECT day, root, count(*) AS size FROM c GROUP BY ALL)
    SELECT day, count(*) AS components, max(size) AS largest FROM z GROUP BY day"""
)
def components(spark, sf):
    edges = _edges(spark, sf)
    nodes = edges.select("day", F.col("src").alias("node")).union(edges.select("day", "dst")).distinct()
    return graph.components(nodes, edges)


# --- exports, rules, joins of the star tables --------------------------------------------------------


@query(
    """WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
    SELECT position // 300 AS shard, count(*) AS rows, min(position) AS first, max(position) AS last FROM p GROUP BY 1"""
)
def shards_manifest(spark, sf):
    return export.shard_counts(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 300)


@query(
    """SELECT doc_id, 'unlabelled' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'length' FROM documents WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'toxic' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"""
)
def dq_violations(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    broken = {"unlabelled": F.col("toxic").isNull(), "length": F.col("n_chars") != F.length("text"), "toxic": F.col("toxic") == 1}
    return rules.violations(rows, "doc_id", broken)


@query(
    """WITH g AS (SELECT o_custkey AS k, o_orderkey AS goal, o_orderdate AS start, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS stop FROM orders)
    SELECT o.o_orderkey AS order_key, g.goal FROM orders o JOIN g ON o.o_custkey = g.k AND o.o_orderdate >= g.start AND (g.stop IS NULL OR o.o_orderdate < g.stop)"""
)
def goal_asof_range(spark, sf):
    orders = table(spark, sf, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    goals = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("goal"), F.col("o_orderdate").alias("start"), F.lead("o_orderdate").over(order).alias("stop"))
    inside = (F.col("o_orderdate") >= F.col("start")) & (F.col("stop").isNull() | (F.col("o_orderdate") < F.col("stop")))
    return orders.join(goals, (F.col("o_custkey") == F.col("k")) & inside).select(F.col("o_orderkey").alias("order_key"), "goal")


@query(
    """SELECT n_name, r_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def star_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.sum(price).alias("v"))
    rows = per_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy("c_nationkey").agg(F.sum("k").alias("lines"), F.sum("v").alias("revenue"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", "r_name", "lines", F.round("revenue", 2).alias("revenue"))


@query(
    """SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(c_mktsegment, o_orderstatus)::INT AS level
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)"""
)
def cube_segments(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = rows.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("v"))
    return per.cube("c_mktsegment", "o_orderstatus").agg(F.sum("k").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))
