import pytest
from pyspark.sql import functions as F

from loomline.functions import scores as S
from loomline.functions import text as T
from loomline.functions import times


def one(spark, expression, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tags"),
    [
        ("I verified it, independently checked", ["VERIFY"]),
        ("We should ship; let’s go", ["PROPOSE"]),
        ("could you join me", ["COORDINATE"]),
        ("Thanks, agreed", ["ACKNOWLEDGE"]),
        ("that is incorrect", ["CHALLENGE"]),
        ("404, permission denied", ["BLOCKED"]),
        ("merged and deployed", ["REPORT"]),
        ("looking into it", ["RESEARCH"]),
        ("we abandoned it", ["ABANDON"]),
        ("nothing here", []),
        ("éverify", []),
        ("ſhipped", ["REPORT"]),
        ("I propose what was published", ["PROPOSE", "REPORT"]),
    ],
)
def test_cues(spark, text, tags):
    assert one(spark, T.tags, text) == tags


def test_normal_form(spark):
    assert one(spark, T.normal, "  A  b\n\tC ") == "a b c"


def test_words_keep_repeats_and_leave_urls_out(spark):
    assert one(spark, T.words, "Cat cat the https://dog.example/x dogs ab") == ["cat", "cat", "dogs"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("ask GPT-5 and gpt-5.", ["GPT-5"]),
        ("ask GPT-5.1 now", ["GPT-5.1"]),
        ("pre-GPT-5 and GPT-5-mini", []),
        ("Opus, opus and OPUS", ["Opus"]),
    ],
)
def test_mentions(spark, text, names):
    assert one(spark, lambda c: T.mentions(c, ["GPT-5", "GPT-5.1", "Opus"]), text) == names


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.Com/Path/x?q=1#f", "https://ex.com/Path/x?q=1"),
        ("http://a.b/abcde", "http://a.b/abcde"),
        ("http://a.b/abcd", None),
        ("not a url", None),
    ],
)
def test_normal_url(spark, url, want):
    assert one(spark, lambda c: T.normal_url(c, 6), url) == want


def test_urls_are_distinct_as_they_stand_and_cut(spark):
    assert one(spark, T.urls, "see (http://a.b/c) and http://a.b/c. or http://a.b/c.") == ["http://a.b/c", "http://a.b/c"]


def test_locator(spark):
    row = spark.range(1).select(T.locator(F.lit("0123456789abcdef"), F.lit(3), F.lit(7)).alias("x")).first()
    assert row["x"] == "ev-0123456789ab-d3-e7"


def reviewed(spark, values, text="some text", truncated=False):
    scores = dict(zip(S.ACTS, values))
    df = spark.createDataFrame([(scores, text, truncated)], "s map<string,double>, t string, c boolean")
    return df.select(S.review(F.col("s"), F.col("t"), F.col("c")).alias("r")).first()["r"]


def test_review_rule(spark):
    rest = [0.0] * 10
    sure = reviewed(spark, [0.9, 0.1, *rest])
    assert (sure["label"], sure["needs_review"], sure["primary_act"]) == ("instruction_request", False, "instruction_request")
    assert not reviewed(spark, [0.55, 0.25, *rest])["needs_review"]
    assert reviewed(spark, [0.54, 0.0, *rest])["reasons"] == ["low_top_score"]
    assert reviewed(spark, [0.9, 0.8, *rest])["reasons"] == ["small_margin"]
    assert reviewed(spark, [0.9, 0.1, *rest], text="  ", truncated=True)["reasons"] == ["truncated", "blank"]
    tie = reviewed(spark, [0.1, 0.7, 0.7, *[0.0] * 9])
    assert (tie["label"], tie["primary_act"], tie["templates"]) == ("question", "uncertain", ["question", "proposal_plan"])


def test_valid_scores(spark):
    good = dict.fromkeys(S.ACTS, 0.5)
    bad = [good | {"question": float("nan")}, good | {"question": 1.1}, {k: v for k, v in good.items() if k != "question"}, good | {"x": 0.1}]
    for scores, want in [(good, True), *((b, False) for b in bad)]:
        assert one(spark, S.valid, scores, "map<string,double>") is want


def test_softmax(spark):
    assert one(spark, S.softmax, [1.0, 1.0], "array<double>") == [0.5, 0.5]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2026-01-01T00:00:00Z", "valid"), ("2026-01-01T00:00:00+02:00", "valid"), ("2026-01-01T00:00:00", "malformed-or-no-timezone"), ("xZ", "malformed-or-no-timezone"), ("", "missing"), (None, "missing")],
)
def test_time_quality(spark, raw, want):
    assert one(spark, times.quality, raw) == want


def test_prepared_texts(spark):
    from loomline.functions import prepare

    row = lambda text: spark.createDataFrame([(text,)], "t string")
    middle = row("a b  c d e f g").select(prepare.middle_omitted(F.col("t"), 4).alias("b")).first()["b"]
    assert middle.asDict() == {"text": "a b\n[... 3 middle message tokens omitted ...]\nf g", "message": True, "message_tokens": 7, "message_tokens_dropped": 3}
    assert row(" a  b ").select(prepare.middle_omitted(F.col("t"), 4)["text"]).first()[0] == " a  b "
    pair = row("a b c d e").select(prepare.pair(F.col("t"), F.lit("x y"), 8).alias("p")).first()["p"]
    assert (pair["text"], pair["message_tokens"], pair["message_tokens_dropped"]) == ("a b c", 5, 2)
    none = row("a b").select(prepare.pair(F.col("t"), F.lit("x y"), 4).alias("p")).first()["p"]
    assert (none["text"], none["message_tokens_dropped"]) == ("", 2)
    asked = row("what is this about").select(prepare.question_first(F.col("t"), F.lit("some thing"), 10).alias("q")).first()["q"]
    assert asked.asDict() == {"text": "question: what is option: some thing", "shortened": True}
    with pytest.raises(Exception, match="too long"):
        row("q").select(prepare.question_first(F.col("t"), F.lit("a b c d e"), 10)["text"]).collect()
    assert prepare.rotated(["a", "b", "c"], 4) == ["b", "c", "a"] and prepare.rotated([], 2) == []


def test_names_and_links(spark):
    from loomline.functions.text import link, safe_name, urls

    assert safe_name("pending-00001.jsonl.gz") == "pending-00001.jsonl.gz"
    for bad in ("", ".", "..", "a/b", "/a", "a\\b"):
        with pytest.raises(ValueError, match="plain file name"):
            safe_name(bad)
    row = spark.createDataFrame([("a b*~&=\u00e9",)], "q string")
    assert row.select(link("/e", day=F.lit(3), q=F.col("q"))).first()[0] == "/e?day=3&q=a+b%2A~%26%3D%C3%A9"
    text = spark.createDataFrame([("see https://a.b/c). https://a.b/c, and \u201chttps://x.y/z\u2019",)], "t string")
    assert text.select(urls(F.col("t"))).first()[0] == ["https://a.b/c", "https://a.b/c", "https://x.y/z"]
