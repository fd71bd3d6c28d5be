"""Work that leaves for scoring elsewhere and comes back: pending shards, pilots, strict readers, whole-shard import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import ACTS, valid
from .export import numbered
from .index import pending_texts
from .rules import violations

SHARD_ROWS = 256
FIXED, EXTRA = 48, 20
CONDITIONS = ["isolated", "real_context", "shuffled_context"]
HASH = r"^[0-9a-f]{64}$"


def checked_hash(rows: DataFrame) -> DataFrame:
    """``rows``; one whose text does not hash to its text_hash is an error when it runs."""
    error = F.raise_error(F.lit("the index contains a text hash mismatch"))
    same = F.sha2(F.coalesce("text", F.lit("")), 256).eqNullSafe(F.col("text_hash"))
    return rows.where(F.when(same, F.lit(True)).otherwise(error))


def pending_shards(messages: DataFrame, predictions: DataFrame, run_id: str, size: int = SHARD_ROWS) -> DataFrame:
    """(shard, position, text_hash, text) of the texts that a run has not scored, by first day and place, ``size`` a shard."""
    rows = checked_hash(pending_texts(messages, predictions, run_id))
    placed = numbered(rows, ["day", "event_index", "text_hash"])
    name = F.concat(F.lit("pending-"), F.lpad(F.expr(f"position div {size}").cast("string"), 5, "0"))
    return placed.select(name.alias("shard"), "position", "text_hash", F.coalesce("text", F.lit("")).alias("text"))


def pilots(messages: DataFrame, fixed: int = FIXED, extra: int = EXTRA) -> DataFrame:
    """(pilot, text_hash): the ``fixed`` least hashes, and these with the ``extra`` earliest others. Pilots are never imported.

    Fewer than ``fixed`` texts are an error; with fewer others there is no larger pilot.
    """
    texts = messages.groupBy("text_hash").agg(F.min("day").alias("day"), F.min("event_index").alias("event_index"))
    least = texts.orderBy("text_hash").limit(fixed).select("text_hash")
    later = texts.join(least, "text_hash", "left_anti").orderBy("day", "event_index", "text_hash").limit(extra).select("text_hash")
    counts = least.agg(F.count(F.lit(1)).alias("a")).crossJoin(later.agg(F.count(F.lit(1)).alias("b")))  # one row each
    both = least.select("text_hash", F.lit(0).alias("k")).unionByName(later.select("text_hash", F.lit(1).alias("k"))).crossJoin(F.broadcast(counts))
    enough = F.when(F.col("a") < fixed, F.raise_error(F.lit(f"a pilot needs {fixed} texts"))).otherwise(F.lit(True))
    small, large = f"pilot-{fixed}", f"pilot-{fixed + extra}"
    in_both = F.when(F.col("k") == 0, F.array(F.lit(small), F.lit(large))).otherwise(F.array(F.lit(large)))
    names = F.when(F.col("b") == extra, in_both).when(F.col("k") == 0, F.array(F.lit(small))).otherwise(F.array().cast("array<string>"))
    return both.where(enough).select(F.explode(names).alias("pilot"), "text_hash")


def chosen_pilot(pilots: DataFrame, preferred: int = FIXED + EXTRA) -> DataFrame:
    """Of pilots (id, count, importable) the one to run: not importable, of the preferred count or else the largest."""
    order = [F.col("count") != preferred, F.desc("count"), "id"]
    return pilots.where(~F.col("importable")).orderBy(*order).limit(1)


def strict_violations(lines: DataFrame) -> DataFrame:
    """(line, rule) of a shard's lines (line, value): blank ones, bad hashes, texts that are none or hash otherwise, repeated hashes."""
    parsed = F.from_json("value", "text_hash string, text string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.text", "variant"))
    rows = lines.select("line", "value", parsed.alias("p"), kind.alias("kind"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p.text_hash")))
    blank = F.trim("value") == ""
    hashed = F.coalesce(F.col("p.text_hash").rlike(HASH), F.lit(False))
    string = F.coalesce(F.col("kind") == "STRING", F.lit(False))
    return violations(
        rows,
        "line",
        {
            "blank": blank,
            "bad hash": ~blank & ~hashed,
            "text is no string": ~blank & ~string,
            "text hashes otherwise": hashed & string & (F.sha2("p.text", 256) != F.col("p.text_hash")),
            "repeated hash": hashed & (F.col("n") > 1),
        },
    )


def strict_shard(spark: SparkSession, path: str, count: int, sha256: str) -> DataFrame:
    """(text_hash, text) of one shard file of the known count and digest of its bytes; raises on anything else."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if digest != sha256:
        raise ValueError(f"{path} is not the file that the manifest names")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    broken = strict_violations(lines).orderBy("line").limit(5).collect()
    if broken:
        raise ValueError(f"{path}: " + "; ".join(f"line {r['line']}: {r['rule']}" for r in broken))
    rows = lines.select(F.from_json("value", "text_hash string, text string").alias("p")).select("p.*")
    if (found := rows.count()) != count:
        raise ValueError(f"{path} has {found} rows and not {count}")
    return rows


def result_violations(results: DataFrame, shard: DataFrame, messages: DataFrame, acts: list[str] = ACTS) -> DataFrame:
    """(text_hash, rule) that keep a whole shard of results (text_hash, scores) from import.

    The results are of exactly the shard's texts, each once, with valid scores; the texts stand in
    the index as they do in the shard.
    """
    sums = results.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.bool_and(valid(F.col("scores"), acts)).alias("fit"))
    sent = shard.select("text_hash", F.col("text").alias("sent")).dropDuplicates(["text_hash"])
    known = messages.join(sent.select("text_hash"), "text_hash", "left_semi")
    known = known.groupBy("text_hash").agg(F.coalesce(F.min("text"), F.lit("")).alias("known"))
    rows = sums.join(sent, "text_hash", "full_outer").join(known, "text_hash", "left")
    return violations(
        rows,
        "text_hash",
        {
            "no result": F.col("n").isNull(),
            "not of the shard": F.col("sent").isNull(),
            "more than one result": F.col("n") > 1,
            "invalid scores": ~F.col("fit"),
            "not in the index": F.col("sent").isNotNull() & F.col("known").isNull(),
            "another text in the index": F.col("sent") != F.col("known"),
        },
    )


def imported(results: DataFrame, shard: DataFrame, messages: DataFrame, predictions: DataFrame, run_id: str, *, preserve: bool = False) -> DataFrame:
    """The rows of a valid shard of results to append to a run; raises, before any is appended, on one that is not valid.

    Texts that the run has scored already are an error, or with ``preserve`` are left as they are.
    """
    broken = result_violations(results, shard, messages).orderBy("text_hash", "rule").limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['text_hash']}: {r['rule']}" for r in broken))
    done = predictions.where(F.col("run_id") == run_id).select("text_hash")
    if not preserve and not results.join(done, "text_hash", "left_semi").isEmpty():
        raise ValueError("some of the texts are scored already")
    return results.join(done, "text_hash", "left_anti").select(F.lit(run_id).alias("run_id"), *results.columns)


def manifest_violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(file, rule) of a manifest (file, count, sha256) against the files (file, rows, sha256) that there are; each side is unique by file."""
    there = files.select("file", F.col("rows").alias("_rows"), F.col("sha256").alias("_sha"), F.lit(True).alias("_there"))
    rows = manifest.withColumn("_named", F.lit(True)).join(there, "file", "full_outer")
    named, there = F.col("_named").isNotNull(), F.col("_there").isNotNull()
    return violations(
        rows,
        "file",
        {
            "missing": named & ~there,
            "not in the manifest": there & ~named,
            "bad digest": named & ~F.coalesce(F.col("sha256").rlike(HASH), F.lit(False)),
            "another digest": named & there & (F.col("sha256") != F.col("_sha")),
            "another count": named & there & (F.col("count") != F.col("_rows")),
        },
    )


def experiment_violations(rows: DataFrame, conditions: list[str] = CONDITIONS) -> DataFrame:
    """(id, rule) of experiment rows (id, base_text_hash, condition, speaker, target, text, text_hash).

    Ids are unique; each base has every condition once; the isolated text is the target alone, or
    framed by its speaker; the others end with the whole target; hashes are of the texts.
    """
    framed = F.concat(F.lit("Previous messages:\n\nCurrent message:\n"), F.coalesce("speaker", F.lit("None")), F.lit(": "), F.col("target"))
    alone = (F.col("text") == F.col("target")) | (F.col("text") == framed)
    known = F.col("condition").isin(conditions)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    per_base = rows.groupBy("base_text_hash").agg(F.countDistinct(F.when(known, F.col("condition"))).alias("_c"), F.count(F.lit(1)).alias("_k"))
    both = rows.join(per_base.withColumnRenamed("base_text_hash", "_b"), F.col("base_text_hash").eqNullSafe(F.col("_b")))
    isolated = F.col("condition").eqNullSafe("isolated")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return violations(
        both,
        "id",
        {
            "id": no(F.col("id") != "") | (F.col("_n") > 1),
            "condition": no(known),
            "target": no(F.col("target") != "") | F.col("text").isNull(),
            "isolated text": isolated & no(alone),
            "target not at the end": ~isolated & no(F.col("text").endswith(F.col("target"))),
            "text hash": no(F.sha2("text", 256) == F.col("text_hash")),
            "base hash": no(F.col("base_text_hash").rlike(HASH)),
            "conditions of the base": (F.col("_c") != len(conditions)) | (F.col("_k") != len(conditions)),
        },
    )


def cost_ceiling(seconds: Column, rate: Column, machines: int = 8, startup: int = 20) -> Column:
    """What a wave may cost at most: all machines for its time and their start."""
    return F.round(F.lit(machines) * (seconds + startup) * rate, 3)
