"""Sharded exports with manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 25_000
LONG_STRING = 4000
LONG_LIST = 40
# Keys that a redacted export leaves out.
DROPPED_KEYS = ("examples", "samples", "raw", "path", "file")


def _ranged(rows: DataFrame, first: str, parts: int) -> DataFrame:
    """``rows`` with ``_range``, by quantiles of a column; nulls come first."""
    kind = dict(rows.dtypes)[first]
    cuts = rows.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{kind}>")
    return rows.withColumn("_range", F.when(F.col(first).isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col(first)))))


def _before(sums: dict[int, int], parts: int) -> Column:
    """The sum of the ranges before a row's own."""
    ends = [sum(n for k, n in sums.items() if k < i) for i in range(parts + 1)]
    return F.get(F.array(*[F.lit(e) for e in ends]).cast("array<long>"), F.col("_range"))


def numbered(rows: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """``rows`` with ``position``, the zero-based place in a total order, without one task for all.

    Rows are ranged by the first key's quantiles, ranked inside, and offset by the counts of the
    ranges before, which are at most ``parts`` numbers.
    """
    ranged = _ranged(rows, order[0], parts)
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("position", rank + _before(counts, parts)).drop("_range")


def running_before(rows: DataFrame, order: str, value: str, parts: int = 256) -> DataFrame:
    """``rows``, unique by ``order``, with ``before``: the sum of ``value`` over all rows before, by ranges like ``numbered``."""
    ranged = _ranged(rows, order, parts)
    sums = {r["_range"]: r["s"] or 0 for r in ranged.groupBy("_range").agg(F.sum(value).alias("s")).collect()}
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)) + _before(sums, parts)).drop("_range")


def sharded(rows: DataFrame, order: list[str], size: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with position and shard, each shard ``size`` rows of the order."""
    return numbered(rows, order).withColumn("shard", F.expr(f"position div {size}"))


def write_shards(rows: DataFrame, path: str, order: list[str], size: int = SHARD_ROWS) -> DataFrame:
    """Write gzip JSON Lines, one ordered file a shard, and return the manifest of what was written.

    The folder must not exist. Rows that were written are counted against rows that were given.
    """
    spark = rows.sparkSession
    placed = sharded(rows, order, size)
    dealt = placed.repartition("shard").sortWithinPartitions("shard", "position").drop("position")
    dealt.write.mode("errorifexists").partitionBy("shard").option("compression", "gzip").json(path)
    found = manifest(spark, path)
    exported, total = found.agg(F.sum("rows")).first()[0] or 0, rows.count()
    if exported != total:
        raise ValueError(f"{exported} rows written of {total}")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, file, bytes, sha256, rows) of the files of an export."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").text(path)
    lines = lines.select(F.input_file_name().alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    counted = lines.select(name(F.col("name")).alias("file"), F.regexp_extract("name", r"shard=(\d+)", 1).cast("long").alias("shard"), "rows")
    return files.select(shard.alias("shard"), name(F.col("path")).alias("file"), "bytes", "sha256").join(counted, ["file", "shard"], "left").fillna(0, ["rows"])


def shard_counts(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """(shard, rows, first, last position) of a sharding, without writing it."""
    placed = sharded(rows, order, size)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("position").alias("first"), F.max("position").alias("last"))


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` to append: one a key, keys already stored left out; the first writer wins."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Key-value rows with those of ``new`` in place of the old; of rows of one key the last by ``order`` stands.

    Without an order the keys of ``new`` must be unique: a repeated one is an error when it runs.
    """
    if order is not None:
        whole = F.struct(*[F.col(c) for c in new.columns])
        new = new.groupBy(key).agg(F.max_by(whole, order).alias("_row")).select("_row.*")
    else:
        once = new.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("*")).alias("_row"))
        error = F.raise_error(F.lit("a key is written more than once, and nothing says which is last"))
        new = once.where(F.when(F.col("_n") > 1, error).otherwise(F.lit(True))).select("_row.*")
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def append_ledger(rows: DataFrame, spark: SparkSession, path: str) -> int:
    """Append review records as JSON Lines, numbered after those that are there; returns the new total.

    A ledger has one writer. Reviews are typed by people, so a batch of them is numbered in one task.
    """
    try:
        before = spark.read.schema("id string").json(path).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        before = 0
    number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + before
    rows.withColumn("id", F.concat(F.lit("review-"), number.cast("string"))).coalesce(1).write.mode("append").json(path)
    return before + rows.count()


def publish(df: DataFrame, path: str) -> None:
    """Write beside the target and put it in place by renames: readers see a whole table, old or new.

    An old table is renamed aside first and deleted last; if the new one cannot take its place, the
    old one is put back.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stem = path.rstrip("/")
    target, staging, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (stem, stem + ".staging", stem + ".old"))
    files = target.getFileSystem(conf)
    if files.exists(aside) and not files.exists(target):  # an earlier publication stopped between its renames
        files.rename(aside, target)
    df.write.mode("overwrite").parquet(stem + ".staging")
    files.delete(aside, True)
    held = files.exists(target)
    if held and not files.rename(target, aside):
        raise OSError(f"could not move the old {path} aside")
    if not files.rename(staging, target):
        if held:
            files.rename(aside, target)
        raise OSError(f"could not publish {path}")
    files.delete(aside, True)


def prune(value: object, key: str = "") -> object:
    """A driver-side JSON value without bulky keys, its long lists as counts and long strings cut."""
    if isinstance(value, dict):
        return {k: prune(v, k) for k, v in value.items() if k not in DROPPED_KEYS}
    if isinstance(value, list):
        return {"omitted": len(value)} if len(value) > LONG_LIST else [prune(v, key) for v in value]
    return value[:LONG_STRING] if isinstance(value, str) else value


# The fields of a prediction's JSON that an export may hold.
PREDICTION_FIELDS = (
    "primary_candidate", "primary_act", "score_semantics", "scores",
    "candidate_templates", "template", "template_status", "slot_values",
    "extraction_performed", "context_used", "multi_act_status",
    "review_reasons", "truncation",
)


def prediction_fields(result: Column) -> Column:
    """The allowed fields of a prediction's JSON, each as JSON text or null, its run and epoch, and the runtime's truncation.

    Text that does not parse, and null, give parse_error and no field.
    """
    parsed = F.try_parse_json(result)
    field = lambda name, path=None: F.to_json(F.try_variant_get(parsed, f"$.{path or name}", "variant")).alias(name)
    kept = [field(n) for n in (*PREDICTION_FIELDS, "run_id", "execution_epoch_id")]
    return F.struct(*kept, field("runtime_truncation", "runtime.truncation"), parsed.isNull().alias("parse_error"))


def run_manifest(messages: DataFrame, predictions: DataFrame, run_id: str, recorded: str = "complete") -> DataFrame:
    """One row of a run's manifest: records, texts, classified_records, classified_texts, shares, labels as a map, and the state.

    A run that is recorded as complete and has texts left is incomplete.
    """
    from .index import coverage, label_counts, run_state

    labels = label_counts(messages, predictions, run_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "records")))).alias("labels"))
    found = coverage(messages, predictions, run_id).crossJoin(labels)  # one row each
    left = F.col("texts") - F.col("classified_texts")
    return found.withColumn("state", run_state(F.lit(recorded), left, F.lit(False), F.lit(True)))
