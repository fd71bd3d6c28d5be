"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; within its source the
documents are ordered by that key and prefix-summed to the source's token budget. A budget above
the source's size is met by complete epochs first, and the sampled order fills the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, text_bytes

#: Relative weights dealt to the sources in code point order, null last, and repeated.
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BIN = 10_000
#: Equal rows that are numbered at a time.
COPIES = 4096


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column, n_bytes: Column) -> Column:
    """Quality weight of a text, 0.5 to 2.5: its words up to 200 in 200ths, one more at 4 to 10 bytes a word, as prose has."""
    prose = (n_bytes >= 4 * size) & (n_bytes <= 10 * size) & (size > 0)
    return F.lit(0.5) + F.least(size, F.lit(200)) / F.lit(200.0) + F.when(prose, F.lit(1.0)).otherwise(F.lit(0.0))


def exponential_key(row: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, with u from the leading 52 bits of an md5 of seed and the row's own string."""
    digest = F.md5(F.concat(F.lit(seed + ":"), row).cast("binary"))
    drawn = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(drawn) / weight


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``_copy``, a number from 0 among the rows equal to them.

    Equal rows are counted, with map-side sums, and told apart again by numbers in blocks, so that
    no task sorts or holds them.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    each = F.sequence(F.col("_low"), F.least(F.col("_low") + COPIES, F.col("_n")) - 1)
    return blocks.withColumn("_copy", F.explode(each)).drop("_n", "_low")


def source_targets(sizes: DataFrame, *, cycle: tuple[int, ...] = CYCLE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size) rows, as source, source_size, target.

    The targets share the total size by weight. One that would exceed ``epochs`` times its source
    stops there, and the excess is shared by weight among the rest until none is above. With the
    sources ordered by limit over weight, that is one level: those before it are at their limits
    and the others have level times weight. One row a source reaches the single window task.
    """
    in_turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_turn")
    return (
        sizes.withColumn("_turn", in_turn)
        .withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in cycle]), F.col("_turn") % len(cycle)))
        .withColumn("_limit", F.col("source_size") * float(epochs))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_before", F.sum("_limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_rest", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.coalesce("_before", F.lit(0.0))) / F.col("_rest"))
        .withColumn("_open", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_turn", "_level")))
        .withColumn("_chosen", F.min("_open").over(every)["_level"])
        .select(
            "source",
            "source_size",
            F.least("_limit", F.coalesce(F.col("_chosen") * F.col("_weight"), F.col("_limit"))).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    *,
    ident: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "mix",
    cycle: tuple[int, ...] = CYCLE,
    epochs: int = MAX_EPOCHS,
    whole_documents: bool = False,
) -> DataFrame:
    """Words that the mix takes of each document.

    Returns ``ident``, size, source_size, target, taken. ``taken`` is size times the complete
    epochs, plus size again where the document lies in its source's fractional selection; the one
    document at the end of the budget gives its remaining words, or, with ``whole_documents``, is
    taken or left as a whole, whichever comes nearer. The order within a source is a function of
    seed, id, text, weight and, among equal rows, their number, so reruns agree.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own,
    last in order; a null id is an id like any other; rows of one id, and repeated rows, are drawn
    each by itself; an empty table gives no rows; sources of size 0 have target 0. A hot source is
    summed in bins of its keys and only the bin totals meet in a task.
    """
    rows = docs.select(
        F.col(ident).alias("_id"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("_bytes"),
        F.md5(text_bytes(text)).alias("_text"),
    )
    rows = numbered(rows)
    own = F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text", F.col("_copy").cast("string"))
    key = exponential_key(own, quality(F.col("size"), F.col("_bytes")), seed)
    rows = checkpoint(rows.select("_id", "source", "size", "_text", "_copy", key.alias("_key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    bins = sizes.select("source", F.ceil(F.col("_rows") / ROWS_PER_BIN).alias("_bins"))
    targets = source_targets(sizes.drop("_rows"), cycle=cycle, epochs=epochs).join(
        bins.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    )
    targets = targets.drop("_s").withColumnRenamed("source", "_s").withColumnRenamed("source_size", "_source_size")

    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_bin", F.floor((1 - F.exp(-F.col("_key"))) * F.col("_bins")))
    totals = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("_o"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("source", "_bin").orderBy("_key", "_id", "_text", "_copy").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_end", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("_o")) & (F.col("_bin") == F.col("_b"))
    )
    end, size = F.col("_end") + F.col("_offset"), F.col("size")
    full = F.when(F.col("_source_size") > 0, F.floor(F.col("target") / F.col("_source_size"))).otherwise(F.lit(0))
    budget = F.round(F.col("target") - full * F.col("_source_size")).cast("long")
    if whole_documents:
        part = F.when(end - size / 2 <= budget, size).otherwise(F.lit(0))
    else:
        part = F.least(size, F.greatest(F.lit(0), budget - (end - size)))
    return summed.select(
        F.col("_id").alias(ident),
        "size",
        F.col("_source_size").alias("source_size"),
        "target",
        (full * size + part).cast("long").alias("taken"),
    )


#: DuckDB SQL for the rows of the query on ``documents``.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(strlen(text), 0) AS n_bytes, md5(coalesce(text, '')) AS body
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, body) - 1 AS copy FROM sized
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || body || ':' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (0.5::DOUBLE + least(size, 200) / 200.0::DOUBLE + CASE WHEN size > 0 AND n_bytes >= 4 * size AND n_bytes <= 10 * size THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS k
  FROM numbered
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5.0, 2.0, 1.0])[(turn % 3 + 1)::INT]::DOUBLE AS w, source_size * 3.0::DOUBLE AS lim FROM sources
), levels AS (
  SELECT *, lim / w AS ratio,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY lim / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), chosen AS (
  SELECT arg_min(level, turn_rank) AS level FROM (
    SELECT level, ratio, row_number() OVER (ORDER BY ratio, turn) AS turn_rank FROM levels) WHERE level <= ratio
), targets AS (
  SELECT source, source_size, least(lim, coalesce((SELECT level FROM chosen) * w, lim)) AS target FROM levels
), summed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.body, d.copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS full_epochs
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (full_epochs * size + least(size, greatest(0, round(target - full_epochs * source_size)::BIGINT - (e - size))))::BIGINT AS taken
FROM summed
"""
