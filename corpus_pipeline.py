"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, mixing, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm import langid, mixing, near_texts, packing, suffix_dedup
from loomline.llm.common import checkpoint, key_filter, remove, shared_folder, written


def _key() -> Column:
    """A row among others of its id."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("_key")


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("_row"), _key())


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and those without a letter.

    Null ids, sources and languages are no matter; a null language is not learned from. Equal texts
    are judged alike and repeated rows stay rows. With no labelled row nothing is in a language; an
    empty table gives no rows. All columns pass, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    judged = langid.predict(rows, langid.fit(docs), keep=[F.col("_row")])
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate component, once.

    Null ids come first. Of rows of that id in the component the least by hash of the text stays,
    and one of rows repeated. Empty texts are near duplicates of each other, as one empty text. An
    empty table gives no rows; all columns pass, whatever their names. Most documents are in no
    question: they pass without a shuffle.
    """
    classes = near_texts.verified_components(docs.select(_key(), "text"), ident="_key").groupBy("_key")
    classes = classes.agg(F.min("component_id").alias("_head"), F.count(F.lit(1)).alias("_n"))
    doubt = checkpoint(classes.where((F.col("_key") != F.col("_head")) | (F.col("_n") > 1)))
    code = F.xxhash64("_key").alias("_code")
    may_go = key_filter(doubt.select(code), "_code")
    rows = _with_key(docs).withColumn("_may", may_go(F.xxhash64("_key")))
    asked = rows.where("_may").join(doubt, "_key", "left")
    kept = asked.where(F.col("_head").isNull())
    several = asked.where(F.col("_key") == F.col("_head")).dropDuplicates(["_key"])
    return rows.where(~F.col("_may")).select("_row").union(kept.select("_row")).union(several.select("_row")).select("_row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every 200-byte string that stands more than once, and with it documents left without a word.

    All occurrences go, as in the operator; characters stay whole; n_chars is counted again. Null
    and wordless texts go; texts of fewer bytes stay as they are; texts that repeat from end to end
    go with all their rows; null ids are no matter. An empty table gives no rows; other columns
    pass, whatever their names.
    """
    left = suffix_dedup.remove_repeats(docs).where(mixing.word_count() > 0)
    return left.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, whole.

    A null source is a source of its own; null ids, ties and repeated rows are drawn each by
    itself; null and wordless texts are never taken. An empty table gives no rows; all columns
    pass, whatever their names.
    """
    key = F.struct("doc_id", "source", F.sha2("text", 256).alias("h")).alias("_key")
    taken = mixing.mix(docs.select(key, "source", "text"), ident="_key", whole_documents=True).where("size > 0")
    whole = F.expr("sum(taken) div max(size)").alias("_copies")
    copies = checkpoint(taken.groupBy("_key").agg(whole, F.count(F.lit(1)).alias("_rows")))
    rows = docs.select(F.struct("*").alias("_row"), key).join(copies.where("_copies > 0"), "_key")
    single = rows.where("_rows = 1").select("_row", "_copies")
    # Rows of one key share its copies: equal ones by their number, different ones by their order.
    equal = rows.where("_rows > 1").groupBy("_key", "_row").agg(F.max("_copies").alias("_copies"), F.max("_rows").alias("_rows"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_key").orderBy(F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, 0)
    equal = equal.withColumn("_end", F.sum("_n").over(order))
    equal = equal.select("_row", F.expr("_end * _copies div _rows - (_end - _n) * _copies div _rows").alias("_copies"))
    many = single.union(equal).where("_copies > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr("(_copies - 1) div 4096"))))
    left = F.least(F.lit(4096), F.col("_copies") - F.col("_block") * 4096).cast("int")
    return many.select("_row", F.explode(F.array_repeat(F.lit(0), left))).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences.

    A null text is the end alone; null ids stay null; repeated rows are packed each by itself;
    equal pieces tie by row; an empty table gives no rows; other columns are not read.
    """
    return packing.pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Language prediction, SimHash components, suffix sorting and tokenisation cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    packed = checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return packed
