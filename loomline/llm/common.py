"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

ARROW_BATCH_BYTES = 8 << 20
LONG_MIN = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, batch_bytes: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is missing, a local master, as in
    tests, gets a temporary one; a cluster's executors could not read it, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomline-checkpoint-"))
    return context.getCheckpointDir()


class Cuts:
    """Tables of an iteration, written to the shared folder to cut lineage; those replaced are removed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/cuts-{uuid.uuid4().hex}", 0
        self.latest: dict[str, str] = {}

    def cut(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` from its file; the last table of that name, which it may have been made from, goes."""
        self.count += 1
        path = f"{self.folder}/{name}-{self.count}"
        table = written(df, path)
        self.drop(name)
        self.latest[name] = path
        return table

    def drop(self, name: str) -> None:
        if name in self.latest:
            remove(self.spark, self.latest.pop(name))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table as Parquet and read it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def key_filter(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is true for every long of ``keys``, and for few others: a hashed bit set.

    It keeps rows that cannot match from being shuffled for a join; the join itself decides. The
    set has 16 bits a key and at most 2^27 (16 MiB), beyond which it lets more through.
    """
    spark = keys.sparkSession
    size = 1 << max(16, min(27, (16 * max(1, keys.count()) - 1).bit_length()))
    at = F.pmod(F.xxhash64(F.lit(11), column), F.lit(size))
    words = keys.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    bits = np.zeros(size // 64, np.int64)
    found = words.toArrow()  # at most 2^21 pairs of numbers
    bits[found["w"].to_numpy()] = found["v"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(place: pd.Series) -> pd.Series:
        n = place.to_numpy()
        return pd.Series((shared.value[n >> 6] >> (n & 63)) & 1 == 1)

    return lambda key: held(F.pmod(F.xxhash64(F.lit(11), key), F.lit(size)))


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def unit_hash(*columns: Column, bits: int = 52) -> Column:
    """A repeatable uniform number in (0, 1) from a 64-bit hash of the columns."""
    high = F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)
    return (high.cast("double") + 0.5) / float(1 << bits)


def literal_array(values: list[int], kind: str) -> Column:
    """A bounded list of driver numbers as one constant array, which the optimiser reads once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")
