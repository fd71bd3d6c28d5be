"""Lempel-Ziv phrase fingerprints.

A text's bytes are parsed into dictionary phrases, each the longest known phrase and one byte more.
The set of phrases is hashed, and the minima of many hash permutations, a byte of each, make the
fingerprint: the share of agreeing places estimates the overlap of two phrase sets, a likeness of
the kind that compression measures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MIN, checkpoint, prepare
from .ordered import dealing_keys, joined, range_number, splits_of

PERMUTATIONS = 128
RANGE_BYTES = 1 << 20
MAX_RANGES = 16384

_rng = np.random.default_rng(9)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = int(_rng.integers(0, 1 << 64, dtype=np.uint64)) | 5
_A = _rng.integers(0, 1 << 32, (PERMUTATIONS, 1), dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, (PERMUTATIONS, 1), dtype=np.uint32)
_LAST = np.uint32(0x9E3779B1)
_weights = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """The first ``count`` powers of the step, modulo 2^64."""
    global _weights
    if len(_weights) < count:
        factors = np.full(max(count, 2 * len(_weights)), _STEP, np.uint64)
        factors[0] = 1
        _weights = np.multiply.accumulate(factors)
    return _weights[:count]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Parse:
    """A parse in progress: the phrase tree, the open phrase, and the ends of the phrases so far."""

    __slots__ = ("ends", "node", "tree")

    def __init__(self, tree: dict[int, int] | None = None, node: int = 0) -> None:
        self.tree, self.node, self.ends = {} if tree is None else tree, node, []

    def copy(self) -> Parse:
        """The parse so far, without its ends, to go on another way."""
        return Parse(self.tree.copy(), self.node)

    def feed(self, data: bytes, at: int) -> Parse:
        """Go on with ``data``, whose first byte is number ``at`` of the text."""
        node, add, end = self.node, self.tree.setdefault, self.ends.append
        new = len(self.tree) + 1 << 8
        for at, byte in enumerate(data, at + 1):
            node = add(node | byte, new)
            if node == new:
                new += 256
                end(at)
                node = 0
        self.node = node
        return self


def phrase_hashes(data: bytes, ends: list[int], start: int = 0, whole: bool = True) -> np.ndarray:
    """Hashes of the phrases from ``start`` on that end there, and, of a whole text, of a rest at its end."""
    if whole and len(data) > (ends[-1] if ends else start):
        ends = [*ends, len(data)]
    if not ends:
        return np.zeros(0, np.uint64)
    stops = np.array(ends, np.int64) - start
    starts = np.concatenate([[0], stops[:-1]])
    sizes = stops - starts
    place = np.arange(int(stops[-1])) - np.repeat(starts, sizes)
    codes = np.frombuffer(data, np.uint8)[start : ends[-1]]
    sums = np.add.reduceat(_BYTE[codes] * powers(int(sizes.max()))[place], starts)
    return mix(sums + sizes.astype(np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes' upper halves under each permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for low in range(0, len(upper), 4096):
        np.minimum(least, (upper[None, low : low + 4096] * _A + _B).min(axis=1), out=least)
    return least


def signed(least: np.ndarray) -> bytes:
    """A byte of each least value."""
    return ((least ^ least >> np.uint32(16)) * _LAST >> np.uint32(24)).astype(np.uint8).tobytes()


def signature(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set of phrases; nothing for none."""
    return signed(minima(hashes)) if len(hashes) else b""


def likeness(a: bytes, b: bytes) -> float:
    """Estimated overlap of two phrase sets, 0 to 1: the agreeing bytes beyond those that agree by chance."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / PERMUTATIONS
    return max(0.0, (same * 256 - 1) / 255)


class Fingerprint:
    """A text's fingerprint, and its parse up to where the edited text departs from it."""

    __slots__ = ("chars", "head", "ident", "least", "open", "parse", "sign", "take")

    def __init__(self, ident: object, text: str) -> None:
        self.ident, self.chars, self.take = ident, len(text), len(text) // 2
        self.head = text[: self.chars - self.take].encode()
        self.parse = Parse().feed(self.head, 0)
        self.least = minima(phrase_hashes(self.head, self.parse.ends, whole=False))
        self.open = self.parse.ends[-1] if self.parse.ends else 0
        self.sign = self.then(self.parse.copy(), text[self.chars - self.take :].encode())

    def then(self, parse: Parse, rest: bytes) -> bytes:
        """The fingerprint of the head and a rest, given the parse of the head."""
        data, before = self.head + rest, len(self.head)
        parse.ends = []
        hashes = phrase_hashes(data, parse.feed(rest, before).ends, self.open)
        return signed(np.minimum(self.least, minima(hashes))) if data else b""

    def against(self, text: str, sign: bytes) -> tuple:
        """The row of this text, given the next one."""
        rest = text[: self.take].encode()
        other = self.then(self.parse, rest)
        return (
            self.ident, self.chars, hashlib.sha256(self.head + rest).hexdigest(), self.sign.hex(), other.hex(),
            likeness(self.sign, other), likeness(self.sign, sign),
        )


def _run(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_range, held = None, None
        for batch in batches:
            rows = []
            for in_range, borrowed, ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                if in_range != open_range:
                    open_range, held = in_range, None
                if borrowed and held is None:
                    continue
                new = Fingerprint(ident, text)
                if held is not None:
                    rows.append(held.against(text, new.sign))
                held = None if borrowed else new
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return run


def fingerprint(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses.

    Returns ``ident``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last half of code points replaced by as many of the next
    document's first, in ascending order of id, after the last the first. A null id is the least,
    rows of equal id are in the order of a hash of their texts, a null text is empty; an empty
    text's fingerprint is the empty string, like only to itself. A single row is its own next
    document; repeated rows stay rows, next to each other. Other columns are not read.

    Rows are dealt by ranges of (id, hash) of about ``range_bytes``; each range also gets the first
    document of the range after it. Only rows equal in id and text cannot be parted; they pass one
    by one through their task.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.coalesce(F.col(ident).cast("long"), F.lit(LONG_MIN)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"),
        F.col(ident).alias("_ident"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    light = checkpoint(rows.select("_id", "_h", (F.octet_length("_text") + 16).cast("long").alias("_size")))
    total = light.agg(F.sum("_size")).first()[0] or 0
    splits = splits_of(light, "_id", "_h", int(min(MAX_RANGES, 1 + 4 * total // range_bytes)))
    per_range = light.groupBy(range_number(splits)("_id", "_h").alias("r")).agg(F.sum("_size").alias("b"))
    splits = joined(splits, {r["r"]: r["b"] for r in per_range.collect()}, max(range_bytes, total // MAX_RANGES))
    number = range_number(splits)
    firsts = light.groupBy(number("_id", "_h").alias("r")).agg(F.min(F.struct("_id", "_h")).alias("f"))
    firsts = sorted((r["r"], tuple(r["f"])) for r in firsts.collect())
    keys = dealing_keys(spark, max(1, len(firsts)))
    key_of = {r: keys[i] for i, (r, _) in enumerate(firsts)}
    lends = {f: key_of[firsts[i - 1][0]] for i, (_, f) in enumerate(firsts)}

    @F.pandas_udf("int")
    def own_key(r: pd.Series) -> pd.Series:
        return r.map(key_of).astype("int32")

    @F.pandas_udf("int")
    def lent_key(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lends.get(x) for x in zip(a.tolist(), b.tolist())], dtype="Int32")

    own = rows.select(own_key(number("_id", "_h")).alias("r"), F.lit(False).alias("borrowed"), "_id", "_h", "_ident", "_text")
    lent = rows.select(lent_key("_id", "_h").alias("r"), "_id", "_h", "_text").where(F.col("r").isNotNull())
    lent = lent.groupBy("r").agg(F.min(F.struct("_id", "_h", "_text")).alias("x"))
    none = F.lit(None).cast(rows.schema["_ident"].dataType)
    lent = lent.select("r", F.lit(True).alias("borrowed"), "x._id", "x._h", none.alias("_ident"), "x._text")
    dealt = own.unionByName(lent).repartition(len(keys), "r")
    ordered = dealt.sortWithinPartitions("r", "borrowed", "_id", "_h", "_text").select("r", "borrowed", "_ident", "_text")
    kind = docs.schema[ident].dataType.simpleString()
    out = f"{ident} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return ordered.mapInArrow(_run(to_arrow_schema(StructType.fromDDL(out))), out)
