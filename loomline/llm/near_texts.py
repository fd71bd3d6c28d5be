"""Near-duplicate texts by long SimHash fingerprints, each link verified on the texts.

A fingerprint has 128 bits over the set of a text's two-word shingles. Texts meet in files by
samples of its bits, as many as let a pair of the sought likeness meet almost surely, and are
compared there bit-sliced; a file's nearest links that hold its near texts together, a minimum
spanning forest by steps of distance, are verified first. Where one fails, the texts of its cluster
meet once more with their hashed shingles, and a task compares every near pair whose parts are not
yet one: so no near pair is passed over, and rows are links of forests and never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cuts, key_filter, prepare
from .components import components
from .simhash import chunks, near_steps, parted, several
from .tokens import distinct, mixed, word_hashes

BITS = 128
#: Steps of distance: links within the first come first; the last is the radius of candidates.
RADII = (8, 16, 26)
#: The share of bits in which a pair may differ that is to meet with probability ``MEET``.
DIFFER, MEET = 0.15, 0.97
#: A file has about two to the power of this many texts by chance.
CROWD = 8
LEAST_SAMPLED = 10
#: Rows of a file whose texts meet with their shingles; larger ones meet by pairs of parts.
SET_ROWS = 512
_STEP, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def long_fingerprints(texts: list[bytes]) -> np.ndarray:
    """(texts, 2) words of the bits that are set in over half of the distinct two-word shingles; A-Z in lower case, 0 without words."""
    words, counts = word_hashes(texts)
    found, end = np.zeros((len(texts), BITS // 64), "<u8"), 0
    for row, count in enumerate(counts.tolist()):
        own = words[end : end + count]
        end += count
        if not count:
            continue
        shingles = distinct(mixed(own[:-1] * _STEP + own[1:]) if count > 1 else mixed(own))
        ones = np.zeros(BITS, np.int64)
        for low in range(0, len(shingles), 1 << 13):
            part = shingles[low : low + (1 << 13)]
            both = np.stack([part, mixed(part + _SECOND)], axis=1).astype("<u8")
            ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found[row] = np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")
    return found


def samples(texts: int) -> tuple[int, int]:
    """Bits of a sample, and samples: files of chance meetings stay small, and a pair that differs in ``DIFFER`` meets by ``MEET``."""
    bits = min(48, max(LEAST_SAMPLED, math.ceil(math.log2(max(2, texts))) - CROWD))
    return bits, math.ceil(math.log(1 - MEET) / math.log(1 - (1 - DIFFER) ** bits))


def _files(bits: int, count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, high, low) to (file, node, high, low), once for each sample of bits."""
    rng = np.random.default_rng(8)
    places = [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([batch.column(c).to_numpy().view("<u8") for c in (1, 2)], axis=1)
            planes = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little") if len(fps) else np.zeros((0, BITS), np.uint8)
            for n, at in enumerate(places):
                key = np.zeros(len(fps), np.uint64)
                for p in at:
                    key = key << np.uint64(1) | planes[:, p]
                file = mixed(key + np.uint64(n << 50)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(file), *batch.columns], ["file", "node", "high", "low"])

    return run


FILED = "file long, node long, high long, low long"


def _values(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.stack([high, low], axis=1).view(np.uint64)


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, node, high, low), sorted by group, to links (a, b): a forest of each chunk's near nodes, of nearest links by steps."""
    for columns in chunks(batches):
        groups, nodes, high, low = several(columns)
        names, at = np.unique(nodes, return_inverse=True)
        root, kept = np.arange(len(names)), []
        for radius in RADII if len(groups) else ():
            for i, j in near_steps(groups, _values(high, low), radius):
                a, b = root[at[i]], root[at[j]]
                apart = np.flatnonzero(a != b)
                up: dict[int, int] = {}
                for k in apart.tolist():
                    x, y = int(a[k]), int(b[k])
                    while x in up:
                        x = up[x]
                    while y in up:
                        y = up[y]
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        kept.append((at[i[k]], at[j[k]]))
                root = _settled(root, up)
        ends = names[np.array(kept, np.int64).reshape(-1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))] if len(ends) else [pa.array([], pa.int64())] * 2, ["a", "b"])


def shingle_hashes(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The hashed shingles of each text as ascending 32-bit numbers; those of a shorter text are itself."""
    hashes, counts = word_hashes(texts)
    found, end = [], 0
    for count in counts.tolist():
        own = hashes[end : end + count]
        end += count
        size = min(words, count)
        made = own[: count - size + 1]
        for at in range(1, size):
            made = mixed(made * _STEP + own[at : count - size + 1 + at])
        found.append(distinct((made >> np.uint64(32)).astype(np.uint32)) if count else np.zeros(0, np.uint32))
    return found


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two ascending sets overlap by ``least``, as far as hashes tell."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < least * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    return common >= least * (len(x) + len(y) - common)


def joining(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(group, node, high, low, component, shingles), sorted by group, to links (a, b): a forest of each chunk's alike nodes of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in chunks(batches):
            groups, nodes, high, low, component, shingles = several(columns)
            names, side = np.unique(component, return_inverse=True)
            root, kept, last, values = np.arange(len(names)), [], -1, _values(high, low)
            for radius in RADII if len(groups) else ():
                for i, j in near_steps(groups, values, radius):
                    a, b = root[side[i]], root[side[j]]
                    apart = np.flatnonzero(a != b)
                    if len(apart):
                        distance = np.bitwise_count(values[i[apart]] ^ values[j[apart]]).sum(axis=1)
                        apart = apart[distance > last]  # nearer ones were compared in an earlier step
                    up: dict[int, int] = {}
                    for k in apart.tolist():
                        x, y = int(a[k]), int(b[k])
                        while x in up:
                            x = up[x]
                        while y in up:
                            y = up[y]
                        if x != y and alike(np.frombuffer(shingles[i[k]], np.uint32), np.frombuffer(shingles[j[k]], np.uint32), least):
                            up[max(x, y)] = min(x, y)
                            kept.append((nodes[i[k]], nodes[j[k]]))
                    root = _settled(root, up)
                last = radius
            ends = np.array(kept, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1, initial=1 << 62)), pa.array(ends.max(axis=1, initial=-1))], ["a", "b"])

    return run


def _settled(root: np.ndarray, up: dict[int, int]) -> np.ndarray:
    """Roots after some of them got a smaller root."""
    if not up:
        return root
    new = np.arange(len(root))
    for x in sorted(up):  # a root's new root is smaller, and settled before it
        new[x] = new[up[x]]
    return new[root]


def shingle_set(text: bytes, words: int) -> set[bytes]:
    found = text.lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def _similar(words: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, b, node, text), sorted by pair, to the links (a, b) whose two texts have that overlap of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, set()
        for batch in batches:
            kept = []
            for a, b, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != pair:
                    pair, held = (a, b), shingle_set(text, words)
                    continue
                other = shingle_set(text, words)
                if len(held & other) >= least * len(held | other):
                    kept.append(pair)
            cells = list(zip(*kept)) if kept else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["a", "b"])

    return run


def verified_components(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(``ident``, component_id) of every row: components of the texts that share ``similarity`` of their shingles (Jaccard).

    Shingles are of ``shingle`` words, A-Z in lower case. Candidates are texts whose fingerprints
    are within the last of ``RADII`` and meet in a file; each that may join two components is
    compared, and each link found is verified on the texts, so links are missed only beyond that. component_id is the smallest id reachable,
    null first. Null and empty texts are one empty text; rows of one text share its component; null
    ids are ids like any other; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    cuts = Cuts(spark)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = F.unhex(F.substring(F.sha2(body, 256), 1, 32))  # 128 bits tell texts apart

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = long_fingerprints(batch.column(2).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(found[:, c]) for c in (0, 1))], ["_id", "h", "high", "low"])

    rows = docs.select(F.col(ident).alias("_id"), name.alias("h"), body.alias("_text"))
    schema = rows.select("_id", "h").schema.add("high", "long").add("low", "long")
    rows = cuts.cut("rows", rows.mapInArrow(marked, schema))
    texts = rows.groupBy("h").agg(F.min("_id").alias("least"), F.first("high").alias("high"), F.first("low").alias("low"))
    texts = cuts.cut("texts", texts.withColumn("node", F.monotonically_increasing_id()))
    files = _files(*samples(texts.count()))

    bodies = docs.select(name.alias("h"), body.alias("text"))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(texts.select("node", "h"), "node")
        ends = cuts.cut("ends", ends)
        asked = key_filter(ends.select(F.xxhash64("h").alias("code")), "code")
        read = bodies.where(asked(F.xxhash64("h"))).dropDuplicates(["h"])
        met = ends.join(read, "h").select("a", "b", "node", "text").repartition("a", "b").sortWithinPartitions("a", "b", "node")
        return met.mapInArrow(_similar(shingle, similarity), "a long, b long")

    def met(groups: DataFrame) -> DataFrame:
        return groups.repartition("group").sortWithinPartitions("group")

    filed = parted(texts.select("node", "high", "low").mapInArrow(files, FILED), "node")
    tested = cuts.cut("tested", met(filed).mapInArrow(spanning, "a long, b long").distinct())
    links = cuts.cut("links", verified(tested))
    failed = tested.join(links, ["a", "b"], "left_anti")
    if not failed.isEmpty():
        # Only clusters that a failed link holds together can have links still to be found.
        cluster = components(tested)
        open_ = cluster.join(failed.select(F.col("a").alias("node")), "node", "left_semi").select("component").distinct()
        doubt = texts.join(cluster.join(open_, "component").select("node"), "node").select("node", "h", "high", "low")
        doubt = doubt.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        doubt = cuts.cut("doubt", doubt)
        asked = key_filter(doubt.select(F.xxhash64("h").alias("code")), "code")
        read = doubt.select("node", "h").join(bodies.where(asked(F.xxhash64("h"))).dropDuplicates(["h"]), "h").select("node", "text")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [x.tobytes() for x in shingle_hashes(batch.column(1).to_pylist(), shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

        sets = cuts.cut("sets", read.mapInArrow(hashed, "node long, shingles binary"))
        filed = parted(doubt.select("node", "high", "low").mapInArrow(files, FILED), "node", SET_ROWS)
        filed = cuts.cut("filed", filed.join(doubt.select("node", "component"), "node").select("group", "node", "high", "low", "component"))
        parts = filed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("group")
        groups = filed.join(parts, "group", "left_semi").join(sets, "node").select(*filed.columns, "shingles")
        more = cuts.cut("more", met(groups).mapInArrow(joining(similarity - 1e-3), "a long, b long").distinct())
        links = cuts.cut("links", links.union(verified(more)))
    linked = components(links)
    classes = texts.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("least").isNotNull(), "least")
    lowest = classes.groupBy("component").agg(F.min(order).alias("_o"))
    found = classes.join(lowest, "component").select("h", F.col("_o.least").alias("component_id"))
    done = rows.join(found, "h").select(F.col("_id").alias(ident), "component_id")
    for table in ("ends", "tested", "links", "doubt", "sets", "filed", "more"):
        cuts.drop(table)
    return done
