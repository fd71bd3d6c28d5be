"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` of 64 bits agree on at least k of ``radius + k``
blocks of bits, so each is filed once under every k of the blocks, two or more for larger tables.
Within a file, distances are found on vertical bit planes: 64 pairs to a machine word, summed by carry-save adders eight
planes at a time, and words whose pairs all exceed the radius are abandoned. Only distinct
fingerprints are compared, and what leaves a task is a spanning forest of the links it found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, prepare
from .components import components

BITS = 64
SEED = 42
RADIUS = 4
#: Fingerprints of one file that are compared in one task; a larger file is compared by pairs of such parts.
FILE_ROWS = 2048
CHUNK_ROWS = 1 << 16


def shingle_hashes(text: bytes, words: int) -> list[bytes]:
    """XXH64 digests of a text's shingles: A-Z in lower case, words joined by one space."""
    found = text.lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_digest(b" ".join(found), SEED)]
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    starts = [0, *[e + 1 for e in ends[: len(found) - words]]]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]


def fingerprint(text: bytes, words: int) -> int:
    """The 64 bits that are set in over half the shingle hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        part = np.frombuffer(b"".join(hashes[low : low + (1 << 14)]), np.uint8)
        counts += np.add.reduce(np.unpackbits(part).reshape(-1, BITS), axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(``ident``, fp) of every row, fp as a signed 64-bit number. A null text counts as empty."""
    prepare(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["_id", "fp"])

    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    return rows.mapInArrow(of, f"_id {kind}, fp long").withColumnRenamed("_id", ident)


def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the carries and the sums of three words of bits."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the lanes whose bit-sliced count, low digit first, is above ``radius``."""
    above = np.zeros_like(counter[0])
    for digit, plane in enumerate(counter):
        above = (plane | above) if not radius >> digit & 1 else (plane & above)
    return above


def planes_of(values: np.ndarray) -> np.ndarray:
    """(bits, words) bit planes of rows of uint64 values: bit r of word w in plane p is bit p of row 64 w + r."""
    raw = values.astype("<u8").reshape(len(values), -1)
    bits = np.unpackbits(raw.view(np.uint8), axis=1, bitorder="little")
    room = -len(values) % 64 + 64
    bits = np.vstack([bits, np.zeros((room, bits.shape[1]), np.uint8)])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_steps(groups: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within ``radius`` bits, among rows of equal group, a step at a time; rows are sorted by group.

    Step s compares every row with the one s places on, all lanes at once. Eight planes at a time
    are added by carry-save adders to digits that count to ``radius``; what goes beyond stays set.
    """
    _, sizes = np.unique(groups, return_counts=True)
    planes = planes_of(values)
    high = max(0, radius.bit_length() - 3)
    for step in range(1, int(sizes.max(initial=1))):
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: len(groups) - step] = groups[step:] == groups[:-step]
        live = np.packbits(same, bitorder="little").view("<u8")
        at = np.flatnonzero(live)
        live = live[at]
        word, shift = divmod(step, 64)
        counter = [np.zeros(len(at), np.uint64) for _ in range(4 + high)]
        for low in range(0, len(planes), 8):
            if not len(at):
                break
            own = planes[low : low + 8][:, at]
            here = np.minimum(at + word, planes.shape[1] - 1)
            other = planes[low : low + 8][:, here] >> np.uint64(shift)
            if shift:
                there = np.minimum(here + 1, planes.shape[1] - 1)
                other |= planes[low : low + 8][:, there] << np.uint64(64 - shift)
            x = own ^ other
            ones, twos, fours, *more = counter
            t1, ones = add(ones, x[0], x[1])
            t2, ones = add(ones, x[2], x[3])
            f1, twos = add(twos, t1, t2)
            t1, ones = add(ones, x[4], x[5])
            t2, ones = add(ones, x[6], x[7])
            f2, twos = add(twos, t1, t2)
            carry, fours = add(fours, f1, f2)
            for d in range(high):
                carry, more[d] = more[d] & carry, more[d] ^ carry
            more[high] = more[high] | carry
            counter = [ones, twos, fours, *more]
            live = live & ~exceeds(counter, radius)
            keep = np.flatnonzero(live)
            if len(keep) < len(at):
                at, live = at[keep], live[keep]
                counter = [c[keep] for c in counter]
        if len(at):
            lanes = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(lanes)
            first = at[row] * 64 + bit
            yield first, first + step


def near_pairs(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of ``near_steps``."""
    found = list(near_steps(groups, values, radius))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (a, b), as few as hold together what all of them do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y) if x < y else (y, x))
    return np.array([x for x, _ in kept], np.int64), np.array([y for _, y in kept], np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups, some ``CHUNK_ROWS`` rows at a time; rows are sorted by their first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(c[0]) for c in held) >= CHUNK_ROWS:
            columns = [np.concatenate(x) for x in zip(*held)]
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            if whole:
                yield [c[:whole] for c in columns]
            held = [[c[whole:] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def several(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of groups of more than one."""
    _, at, sizes = np.unique(columns[0], return_inverse=True, return_counts=True)
    kept = sizes[at] > 1
    return [c[kept] for c in columns]


def compare(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (group, fp), sorted by group, to links (a, b): a forest of each chunk's near pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in chunks(batches):
            groups, values = several(columns)
            i, j = near_pairs(groups, values.view(np.uint64), radius) if len(groups) else (np.zeros(0, np.int64),) * 2
            a, b = forest(values[i], values[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def parted(rows: DataFrame, node: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows with ``group`` for ``file``: large files are compared by pairs of parts, so every two of their rows meet."""
    large = rows.groupBy("file").count().where(F.col("count") > file_rows)
    large = large.select("file", F.ceil(F.col("count") * 2 / file_rows).cast("int").alias("_parts"))
    rows = rows.join(large, "file", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.pmod(F.xxhash64(F.lit(1), node), F.col("_parts")).cast("int")
    rows = rows.withColumn("_part", part).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    group = F.xxhash64("file", F.least("_part", "_with"), F.greatest("_part", "_with")).alias("group")
    return rows.select(group, *[c for c in rows.columns if c != "file" and not c.startswith("_")])


def agreeing(count: int, radius: int) -> int:
    """How many blocks a file's fingerprints share: two, or as many as keep files of chance meetings below ``FILE_ROWS``."""
    found = 2
    while found < 6 and count >> BITS * found // (radius + found) > FILE_ROWS:
        found += 1
    return found


def filed(distinct: DataFrame, radius: int, file_rows: int = FILE_ROWS, agree: int = 2) -> DataFrame:
    """(group, fp): every fingerprint under each ``agree`` of its blocks of bits, large files by pairs of parts."""
    blocks = radius + agree
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    piece = [
        F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])
    ]
    keys = F.array(*[F.xxhash64(F.lit(n), *[piece[i] for i in some]) for n, some in enumerate(combinations(range(blocks), agree))])
    return parted(distinct.select("fp", F.explode(keys).alias("file")), "fp", file_rows)


def link(distinct: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, whose components are those of all pairs within ``radius``."""
    agree = agreeing(distinct.count(), radius)
    groups = filed(distinct, radius, agree=agree).repartition("group").sortWithinPartitions("group", "fp")
    return groups.mapInArrow(compare(radius), "a long, b long").distinct()


def near_components(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", words: int = 4, radius: int = RADIUS) -> DataFrame:
    """(``ident``, fingerprint, component_id) of every row.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id
    reachable. Null and empty texts have fingerprint zero and link like any other; a text of fewer
    words is one shingle; repeated rows share a fingerprint and stay rows; null ids stay null and
    are passed over for component_id. Other columns are not read.
    """
    rows = checkpoint(fingerprints(docs, ident=ident, text=text, words=words))
    least = checkpoint(rows.groupBy("fp").agg(F.min(ident).alias("_least")))
    linked = components(link(least.select("fp"), radius=radius)).withColumnRenamed("node", "fp")
    classes = least.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = classes.groupBy("component").agg(F.min("_least").alias("component_id"))
    heads = classes.join(heads, "component").select("fp", "component_id")
    return rows.join(heads, "fp").select(ident, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
