"""Removal of repeated byte strings by two-stage suffix sorting.

Every 200-byte window has an anchor: the leftmost least hash among its 40-byte substrings. Equal
windows have equal anchors at equal places, so only windows whose anchor hash occurs elsewhere can
repeat. Those are cut out as segments, one per anchor, and meet by anchor hash. Equal segments
are counted and one of them stands for all: a segment that occurs twice repeats from end to end. A
task sorts the window starts of many different segments at once: suffixes smaller than their
successors are sorted directly, the rest are induced by one scan over the buckets of first bytes,
and the common prefix of neighbours tells which windows repeat. Equal whole texts never enter: one
of them stands for all, and each is covered from end to end.

Different segments of one anchor that are too many for one sort are cut finer. Their windows lie
at known distances from the anchor, so those of 20 neighbouring distances share 181 bytes, and
only windows equal in these meet again; what is still too much is told apart by whole windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG_MIN, checkpoint, key_filter, prepare, remove, shared_folder, text_bytes, written

WINDOW = 200
GRAM = 40
#: A text is read in parts of this many window starts.
PART = 1 << 19
#: Bytes of a batch of texts.
BATCH_BYTES = 4 << 20
#: Bytes of segments that are sorted together.
SORT_BYTES = 1 << 19
#: Bytes of the different segments of one key that are sorted together; more are cut finer.
GROUP_BYTES = 1 << 20
#: Neighbouring distances from the anchor whose windows stay together at each finer cut.
FINER = (20, 1)
SEPARATOR = b"\xff"

_rng = np.random.default_rng(4)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = int(_rng.integers(0, 1 << 64, dtype=np.uint64)) | 5
_INVERSE = pow(_STEP, -1, 1 << 64)
_LOW = np.uint64((1 << 24) - 1)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < count:
        factors = np.full(max(count, 1 << 16), base, np.uint64)
        factors[0] = 1
        _tables[base] = np.multiply.accumulate(factors)
    return _tables[base][:count]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of each substring of ``size`` bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=sums[1:])
    found = (sums[size:] - sums[:-size]) * _powers(_INVERSE, len(data) - size + 1)
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbouring values."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, first and last window start) of every anchor in the texts."""
    parts: list[tuple[int, int, bytes]] = []
    found: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        hashes = gram_hashes(data, GRAM)
        ranked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min(ranked, WINDOW - GRAM + 1) & _LOW
        ends = np.cumsum([len(p) for _, _, p in parts])
        begins = ends - [len(p) for _, _, p in parts]
        counts = ends - begins - WINDOW + 1
        at = np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
        anchor = least[at]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        part = np.searchsorted(ends, at[first], side="right")
        shift = np.array([o for _, o, _ in parts])[part] - begins[part]
        owner = np.array([t for t, _, _ in parts])[part]
        found.append((owner, hashes[anchor[first].astype(np.int64)], at[first] + shift, at[last] + shift))
        parts.clear()

    for number, text in enumerate(texts):
        for low in range(0, len(text) - WINDOW + 1, PART):
            parts.append((number, low, text[low : low + PART + WINDOW - 1]))
            size += len(parts[-1][2])
            if size >= PART:
                flush()
                size = 0
    if parts:
        flush()
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(text: bytes, first: np.ndarray, count: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The window starts of the segments in the order of their first ``depth`` bytes.

    Segment s has ``count[s]`` starts from ``first[s]``; every segment ends before a separator,
    which is greater than any byte of a text.
    """
    data = np.frombuffer(text, np.uint8)
    differs = np.flatnonzero(data[1:] != data[:-1])
    reach = np.searchsorted(differs, np.arange(len(data) - 1))
    rising = np.zeros(len(data), bool)
    inside = reach < len(differs)
    turn = differs[reach[inside]]
    rising[:-1][inside] = data[turn + 1] > data[turn]
    # A segment's active suffixes go on to the first rising one at or after its last start.
    rises = np.flatnonzero(rising)
    stop = rises[np.searchsorted(rises, first + count - 1)] + 1
    edge = np.zeros(len(data) + 1, np.int8)
    edge[first] += 1
    edge[stop] -= 1
    active = np.cumsum(edge[:-1], dtype=np.int8) > 0
    direct = np.flatnonzero(active & rising).tolist()
    direct.sort(key=lambda p: text[p : p + depth])
    direct = np.array(direct, np.int64)
    induced = active & ~rising

    bounds = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for byte in range(256):
        bucket = waiting[byte]
        wave = np.concatenate(bucket) if bucket else direct[:0]
        while len(wave):  # a run of the same byte: one byte longer, and so greater, each time
            before = wave - 1
            wave = before[induced[before] & (data[before] == byte) & (before >= 0)]
            bucket.append(wave)
        bucket.append(direct[bounds[byte] : bounds[byte + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        order.append(full)
        before = full - 1
        before = before[(before >= 0) & induced[before] & (data[before] > byte)]
        heads = data[before]
        turn = np.argsort(heads, kind="stable")
        before, heads = before[turn], heads[turn].astype(np.int64)
        for head in heads[np.flatnonzero(np.diff(heads, prepend=-1))]:
            low, high = np.searchsorted(heads, [head, head + 1] if head < 255 else [head, 256])
            waiting[head].append(before[low:high])
    starts = np.zeros(len(data) + 1, np.int8)
    np.add.at(starts, first, 1)
    np.add.at(starts, first + count, -1)
    eligible = np.cumsum(starts[:-1], dtype=np.int8) > 0
    found = np.concatenate(order) if order else direct
    return found[eligible[found]]


def common_prefixes(text: bytes, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Common prefix of each suffix with the next in order, in whole words of 8 bytes, up to ``depth``."""
    padded = text + bytes(depth + 8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    found = np.zeros(max(0, len(order) - 1), np.int64)
    pair = np.arange(len(found))
    for at in range(0, depth, 8):
        pair = pair[words[order[pair] + at] == words[order[pair + 1] + at]]
        found[pair] = at + 8
        if not len(pair):
            break
    return found


def repeated(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment the flags of its windows: whether the window also stands elsewhere in the segments."""
    sizes = np.array([len(s) for s in segments])
    first = np.cumsum(sizes + 1) - sizes - 1
    count = sizes - WINDOW + 1
    text = SEPARATOR.join([*segments, b""])
    order = suffix_order(text, first, count)
    same = np.flatnonzero(common_prefixes(text, order) >= WINDOW)
    flags = np.zeros(len(text), bool)
    flags[order[same]] = True
    flags[order[same + 1]] = True
    return [flags[f : f + c] for f, c in zip(first, count)]


def spans(flags: np.ndarray, low: int) -> list[tuple[int, int]]:
    """Byte ranges that the flagged windows of a segment cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(low + a, low + b - 1 + WINDOW) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, hashes, low, high = anchors(batch.column(2).to_pylist())
        owner = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
            ["anchor", "_id", "_key", "low", "high"],
        )


UNIT = "key long, sha binary, _key binary, low int, segment binary, done boolean"
_UNIT = (["key", "sha", "_key", "low", "segment", "done"], [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.bool_()])


def _units(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_UNIT[0])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _UNIT[1])], _UNIT[0])


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, marks of anchor, low, high) to the segments."""
    for batch in batches:
        rows, size = [], 0
        for key, text, marks in zip(*batch.columns):
            key, text = key.as_py(), text.as_py()
            marks = marks.values
            for anchor, low, high in zip(*(marks.field(n).to_pylist() for n in range(3))):
                segment = text[low : high + WINDOW]
                rows.append((anchor, _digest(segment), key, low, segment, False))
                size += len(segment)
                if size > SORT_BYTES:
                    yield _units(rows)
                    rows, size = [], 0
        yield _units(rows)


def _key_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _finer(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Units to smaller ones, of the windows of ``width`` neighbouring distances from their anchor.

    The anchor of a unit is the leftmost least hash of its 40-byte substrings. All windows of such
    a smaller unit hold the bytes that its first and last have in common, and are keyed by them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, low, segment, done in zip(*(c.to_pylist() for c in batch.columns)):
                grams = gram_hashes(np.frombuffer(segment, np.uint8), GRAM)
                anchor, last = int(np.argmin(grams & ~_LOW)), len(segment) - WINDOW
                first = 0
                while first <= last:
                    place = (anchor - first) // width
                    end = min(last, anchor - place * width)
                    begin = anchor - place * width - width + 1  # where the class's first window would start
                    core = segment[begin + width - 1 : begin + WINDOW]
                    part = segment[first : end + WINDOW]
                    rows.append((_key_of(place.to_bytes(2, "little") + core), _digest(part), key, low + first, part, done))
                    size += len(part)
                    first = end + 1
                if size > SORT_BYTES:
                    yield _units(rows)
                    rows, size = [], 0
            yield _units(rows)

    return run


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different segments, sorted by their key, to the byte ranges of repeated windows; those done already give none.

    As many whole keys as fit are sorted together.
    """
    rows: list[tuple] = []
    size = 0

    def out(part: list[tuple]) -> pa.RecordBatch:
        flags = repeated([r[3] for r in part])
        found = [(k, a, b) for (_, k, low, _, done), f in zip(part, flags) if not done for a, b in spans(f, low)]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["_key", "a", "b"])

    last = 0  # where the rows of the last key begin
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != rows[-1][0]:
                last = len(rows)
            rows.append(row)
            size += len(row[3])
            if size >= SORT_BYTES and last:
                yield out(rows[:last])
                rows, last = rows[last:], 0
                size = sum(len(r[3]) for r in rows)
    if rows:
        yield out(rows)


def _repeats(units: DataFrame, folder: str, widths: tuple[int, ...] = FINER) -> DataFrame:
    """(_key, a, b): the byte ranges of windows that stand in units of one key more than once.

    Equal units are counted before any shuffle of more than one of them; where a unit occurs twice
    all its members repeat. The others are sorted by key, or cut finer where a key has too many.
    """
    spark = units.sparkSession
    units = written(units, f"{folder}/units-{len(widths)}")
    own = F.struct("_key", "low")
    distinct = units.groupBy("key", "sha").agg(
        F.min(own).alias("own"), F.min("segment").alias("segment"), F.count(F.lit(1)).alias("n"), F.max("done").alias("done")
    )
    distinct = written(distinct, f"{folder}/distinct-{len(widths)}")
    twice = distinct.where("n > 1").select("key", "sha")
    members = units.where("not done").select("key", "sha", "_key", "low", F.octet_length("segment").alias("size"))
    found = members.join(twice, ["key", "sha"]).select("_key", F.col("low").alias("a"), (F.col("low") + F.col("size")).alias("b"))
    keys = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("segment")).alias("size"), F.min(F.col("done") | (F.col("n") > 1)).alias("all"))
    keys = checkpoint(keys.where("c > 1 and not all").select("key", (F.col("size") > GROUP_BYTES).alias("large")))
    several = distinct.join(keys, "key").select("key", "own.*", "segment", (F.col("done") | (F.col("n") > 1)).alias("done"), "large")
    small = several.where("not large") if widths else several
    small = small.select("key", "_key", "low", "segment", "done").repartition("key").sortWithinPartitions("key")
    found = found.union(small.mapInArrow(_sort, "_key binary, a int, b int"))
    if widths and not keys.where("large").isEmpty():
        large = several.where("large").select("_key", "low", "segment", "done").mapInArrow(_finer(widths[0]), UNIT)
        found = found.union(_repeats(large, folder, widths[1:]))
    return found


def _whole_characters(text: bytes, ranges: list[list[int]]) -> bytes:
    """A text without the characters that lie wholly in the ranges."""
    kept, at = [], 0
    for a, b in ranges:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, ranges) to what is left of the text and what has gone."""
    for batch in batches:
        rows = []
        for key, text, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            kept, at, removed, runs = [], 0, 0, 0
            merged: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in ranges):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                kept.append(text[at:a])
                at, removed, runs = b, removed + b - a, runs + 1
            kept = b"".join([*kept, text[at:]])
            rows.append((key, removed, runs, hashlib.sha256(kept).hexdigest(), _whole_characters(text, merged)))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _identity(text: Column) -> Column:
    """128 bits of a text's SHA-256: what tells texts apart."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _removals(docs: DataFrame, ident: str, text: str, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """(_id, _key, n_bytes, sha, copies) of every row, and (_key, n_removed, ...) of the single texts that lose bytes."""
    spark = docs.sparkSession
    prepare(spark, BATCH_BYTES)
    rows = docs.select(F.coalesce(F.col(ident).cast("long"), F.lit(LONG_MIN)).alias("_id"), text_bytes(text).alias("_text"))
    light = rows.select("_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("sha"))
    light = checkpoint(light.withColumn("_key", F.unhex(F.substring("sha", 1, 32))))
    copies = light.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"))
    long = rows.where(F.octet_length("_text") >= WINDOW).withColumn("_key", _identity(F.col("_text")))

    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    marks = long.select("_id", "_key", "_text").mapInArrow(_anchor_rows, "anchor long, _id long, _key binary, low int, high int")
    marks = written(marks, f"{folder}/marks")
    place = F.shiftright(F.xxhash64("_key", "low"), 16)
    shared = marks.groupBy("anchor").agg(F.min(place).alias("p"), F.max(place).alias("q"))
    shared = shared.where(F.col("p") != F.col("q")).select("anchor")
    found = marks.join(shared, "anchor").groupBy("_key", "low", "high", "anchor").agg(F.min("_id").alias("_id"))
    per_text = checkpoint(found.groupBy("_id", "_key").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("marks")))

    may_share = key_filter(per_text.select(F.xxhash64("_key").alias("code")), "code")
    segments = long.where(may_share(F.xxhash64("_key"))).join(per_text, ["_id", "_key"]).select("_key", "_text", "marks")
    ranges = _repeats(segments.mapInArrow(_cut, UNIT), folder)
    single = copies.where("copies = 1").select("_key")
    ranges = ranges.groupBy("_key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    ranges = checkpoint(ranges.join(single, "_key"))
    remove(spark, folder)
    may_lose = key_filter(ranges.select(F.xxhash64("_key").alias("code")), "code")
    lost = long.where(may_lose(F.xxhash64("_key"))).join(ranges, "_key").select("_key", "_text", "ranges")
    lost = lost.mapInArrow(_remove, "_key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return light.join(copies, "_key"), lost if keep_text else lost.drop("kept")


def removal_digest(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(``ident``, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a 200-byte string that covers it starts anywhere else too, in the same row or
    another; strings never cross rows and are judged on the input. Null counts as empty; equal
    texts of 200 bytes and more go entirely; repeated rows are equal texts; an empty table gives
    no rows. Other columns are not read.
    """
    light, lost = _removals(docs, ident, text, keep_text=False)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    found = light.join(lost, "_key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.when(F.col("_id") > LONG_MIN, F.col("_id")).cast(docs.schema[ident].dataType).alias(ident),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with the bytes that ``removal_digest`` counts gone from ``text``.

    A character that is only covered in part stays whole. A null text stays null; a text that
    repeats from end to end becomes empty; rows keep their number.
    """
    light, lost = _removals(docs, ident, text, keep_text=True)
    copied = light.where((F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)).select("_key", F.lit(True).alias("_all")).distinct()
    lost = lost.select("_key", F.decode("kept", "utf-8").alias("_kept"))
    changed = checkpoint(lost.unionByName(copied.select("_key", F.lit("").alias("_kept"))))
    may_change = key_filter(changed.select(F.xxhash64("_key").alias("code")), "code")
    rows = docs.select(_identity(text_bytes(text)).alias("_key"), F.struct("*").alias("_row"))
    rows = rows.withColumn("_may", may_change(F.xxhash64("_key")))
    found = rows.where("_may").join(changed, "_key", "left")
    old = F.col("_row")[text]
    new = F.when(old.isNull(), old).otherwise(F.coalesce("_kept", old))
    found = found.select(F.col("_row").withField(text, new).alias("_row"))
    return found.unionByName(rows.where(~F.col("_may")).select("_row")).select("_row.*")
