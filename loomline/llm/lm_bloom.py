"""Language model scores from a log-frequency Bloom filter.

An n-gram of count c is in the filter once for each quantised level up to that of c, so its level
is read back by probing level after level until one is absent. The filter is cut into slices by
the leading bits of the n-gram's hash: the task that counts a slice's n-grams also sizes and fills
its bits, so the filter grows with the distinct n-grams. Below a bound the whole filter is
broadcast to the scoring tasks; beyond it the n-grams of the texts are sent to the slices.

Exact token counts, which the base score needs, are broadcast only for tokens of a count that
keeps their table within a bound; the occurrences of rarer tokens are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold, prepare
from .tokens import distinct, mixed, slices, word_hashes

#: Slices of the filter and of the counts.
SLICE_BITS = 10
SLICES = 1 << SLICE_BITS
#: Bounds of what is broadcast: bits of the filter, and tokens of known exact count.
MAX_FILTER_BITS = 1 << 25
MAX_TOKENS = 1 << 21
#: Bits of a slice for each level of each of its n-grams, and the least; probes that suit them.
BITS_PER_LEVEL = 12
MIN_SLICE_BITS = 512
PROBES = 8
#: The filter tells keys apart by this many bits below the slice's, which are what is sent to a slice.
SENT_BITS = 32
#: Levels grow by this factor.
BASE = 1.5
#: Pseudo-count of the token distribution in the bigram's.
PRIOR = 50.0
#: Bytes of text that are scored at a time.
SCORE_BYTES = 2 << 20
ALPHA = 0.1
LEAST_COUNTS = (1, 2, 3, 4, 6, 8, 12, 16, 32, 64, 256, 1024, 4096, 1 << 16, 1 << 20, 1 << 30)

END, START = (mixed(np.array([x], np.uint64))[0] for x in (0xE0D, 0x57A))
_UNIGRAM, _BIGRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def level_floors() -> np.ndarray:
    """The least count of each level: 1, then the next integer beyond the last by the factor."""
    floors = [1]
    while floors[-1] < 1 << 40:
        floors.append(max(floors[-1] + 1, int(floors[-1] * BASE)))
    return np.array(floors, np.int64)


FLOORS = level_floors()
#: The count that a level stands for, by level from 0: the middle of those it covers.
MIDDLES = np.concatenate([[0.0], (FLOORS[:-1] + FLOORS[1:] - 1) / 2, [float(FLOORS[-1])]])


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(FLOORS, counts, side="right")


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts, each closed by END, and the number of tokens of each text."""
    words, counts = word_hashes(texts)
    sizes = counts + 1
    tokens = np.full(len(words) + len(texts), END, np.uint64)
    place = np.ones(len(tokens), bool)
    place[np.cumsum(sizes) - 1] = False
    tokens[place] = words
    return tokens, sizes


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens * _UNIGRAM)


def bigram_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * _BIGRAM + tokens)


_HALF, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)


def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    """What the probes of keys at a level are made of."""
    return mixed(keys + np.uint64(level * int(_UNIGRAM) % (1 << 64)))


def probe_bits(hashes: np.ndarray, probe: int, slice_bits: int | np.ndarray) -> np.ndarray:
    """Bit numbers, within the slice of each key, of one probe: double hashing, scaled to the slice's size."""
    at = (hashes >> _HALF) + np.uint64(probe) * (hashes & _LOW | np.uint64(1)) & _LOW
    return (at * np.asarray(slice_bits, np.uint64) >> _HALF).astype(np.int64)


def slice_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLICE_BITS)).astype(np.int64)


def sent(keys: np.ndarray) -> np.ndarray:
    """What tells keys apart within their slice."""
    return (keys >> np.uint64(64 - SLICE_BITS - SENT_BITS)).astype(np.uint32)


def codes(keys: np.ndarray) -> np.ndarray:
    """Slice and ``sent`` of keys as one number."""
    return keys >> np.uint64(64 - SLICE_BITS - SENT_BITS)


def fill(keys: np.ndarray, counts: np.ndarray, slice_bits: int, probes: int) -> bytes:
    """A slice's bits with every key, as sent, at every level up to its own."""
    bits = np.zeros(slice_bits, bool)
    top, keys = levels(counts), keys.astype(np.uint64)
    for level in range(1, int(top.max(initial=0)) + 1):
        keys = keys[top >= level]
        top = top[top >= level]
        hashes = hashed(keys, level)
        for probe in range(probes):
            bits[probe_bits(hashes, probe, slice_bits)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def slice_size(counts: np.ndarray, bits_per_level: int = BITS_PER_LEVEL) -> int:
    """Bits of a slice that has n-grams of these counts."""
    return max(MIN_SLICE_BITS, (bits_per_level * int(levels(counts).sum()) + 7) // 8 * 8)


def probed(keys: np.ndarray, bits: np.ndarray, starts: np.ndarray | int, sizes: np.ndarray | int, probes: int) -> np.ndarray:
    """The level of each key as sent, found by probing upwards in its slice of ``bits``, of that start and size."""
    found, keys = np.zeros(len(keys), np.int64), keys.astype(np.uint64)
    starts, sizes = np.broadcast_to(starts, len(keys)), np.broadcast_to(sizes, len(keys))
    at = np.arange(len(keys))
    for level in range(1, len(FLOORS) + 1):
        if not len(at):
            break
        hashes = hashed(keys[at], level)
        for probe in range(probes):
            bit = starts[at] + probe_bits(hashes, probe, sizes[at])
            held = bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0
            at, hashes = at[held], hashes[held]
        found[at] = level
    return found


@dataclass
class Filter:
    """The broadcast model: filter bits, and exact counts of tokens of at least ``least``.

    ``slice_bits`` is a size for all slices, or one for each. Without ``bits`` the filter is too
    large to broadcast, and levels are looked up in its slices.
    """

    slice_bits: int | np.ndarray
    probes: int
    bits: np.ndarray | None
    tokens: np.ndarray
    counts: np.ndarray
    least: int
    total: int
    distinct: int
    starts: int

    def level(self, found: np.ndarray) -> np.ndarray:
        """The level of each code, found by probing upwards."""
        sizes, at = np.broadcast_to(self.slice_bits, SLICES), (found >> np.uint64(SENT_BITS)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        return probed(found & _LOW, self.bits, starts[at], sizes[at], self.probes)

    def exact(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of sorted tokens; -1 for one that is rarer than the table goes."""
        if not len(self.tokens):
            return np.full(len(tokens), 0 if self.least == 1 else -1, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0 if self.least == 1 else -1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of tokens of these counts."""
        return np.log10((counts + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))

    def model(self, tokens: np.ndarray, at: np.ndarray, sizes: np.ndarray, level: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 probability of each token after its history: ``tokens[at]`` is the stream.

        The bigram's count and its history's, as the filter tells them, are smoothed towards the
        token's own share with ``PRIOR`` pseudo-counts; a bigram counts as no more than its history.
        """
        share = MIDDLES[level(codes(unigram_keys(tokens)))]
        seen = tokens[at]
        before = histories(seen, sizes)
        above = np.empty(len(at))
        above[1:] = share[at][:-1]
        above[np.cumsum(sizes) - sizes] = self.starts
        pairs, back = np.unique(codes(bigram_keys(before, seen)), return_inverse=True)
        both = np.minimum(MIDDLES[level(pairs)][back], above)
        lower = (share[at] + ALPHA) / (self.total + ALPHA * (self.distinct + 1))
        return np.log10((both + PRIOR * lower) / (above + PRIOR))


def _packed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(keys, return_counts=True)
    return found, counts


def count_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts to (slice, kind, keys, counts): distinct n-grams as packed numbers.

    Kind 0 has tokens as they are, kind 1 what tells bigrams apart in their slice. A slice of tokens
    goes by the leading bits of its unigram keys. Counts above one follow only for the keys that have them.
    """
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if not texts:
            continue
        tokens, sizes = stream(texts)
        pairs = codes(bigram_keys(histories(tokens, sizes), tokens))
        columns: tuple[list, ...] = ([], [], [], [])
        for kind, grams in enumerate((tokens, pairs)):
            found, counts = _packed(grams)
            where = slice_of(unigram_keys(found)) if kind == 0 else (found >> np.uint64(SENT_BITS)).astype(np.int64)
            if kind == 0:
                order = np.argsort(where, kind="stable")
                found, counts, where = found[order], counts[order], where[order]
            else:
                found = found.astype(np.uint32)
            several = counts > 1
            ends = np.searchsorted(where, np.arange(SLICES + 1))
            for s in range(SLICES):
                part = slice(ends[s], ends[s + 1])
                if ends[s] < ends[s + 1]:
                    more = several[part]
                    # Keys of count one first, then the others, whose counts are told.
                    columns[0].append(s)
                    columns[1].append(kind)
                    columns[2].append(found[part][~more].tobytes() + found[part][more].tobytes())
                    columns[3].append(counts[part][more].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
            ["slice", "kind", "keys", "counts"],
        )


def _merged(parts: list[tuple[bytes, bytes]], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and total counts of packed parts."""
    keys, counts = [], []
    for k, c in parts:
        k, c = np.frombuffer(k, kind), np.frombuffer(c, np.uint32)
        keys.append(k)
        counts.append(np.concatenate([np.ones(len(k) - len(c), np.int64), c.astype(np.int64)]))
    if not keys:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def build_slices(probes: int, bits_per_level: int = BITS_PER_LEVEL):
    """Rows of one slice, sorted together, to its filter bits, tokens and exact counts."""

    def one(at: int, parts: dict[int, list]) -> tuple:
        tokens, counts = _merged(parts.get(0, []), np.uint64)
        pairs, both = _merged(parts.get(1, []), np.uint32)
        grams = np.concatenate([counts, both])
        bits = fill(np.concatenate([sent(unigram_keys(tokens)), pairs]), grams, slice_size(grams, bits_per_level), probes)
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        sizes = [int((counts >= least).sum()) for least in LEAST_COUNTS]
        return at, bits, tokens.tobytes(), counts.tobytes(), len(tokens), int(counts.sum()), sizes

    names = ["slice", "bits", "tokens", "counts", "distinct", "total", "sizes"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, {}
        for batch in batches:
            for s, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if s != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one(at, parts), kinds)], names)
                    parts = {}
                at = s
                parts.setdefault(kind, []).append((keys, counts))
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one(at, parts), kinds)], names)

    return run


def learn(docs: DataFrame, text: str = "text", *, max_filter_bits: int = MAX_FILTER_BITS, max_tokens: int = MAX_TOKENS, bits_per_level: int = BITS_PER_LEVEL) -> tuple[Filter, DataFrame]:
    """The model of all texts of ``docs``, and the filter bits and exact counts as packed slices."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    starts = texts.count()
    counted = texts.mapInArrow(count_batch, "slice int, kind int, keys binary, counts binary")
    built = counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(
        build_slices(PROBES, bits_per_level),
        "slice int, bits binary, tokens binary, counts binary, distinct long, total long, sizes array<long>",
    )
    built = checkpoint(built)
    sums = [F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(len(LEAST_COUNTS))]
    totals = built.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n"), F.sum(F.octet_length("bits")).alias("b"), *sums).first()
    least = next(x for i, x in enumerate(LEAST_COUNTS) if (totals[f"s{i}"] or 0) <= max_tokens)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ([], [])
            for t, c in zip(*(x.to_pylist() for x in batch.columns)):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64)
                columns[0].append(t[c >= least].tobytes())
                columns[1].append(c[c >= least].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["tokens", "counts"])

    slice_bits, bits = np.full(SLICES, MIN_SLICE_BITS, np.int64), None
    if 8 * (totals["b"] or 0) <= max_filter_bits:
        parts = [bytes(MIN_SLICE_BITS // 8)] * SLICES
        for r in built.select("slice", "bits").collect():
            parts[r["slice"]] = bytes(r["bits"])
            slice_bits[r["slice"]] = 8 * len(r["bits"])
        bits = np.frombuffer(b"".join(parts), np.uint8)
    known = built.select("tokens", "counts").mapInArrow(frequent, "tokens binary, counts binary").collect()
    tokens = np.frombuffer(b"".join(bytes(r["tokens"]) for r in known), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in known), np.int64)
    order = np.argsort(tokens)
    model = Filter(slice_bits, PROBES, bits, tokens[order], counts[order], least, totals["n"] or 0, totals["v"] or 0, starts)
    return model, built


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed exact counts to rows."""
    for batch in batches:
        for t, c in zip(*(x.to_pylist() for x in batch.columns)):
            t = np.frombuffer(t, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.frombuffer(c, np.int64))], ["token", "c"])


def scored_slice(model: Filter, ids: pa.Array, held: pa.Array, texts: list[bytes], level: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Scores of some texts, with the tokens whose counts the model does not tell."""
    tokens, sizes = stream(texts)
    found, at = np.unique(tokens, return_inverse=True)
    counts = model.exact(found)
    firsts = np.cumsum(sizes) - sizes
    per = lambda x: np.add.reduceat(x[at], firsts)
    known = per((counts > 0).astype(np.int64))
    base = per(np.where(counts >= 0, model.base(np.maximum(counts, 0)), 0.0))
    scores = np.add.reduceat(model.model(found, at, sizes, level), firsts)
    rare: list[list[int]] = [[] for _ in texts]
    if (counts < 0).any():
        unknown = np.flatnonzero(counts[at] < 0)
        owner = np.searchsorted(firsts, unknown, side="right") - 1
        for o, t in zip(owner.tolist(), tokens[unknown].view(np.int64).tolist()):
            rare[o].append(t)
    return pa.RecordBatch.from_arrays(
        [ids, held, pa.array(sizes), pa.array(known), pa.array(base), pa.array(scores), pa.array(rare, pa.list_(pa.int64()))],
        ["_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
    )


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_id, held_out, t) to rows of lists of them, of about ``SCORE_BYTES`` of text, compressed together."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in slices(texts, SCORE_BYTES):
            ends = pa.array([0, b - a], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, c.slice(a, b - a)) for c in batch.columns[:2]]
            sizes = pa.array([[len(t) for t in texts[a:b]]], pa.list_(pa.int64()))
            data = pa.compress(b"".join(texts[a:b]), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([*lists, sizes, pa.array([data], pa.binary())], ["ids", "held", "sizes", "data"])


def texts_of(sizes: list[int], data: bytes) -> list[bytes]:
    """The texts of a chunk."""
    ends = np.cumsum(sizes).tolist()
    whole = pa.decompress(data, decompressed_size=ends[-1], codec="zstd", asbytes=True)
    return [whole[e - n : e] for n, e in zip(sizes, ends)]


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the n-grams of some texts, ascending, and their slices."""
    tokens, sizes = stream(texts)
    keys = np.concatenate([unigram_keys(distinct(tokens)), bigram_keys(histories(tokens, sizes), tokens)])
    keys = distinct(codes(keys))
    return keys, (keys >> np.uint64(SENT_BITS)).astype(np.int64)


def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, sizes, data) to (slice, chunk, data): the chunk's keys in each slice, packed."""
    for batch in batches:
        for chunk, sizes, data in zip(*(c.to_pylist() for c in batch.columns)):
            keys, where = keys_of(texts_of(sizes, data))
            ends = np.searchsorted(where, np.arange(SLICES + 1))
            some = np.flatnonzero(np.diff(ends))
            packed = keys.astype(np.uint32)
            parts = [packed[ends[s] : ends[s + 1]].tobytes() for s in some]
            columns = [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "chunk", "data"])


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slice, chunk, data) by slice, its bits first under chunk -1, to the levels of each chunk's keys as bytes."""
    at, bits = None, np.zeros(0, np.uint8)
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        low = 0
        while low < len(rows):
            s, high = rows[low][0], low
            while high < len(rows) and rows[high][0] == s:
                high += 1
            asked = rows[low:high]
            low = high
            if asked[0][1] < 0:
                at, bits = s, np.frombuffer(asked.pop(0)[2], np.uint8)
            keys = np.frombuffer(b"".join(data for _, _, data in asked), np.uint32)
            once, back = np.unique(keys, return_inverse=True)
            found = probed(once, bits, 0, 8 * len(bits), PROBES)[back] if s == at else np.zeros(len(keys), np.int64)
            ends = np.cumsum([0, *(len(data) // 4 for _, _, data in asked)]).tolist()
            told = [found[i:j].astype(np.uint8).tobytes() for i, j in zip(ends, ends[1:])]
            chunks = pa.array([chunk for _, chunk, _ in asked], pa.int64())
            yield pa.RecordBatch.from_arrays([chunks, pa.array([s] * len(asked), pa.int32()), pa.array(told, pa.binary())], ["chunk", "slice", "data"])


def scored_by_slices(rows: DataFrame, kind: str, form: str, shared, built: DataFrame) -> DataFrame:
    """Scores of rows (_id, held_out, t) where no task holds more of the filter than a slice.

    The distinct keys of a chunk of texts go to their slices, and their levels come back to the chunk.
    """
    chunks = rows.mapInArrow(chunked, f"ids array<{kind}>, held array<boolean>, sizes array<long>, data binary")
    rows.sparkSession._jvm.System.gc()  # the files of the counts' shuffle go with the plan that nothing holds now
    chunks = checkpoint(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    asked = chunks.select("chunk", "sizes", "data").mapInArrow(ask, "slice int, chunk long, data binary")
    asked = asked.union(built.select("slice", F.lit(-1).cast("long"), "bits"))
    told = asked.repartition("slice").sortWithinPartitions("slice", "chunk").mapInArrow(answer, "chunk long, slice int, data binary")
    none = F.lit(None)
    told = told.select("chunk", "slice", "data", *[none.cast(chunks.schema[c].dataType).alias(c) for c in ("ids", "held", "sizes")])
    told = told.union(chunks.select("chunk", F.lit(-1), "data", "ids", "held", "sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, found = None, []

        def scored() -> pa.RecordBatch:
            ids, held, sizes = (c.flatten() for c in chunk[:3])
            texts = texts_of(sizes.to_pylist(), chunk[3])
            keys, known = keys_of(texts)[0], np.frombuffer(b"".join(found), np.uint8)
            return scored_slice(shared.value, ids, held, texts, lambda k: known[np.searchsorted(keys, k)])

        for batch in batches:
            for i, (s, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if s >= 0:
                    found.append(data)
                    continue
                if chunk is not None:
                    yield scored()
                chunk, found = [*(batch.column(c).slice(i, 1) for c in (3, 4, 5)), data], []
        if chunk is not None:
            yield scored()

    return told.repartition("chunk").sortWithinPartitions("chunk", "slice").mapInArrow(run, form)


def score(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", folds: int = 10, held: int = 0, **bounds: int) -> DataFrame:
    """Scores of every whole text by the model of the rows that are not held out.

    Returns ``ident``, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or
    empty text is its end alone; a null id is not held out; repeated rows are learned from and
    scored each; with no training rows every count is 0; an empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = F.coalesce(fold(ident, folds) == held, F.lit(False))
    model, exact = learn(docs.where(~out), text, **bounds)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, SCORE_BYTES):
                yield scored_slice(model, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), texts[a:b], model.level)

    rows = docs.select(F.col(ident).alias("_id"), out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    form = f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    scored = rows.mapInArrow(run, form) if model.bits is not None else scored_by_slices(rows, kind, form, shared, exact)
    if model.least > 1:
        scored = checkpoint(scored.withColumn("_row", F.monotonically_increasing_id()))
        looked = scored.select("_row", F.explode("rare").alias("token")).groupBy("_row", "token").agg(F.count(F.lit(1)).alias("k"))
        counts = exact.select("tokens", "counts").mapInArrow(unpack, "token long, c long").where(F.col("c") < model.least)
        share = F.log10((F.coalesce("c", F.lit(0)) + ALPHA) / F.lit(model.total + ALPHA * (model.distinct + 1)))
        found = looked.join(counts, "token", "left").groupBy("_row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"), F.sum(share * F.col("k")).alias("_base")
        )
        scored = scored.join(found, "_row", "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("_known", F.lit(0)))
        scored = scored.withColumn("base_score", F.col("base_score") + F.coalesce("_base", F.lit(0.0)))
    return scored.select(
        F.col("_id").alias(ident), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
