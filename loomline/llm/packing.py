"""Packing of tokenised documents into fixed-length sequences by first-fit decreasing.

A document's whole sequences stand alone; what it has beyond them is one shorter piece. Documents
are dealt by row at random into groups of bounded size; within a group the longest piece first
goes to the first open sequence with room, found by descending a tournament tree of the free
capacities. A group is one small task's work, so any number of documents packs in parallel.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, prepare

SEQUENCE = 1024
GROUP_ROWS = 8192
#: Chunks whose ids a worker remembers; beyond it the memory is emptied and filled again.
MEMO = 500_000
#: How a byte-level vocabulary writes a space.
SPACE = "\u0120"
# Fixed value: how byte-level tokenizers divide a text before merging.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = b"\0\0\0\0"
#: Numbers from here on are those of sequences of one whole piece.
ALONE = 1 << 62

PIECE_SCHEMA = "_id {0}, start long, length long, ids_crc32 long, doc_tokens long"

_encoders: dict[str, ChunkEncoder] = {}


def faster(path: str) -> tiktoken.Encoding | None:
    """The same byte-level BPE in a quicker library, if its ids are in the order of its merges; else None.

    With such ids the lowest pair by merge is the lowest by id of the result, and the two agree.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    known = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if model.get("type") != "BPE" or not known or whole.get("normalizer") or model.get("ignore_merges"):
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"].get(t) for t in merged] != list(range(256, 256 + len(merged))):
        return None
    added = {t["content"] for t in whole.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, from a memory of chunk encodings.

    A text is cut before each single space that stands between two characters that are not white
    space. The tokenizer's pre-tokens never cross such a cut and each begins with that space, so
    the ids of a text are the ids of its chunks in turn.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.inner: dict[str, bytes | None] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = faster(path)

    def encode(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of each word behind a space; None where its edge is white space.

        The words are encoded as one text: as they hold no space, each begins at the next id
        that has a leading one.
        """
        safe = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        self.inner.update(dict.fromkeys(words))
        special = [w for w in safe if any(t in w for t in self.added)]
        self.inner.update(zip(special, self.encode([" " + w for w in special])))
        plain = [w for w in safe if w not in special] if special else safe
        for low in range(0, len(plain), 4096):
            part = plain[low : low + 4096]
            ids = self.joined(" " + " ".join(part))
            starts = np.flatnonzero(self.spaced[ids]) * 4
            if len(starts) != len(part):
                raise ValueError("the tokenizer joins words across a space")
            data, ends = ids.tobytes(), [*starts[1:].tolist(), 4 * len(ids)]
            self.inner.update(zip(part, map(data.__getitem__, map(slice, starts.tolist(), ends))))

    def joined(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        if self.fast is not None:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        for low in range(0, len(texts), 256):
            part = [t.split(" ") for t in texts[low : low + 256]]
            heads = self.encode([words[0] for words in part])
            if len(self.inner) > MEMO:
                self.inner.clear()
            self.learn(set().union(*(words[1:] for words in part)).difference(self.inner))
            known = self.inner.__getitem__
            for words, head in zip(part, heads):
                if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                    yield self.uneven(words)
                    continue
                try:
                    yield head + b"".join(map(known, words[1:]))
                except TypeError:
                    yield self.uneven(words)

    def uneven(self, words: list[str]) -> bytes:
        """Ids of a text with runs of white space: such runs stay inside a chunk."""
        chunks, last = [], words[0]
        for w in words[1:]:
            if last and w and not last[-1].isspace() and not w[0].isspace():
                chunks.append(last)
                last = " " + w
            else:
                last = f"{last} {w}"
        return b"".join(self.encode([*chunks, last]))


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def cut(path: str, sequence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, text) to the pieces of the documents' ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, rows = batch.column(0), []
            for at, ids in enumerate(encoder(path).batch(batch.column(1).to_pylist())):
                ids = memoryview(ids + END_ID)
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    piece = ids[4 * start : 4 * (start + sequence)]
                    rows.append((at, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(
                [idents.take(columns[0]), *columns[1:]], ["_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return pieces


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the given order: the first bin with room takes it.

    The tree's leaves are the free capacities of as many bins as there are lengths; an inner node
    holds the larger of its two children.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    placed = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        placed.append((node - leaves, capacity - tree[node]))
        tree[node] -= length
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            top = left if left > right else right
            if tree[node] == top:
                break
            tree[node] = top
    return placed


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    ident: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    group_rows: int = GROUP_ROWS,
    seed: int = 6,
) -> DataFrame:
    """One row per piece of the documents' token ids: where it comes from and where it lies.

    Returns ``ident``, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document's ids
    end with id 0; ids beyond whole sequences make one shorter piece. Null and empty texts are the
    end alone; null ids stay null; repeated rows are dealt and packed each by itself; an empty
    table gives no rows; equal pieces of a group tie by row. Other columns are not read. A group
    holds about ``group_rows`` documents, however many of them are equal: rows are dealt by their
    place in the written table of pieces, which a lost executor does not change.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    texts = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    pieces = checkpoint(texts.mapInArrow(cut(tokenizer_path, sequence), PIECE_SCHEMA.format(kind)))
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    whole = pieces.where(F.col("length") == sequence)
    rest = pieces.where(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group_rows))

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("_row", "ascending")])
        placed = first_fit(group["length"].to_pylist(), sequence)
        base = group["_group"][0].as_py() << 32
        ids, offsets = pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())
        return group.drop_columns(["_row", "_group"]).append_column("sequence_id", ids).append_column("offset", offsets)

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(fit, PIECE_SCHEMA.format(kind) + ", sequence_id long, offset long")
    alone = whole.withColumn("sequence_id", F.col("_row") + F.lit(ALONE)).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    return packed.unionByName(alone).withColumnRenamed("_id", ident)
