import hashlib

import numpy as np
import xxhash
from helpers import awkward

from loomline.llm import lz_fingerprint as lz
from loomline.llm.lz_fingerprint import Parse, fingerprint, likeness, phrase_hashes, signature
from loomline.llm.ordered import dealing_keys, joined, range_number, splits_of


def phrases(data):
    """Plain LZ78 over byte strings."""
    seen, found, start = set(), [], 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            found.append(data[start:end])
            start = end
    return [*found, *([data[start:]] if start < len(data) else [])]


WORD = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & WORD
    return x ^ x >> 32


def sign(data):
    """The fingerprint from the plain phrases, in whole numbers."""
    byte, step = [int(x) for x in lz._BYTE], lz._STEP
    hashes = set()
    for p in phrases(data):
        hashes.add(mixed(sum(byte[c] * pow(step, i, 1 << 64) for i, c in enumerate(p)) + len(p) & WORD))
    if not hashes:
        return b""
    least = [min(((h >> 32) * int(a) + int(b)) % (1 << 32) for h in hashes) for (a,), (b,) in zip(lz._A, lz._B)]
    return bytes(((x ^ x >> 16) * 0x9E3779B1) % (1 << 32) >> 24 for x in least)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 * 256 - 1) / 255)


def brute(rows, sign=sign):
    hashed = lambda t: (int(xxhash.xxh64(t.encode(), 42).intdigest()) + (1 << 63)) % (1 << 64)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])))
    out = []
    for i, (ident, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        take = len(text) // 2
        edited = (text[: len(text) - take] + after[:take]).encode()
        a, b, c = sign(text.encode()), sign(edited), sign(after.encode())
        out.append((ident, len(text), hashlib.sha256(edited).hexdigest(), a.hex(), b.hex(), alike(a, b), alike(a, c)))
    return sorted(out, key=str)


def test_same_as_brute_force_in_any_ranges(spark):
    docs = awkward(spark)
    want = brute([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    for size in (1 << 20, 40, 700):
        got = sorted((tuple(r) for r in fingerprint(docs, range_bytes=size).collect()), key=str)
        assert got == want
    assert fingerprint(docs.limit(0)).collect() == []
    alone = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert [r["edited_sha256"] for r in fingerprint(alone).collect()] == [hashlib.sha256(b"abcabc").hexdigest()]


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    quick = lambda b: signature(phrase_hashes(b, Parse().feed(b, 0).ends))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], quick)
    got = sorted((tuple(r) for r in fingerprint(docs, range_bytes=50_000).collect()), key=str)
    assert got == want
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got])


def test_likeness_estimates_phrase_overlap():
    rng = np.random.default_rng(4)
    word = [bytes(rng.integers(97, 110, 5, dtype=np.uint8)) for _ in range(400)]
    for share in (0.0, 0.5, 0.9):
        a = b" ".join(word[i] for i in rng.integers(0, 400, 1500))
        b = a[: int(len(a) * share)] + b" ".join(word[i] for i in rng.integers(0, 400, 1500))
        x, y = set(phrases(a)), set(phrases(b))
        fx, fy = (signature(phrase_hashes(t, Parse().feed(t, 0).ends)) for t in (a, b))
        assert len(set(phrase_hashes(a, Parse().feed(a, 0).ends).tolist())) == len(x)
        assert abs(likeness(fx, fy) - len(x & y) / len(x | y)) < 0.15


def test_null_and_equal_ids_are_dealt_over_ranges(spark):
    rows = [(None, f"some text {i} {i * i}") for i in range(300)] + [(9, f"other {i} text {i * 7}") for i in range(300)] + [(9, "the same")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint(docs, range_bytes=2000)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sum(n > 0 for n in sizes) >= 6 and max(sizes) < 200


def test_ranges_of_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 6, 500), rng.integers(-9, 9, 500))] + [(-(1 << 63), i) for i in range(400)]
    table = spark.createDataFrame(rows, "a long, b long")
    splits = splits_of(table, "a", "b", 40)
    got = table.withColumn("r", range_number(splits)("a", "b")).collect()
    assert all(x["r"] == sum(s <= (x["a"], x["b"]) for s in splits) for x in got)
    assert len({x["r"] for x in got if x["a"] == -(1 << 63)}) > 5
    assert joined(splits, dict.fromkeys(range(len(splits) + 1), 1), 3) == splits[2::3]
    keys = dealing_keys(spark, 12)
    placed = spark.createDataFrame([(k,) for k in keys], "k int").repartition(12, "k").rdd.glom().collect()
    assert [[r["k"] for r in p] for p in placed] == [[k] for k in keys]
