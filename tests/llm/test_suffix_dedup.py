import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward

from loomline.llm import suffix_dedup
from loomline.llm.suffix_dedup import WINDOW, anchors, removal_digest, repeated, suffix_order


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + WINDOW] for _, t in texts for p in range(len(t) - WINDOW + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - WINDOW + 1):
            if seen[t[p : p + WINDOW]] > 1:
                gone[p : p + WINDOW] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = np.random.default_rng(7)
    word = ["".join(rng.choice(list("abcdefghé"), rng.integers(1, 9))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(word, n))
    shared, other = say(60), say(80)
    rows = [say(150) + shared + say(100) for _ in range(6)]
    rows += [other + say(40), say(30) + other, shared, shared[:150], say(90) + other + say(10) + other]
    rows += ["a" * 450, "b" * 199, "c" * 200, "ab" * 180, say(40) + "a" * 230]
    return [(500 + i, t, "en", "s", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("group", "finer"), [(2 << 20, (20, 1)), (300, (20, 1)), (300, (1,)), (1, (20,)), (1, (20, 1))])
def test_same_as_brute_force(spark, monkeypatch, group, finer):
    """Whatever is sorted together, and however what is too much is cut."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup._repeats, "__defaults__", (finer,))
    docs = awkward(spark, passages())
    got = sorted((tuple(r) for r in removal_digest(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert removal_digest(docs.limit(0)).collect() == []


def test_a_passage_in_twenty_thousand_rows(spark):
    """Its segments meet once: what is sorted does not grow with the copies, and borders differ."""
    rng = np.random.default_rng(11)
    passage, short = ("".join(rng.choice(list("abcdefgh "), n)) for n in (260, 190))
    rows = [(i, f"{i * 7919 % 100003:060d}{passage}{i:060d}") for i in range(20_000)]
    rows += [(30_000 + i, f"{i:030d}{short}{i * 31:030d}") for i in range(2_000)]
    got = removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert all(r["n_removed"] >= 260 for r in got if r["doc_id"] < 20_000)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in removal_digest(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[2] for r in got) > 0


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(8)
    for letters in (2, 5, 200):
        segments = [bytes(rng.integers(1, 1 + letters, rng.integers(WINDOW, 400), dtype=np.uint8)) for _ in range(20)]
        segments += [b"a" * 300, b"ab" * 150, segments[0]]
        text = b"\xff".join([*segments, b""])
        sizes = np.array([len(s) for s in segments])
        first = np.cumsum(sizes + 1) - sizes - 1
        order = suffix_order(text, first, sizes - WINDOW + 1)
        keys = [text[p : p + WINDOW] for p in order]
        assert keys == sorted(keys)
        assert sorted(order.tolist()) == sorted(p for f, n in zip(first, sizes) for p in range(f, f + n - WINDOW + 1))
        flags = repeated(segments)
        seen = Counter(s[p : p + WINDOW] for s in segments for p in range(len(s) - WINDOW + 1))
        assert all(f.tolist() == [seen[s[p : p + WINDOW]] > 1 for p in range(len(f))] for s, f in zip(segments, flags))


def test_every_window_has_one_anchor(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 120, n, dtype=np.uint8)) for n in (0, 199, 200, 201, 3000)] + [b"x" * 1000]
    for part in (1 << 19, 300):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        owner, _, low, high = anchors(texts)
        for t, text in enumerate(texts):
            covered = sorted(p for a, b in zip(low[owner == t], high[owner == t]) for p in range(a, b + 1))
            assert covered == list(range(len(text) - WINDOW + 1))
