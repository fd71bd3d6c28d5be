import numpy as np
import pytest
from helpers import awkward

from loomline.llm import near_texts
from loomline.llm.near_texts import alike, long_fingerprints, samples, shingle_hashes, shingle_set, verified_components


def brute(rows):
    """Components of all pairs of texts that share 0.8 of their five-word shingles."""
    found = [(i, shingle_set((t or "").encode(), 5)) for i, t in rows]
    root = {i: i for i, _ in found}
    for n, (i, x) in enumerate(found):
        for j, y in found[n + 1 :]:
            if root[i] != root[j] and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def got(docs):
    return {r["doc_id"]: r["component_id"] for r in verified_components(docs).collect()}


def near(texts):
    sets = {i: shingle_set(t.encode(), 5) for i, t in texts.items()}
    by_shingle = {}
    for i, x in sets.items():
        for s in x:
            by_shingle.setdefault(s, []).append(i)
    met = {(i, j) for ids in by_shingle.values() if len(ids) < 60 for n, i in enumerate(ids) for j in ids[n + 1 :]}
    return [(i, j) for i, j in met if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found, pairs = got(docs), near(texts)
    assert set(found) == set(texts) and all(found[c] == c for c in found.values())
    unequal = [(i, j) for i, j in pairs if texts[i] != texts[j]]
    assert len(unequal) >= 5
    assert sum(found[i] == found[j] for i, j in unequal) >= 0.95 * len(unequal)
    linked = {x for pair in pairs for x in pair}
    assert all(found[i] == i for i in texts if i not in linked)
    assert got(docs.limit(0)) == {}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = verified_components(docs).collect()
    assert len(rows) == docs.count()
    same = {r["doc_id"]: r["component_id"] for r in rows}
    assert same[4] == same[5] == same[6] == 4 and same[2] == same[1] == 1 and same[9] == 9
    assert same[8] is None and same[None] is None  # the text of null id is near that of 8


def crowded(copies=60):
    """Texts of one template: near by fingerprint, of all degrees of likeness by text."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    base = [words[i % 40] for i in range(200)]
    rows = []
    for k in range(copies):
        w = [*base, *(f"own{k // 2}x{i}" for i in range(6 + k // 2))]
        for at in rng.integers(0, 200, k % 2):
            w[at] = f"edit{k}"
        rows.append((k, " ".join(w)))
    return [rows[i] for i in rng.permutation(copies)]


@pytest.mark.parametrize("file_rows", [2048, 8])
def test_every_candidate_that_may_join_is_compared(spark, monkeypatch, file_rows):
    from loomline.llm import simhash

    monkeypatch.setattr(simhash.parted, "__defaults__", (file_rows,))
    monkeypatch.setattr(near_texts, "SET_ROWS", file_rows)
    rows = crowded()
    want = brute(rows)
    assert len(set(want.values())) > 1 and any(i != r for i, r in want.items())
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_many_near_copies_of_one_text(spark):
    rng = np.random.default_rng(4)
    word = [f"word{i}" for i in range(3000)]
    base = list(rng.choice(word, 400))
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        w = list(base)
        for at in rng.integers(0, 400, 1 + k % 7):
            w[at] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(rng.choice(word, 400))) for k in range(300)]
    want = brute(rows)
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(found[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(found[i] == i for i in want if i >= 1000)


def test_equal_fingerprints_are_no_proof(spark):
    ones = " ".join(f"the same beginning number {i}" for i in range(60))
    texts = [ones + " " + " ".join(f"{name}{i}" for i in range(60)) for name in ("tree", "ship", "coal")]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[1]), (5, texts[2] + " more"), (6, texts[0])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == {1: 1, 2: 2, 3: 3, 4: 2, 5: 3, 6: 1}


def test_hashed_shingles_tell_likeness():
    rng = np.random.default_rng(8)
    word = [b"w%d" % i for i in range(50)]
    texts = [b"", b"a", b"a b", b"A  b\n", *(b" ".join(rng.choice(word, n)) for n in rng.integers(1, 60, 40))]
    texts += [t + b" end" for t in texts]
    sets, hashes = [shingle_set(t, 5) for t in texts], shingle_hashes(texts, 5)
    for x, p in zip(sets, hashes):
        assert len(x) == len(p)
        for y, q in zip(sets, hashes):
            assert alike(p, q, 0.8) == (len(x & y) >= 0.8 * len(x | y))


def test_fingerprints_are_of_sets_and_of_whole_texts():
    a, b = "one two three four one two three four five".encode(), "One  two\nthree four five one two".encode()
    x, y, z = long_fingerprints([b"", a, a + b" " + a])
    assert not x.any() and y.any()
    assert not (long_fingerprints([b"x y"]) == long_fingerprints([b"x z"])).all()
    same = long_fingerprints([b"alone", b"ALONE", b" alone\n"])
    assert (same == same[0]).all() and same[0].any() and b
    long = ("alpha beta gamma delta " * 30000).encode()
    assert (long_fingerprints([long]) == long_fingerprints([b"alpha beta gamma delta alpha"])).all()


def test_more_texts_take_longer_samples():
    assert samples(0) == samples(1000) and samples(1000)[0] == 10
    for n in (1 << 20, 1 << 33):
        bits, count = samples(n)
        assert bits >= np.log2(n) - 8 and 1 - (1 - 0.85**bits) ** count >= 0.97
