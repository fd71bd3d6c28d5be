import re

import numpy as np
import xxhash
from helpers import awkward

from loomline.llm.simhash import fingerprint, near_components, near_pairs


def slow_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    ids = [(i, slow_fingerprint(t)) for i, t in rows]
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(ids):
            for j, (_, b) in enumerate(ids):
                if (a ^ b).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    out = []
    for i, (d, f) in enumerate(ids):
        out.append((d, f"{f:016x}", min((x for k, (x, _) in enumerate(ids) if root[k] == root[i] and x is not None), default=None)))
    return sorted(out, key=str)


def variants():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    base = [list(rng.choice(vocabulary, 200)) for _ in range(12)]
    out = []
    for k, words in enumerate(base):
        for edits in range(5):
            w = list(words)
            for at in rng.integers(0, len(w), edits):
                w[at] = "changed"
            out.append((100 + 10 * k + edits, " ".join(w), "en", "s", 1))
    return out


def test_same_as_brute_force(spark):
    docs = awkward(spark, variants())
    want = slow_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted((tuple(r) for r in near_components(docs).collect()), key=str)
    assert got == want
    assert near_components(docs.limit(0)).collect() == []


def test_near_pairs_match_popcounts():
    rng = np.random.default_rng(1)
    groups = np.sort(rng.integers(0, 9, 400))
    values = rng.integers(0, 1 << 16, 400).astype(np.uint64)
    for radius in (0, 3, 4, 7):
        i, j = near_pairs(groups, values, radius)
        want = {
            (a, b)
            for a in range(400)
            for b in range(a + 1, 400)
            if groups[a] == groups[b] and int(values[a] ^ values[b]).bit_count() <= radius
        }
        assert set(zip(i.tolist(), j.tolist())) == want


def test_fingerprint_of_whole_long_text():
    text = "Alpha BETA gamma delta É " * 30000
    assert fingerprint(text.encode(), 4) == slow_fingerprint(text)


def test_large_files_are_compared_by_parts(spark):
    from loomline.llm.simhash import compare, filed

    rng = np.random.default_rng(2)
    low = rng.integers(0, 1 << 20, 300)
    rows = spark.createDataFrame([(int(x),) for x in np.unique(low)], "fp long")
    whole = filed(rows, 4).repartition(1).sortWithinPartitions("group").mapInArrow(compare(4), "a long, b long")
    parts = filed(rows, 4, file_rows=40).repartition(1).sortWithinPartitions("group").mapInArrow(compare(4), "a long, b long")
    from loomline.llm.components import components

    assert sorted(components(whole).collect()) == sorted(components(parts).collect())


def test_long_fingerprints_match_popcounts():
    rng = np.random.default_rng(5)
    groups = np.sort(rng.integers(0, 5, 300))
    base = rng.integers(0, 1 << 63, (5, 2)).astype(np.uint64)
    values = base[groups] ^ np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64)
    for _ in range(9):
        values ^= np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64)
    distance = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(values[a], values[b]))
    for radius in (6, 22, 31, 32):
        i, j = near_pairs(groups, values, radius)
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if groups[a] == groups[b] and distance(a, b) <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_more_blocks_agree_in_larger_tables(spark):
    from loomline.llm.components import components
    from loomline.llm.simhash import agreeing, compare, filed

    assert [agreeing(n, 4) for n in (0, 10**6, 10**9, 10**10, 10**12)] == [2, 2, 2, 3, 4]
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 40)
    rows = {int(b) for b in base} | {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (6, 2))}
    fps = spark.createDataFrame([(x,) for x in rows], "fp long")
    found = [
        sorted(components(filed(fps, 4, agree=k).repartition(2, "group").sortWithinPartitions("group").mapInArrow(compare(4), "a long, b long")).collect())
        for k in (2, 3)
    ]
    assert found[0] == found[1] and len(found[0]) > 100


def test_components_of_paths_stars_and_random_graphs(spark):
    from loomline.llm.components import components

    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)] + [(5, 5), (3000, 2999), (2999, 3000)]
    edges += [(int(a), int(b)) for a, b in 5000 + rng.integers(0, 300, (200, 2))]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(root)):
        before = dict(root)
        for x, y in edges:
            if x != y:
                root[x] = root[y] = min(root[x], root[y])
        if before == root:
            break
    got = components(spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
