import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm.packing import encoder, first_fit, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
plain = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's1 .\n\t 　é\x1c<|endoftext|>"), max_size=30), min_size=1, max_size=5))
def test_chunks_encode_like_the_whole_text(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(PATH).batch(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(deadline=None)
@given(st.lists(st.integers(1, 10), max_size=40))
def test_first_fit(lengths):
    bins = []
    want = []
    for n in lengths:
        b = next((i for i, used in enumerate(bins) if used + n <= 10), len(bins))
        if b == len(bins):
            bins.append(0)
        want.append((b, bins[b]))
        bins[b] += n
    assert first_fit(lengths, 10) == want


def check(docs, rows, sequence=1024):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(ids_of(r["text"]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = texts[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for k, copies in texts.items():
        covered = sorted(i for s, n in pieces[k] for i in range(s, s + n))
        assert covered == sorted(list(range(len(copies[0]))) * len(copies))
    for spans in sequences.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= sequence
    return sequences


def test_pieces_and_sequences(spark):
    docs = awkward(spark)
    check(docs, pack(docs, tokenizer_path=PATH).collect())
    assert pack(docs.limit(0), tokenizer_path=PATH).collect() == []


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sequences = check(docs, pack(docs, tokenizer_path=PATH).collect())
    used = sum(n for spans in sequences.values() for _, n in spans)
    assert used / (1024 * len(sequences)) > 0.99


def test_null_ids_and_repeated_rows_are_dealt_over_groups(spark):
    big = (1 << 60) + 1
    rows = [(None, "same text")] * 4000 + [(big, "same text")] * 4000 + [(big + 2, "w " * 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(docs, tokenizer_path=PATH, group_rows=1000).collect()
    check(docs, got)
    assert len({r["sequence_id"] >> 32 for r in got if r["length"] < 1024}) >= 8
    assert {r["doc_id"] for r in got} == {None, big, big + 2}
