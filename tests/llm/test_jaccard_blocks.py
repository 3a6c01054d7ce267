"""Shipping, blocks of large neighbourhoods, and the pipeline's choice of one row for each group."""

import collections
import random

import numpy as np
import pytest
from test_text_operators import make, plain_components

import corpus_pipeline
from sequor.llm import jaccard_join


def shipped(buckets, sets=400):
    rng = random.Random(3)
    import pyarrow as pa

    texts = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(300)) for _ in range(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    return [x for out in jaccard_join._ship(5, buckets, 10**6)(iter([batch])) for x in out.column(1).to_pylist()]


def test_an_owner_is_shipped_only_to_its_buckets():
    few, many, most = (sum(map(len, shipped(b))) for b in (8, 512, 4096))
    # an owner of a slice costs 8 bytes, and no slice has more owners than hashes
    assert many <= 2 * few and most <= 2.6 * few
    assert max(len(jaccard_join.unpack(b)[2]) for b in shipped(4096)) <= 60


def test_pack_is_reversible():
    hashes = np.array([9, 5, 7, 1 << 40], np.uint64)
    owners = np.array([2, jaccard_join._SHARED, 0, 2], np.uint32)
    h, o, t = jaccard_join.unpack(jaccard_join.pack(hashes, owners, np.array([11, 22, 33], np.int64)))
    assert h.tolist() == [5, 7, 9, 1 << 40] and [None if x == jaccard_join._SHARED else int(t[x]) for x in o] == [None, 11, 33, 33]


@pytest.mark.parametrize("classes", [2, 5])
def test_large_neighbourhoods_lose_no_link(spark, monkeypatch, classes):
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(jaccard_join, "HUBS", 2)
    rng = random.Random(classes)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(40):
        w = list(base) if i % 2 else base[:30] + [f"c{k}" for k in range(30)]
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(make(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in plain_components(texts).items()}


def test_pipeline_keeps_one_row_of_each_group(spark):
    rng = random.Random(4)
    words = lambda: " ".join(f"v{rng.randrange(900)}" for _ in range(80))
    a, b, c, d = (words() for _ in range(4))
    near = lambda t: t + " tail"
    rows = [(1, a), (2, near(a)), (2, b), (3, near(b)), (7, c), (7, near(c)), (7, c), (None, d), (None, near(d)), (8, None), (8, ""), (8, None), (None, near(near(a))), (9, words())]
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, make(spark, rows), "").collect())
    lone = [(1, a), (2, b), (9, rows[-1][1]), (8, None), (8, ""), (8, None)]
    assert all(got[x] == n for x, n in collections.Counter(lone).items())
    assert sum(got[x] for x in {(7, c), (7, near(c))}) == 1 and sum(got[x] for x in {(None, d), (None, near(d))}) == 1
    assert sum(got.values()) == len(lone) + 2
    assert corpus_pipeline.near_duplicates(spark, make(spark, rows).limit(0), "").count() == 0
