"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sequor.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, weight string"


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    return len(w), w + [a + b" " + b for a, b in zip(w, w[1:])]


def plain(docs, target, percent=25, buckets=10_000, seed=7, least=20):
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                held[zlib.crc32(f) % buckets] += 1
    top, all_ = sum(t) + buckets, sum(s) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_ / ((s[b] + 1) * top))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[zlib.crc32(y) % buckets] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able):
        r.append(k + 1 if k < len(able) * percent // 100 else None)
    return [(*r, None) if len(r) == 5 else tuple(r) for r in rows]


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcXYZé9ß語") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += [None, "", " \t\n", "a,b;c-d_e", "ONE one One", "x " * 5000, "\x00nul\x00\x7f"] + texts[:40]
    return list(enumerate(texts)) + [(None, texts[3])], texts[5:15] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 400, "part_bytes": 300}])
def test_resample_equals_the_plain_version(spark, options):
    docs, target = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], SCHEMA)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = sorted(map(tuple, resampling.resample(df, goal, **options).collect()), key=str)
    assert got == sorted(plain(docs, target), key=str)


def test_features_of_a_chunk():
    texts = [(t or "").encode() for _, t in corpus()[0]]
    words, bits, feature, place, n_words = resampling._features(texts)
    for i, t in enumerate(texts):
        own = np.sort(feature[place == i])
        n, want = features(t.decode())
        assert n_words[i] == n and sorted(resampling._strings(words, bits, own).to_pylist()) == sorted(want)


def test_rows_that_repeat_tie_and_each_keep_a_rank(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text)] * 8 + [(None, text)] * 4, "doc_id long, text string")
    out = resampling.resample(df, df.select("text"), percent=50).collect()
    ranks = sorted(r["rank"] for r in out if r["rank"])
    assert len(out) == 12 and ranks == [1, 2, 3, 4, 5, 6]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(df, one).count() == 0
    assert [tuple(r) for r in resampling.resample(one, df, percent=100).collect()] == plain([(1, "a b " * 20)], [], 100)
