"""Word hashes: words that an algebraic hash confuses, and windows whose hashes are made to collide."""

import random

import numpy as np
import pyarrow as pa

from sequor.llm import hashing, jaccard_join, substring_dedup


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def hashes(texts):
    return [w.of(i).tolist() for w in hashing.words(pa.array(texts), lower=False) for i in range(len(w))]


def test_words_that_polynomials_confuse():
    a, b = thue_morse(1024, 0), thue_morse(1024, 1)
    got = hashes([a, b, f"{a} {b}", "", None])
    assert got[0] != got[1] and got[2] == [*got[0], *got[1]] and got[3] == got[4] == []


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + ["\0", "\0\0", "a\0", "a"]
    one = dict(zip(words, (h[0] for h in hashes(words))))
    rng.shuffle(words)
    assert hashes(["  ".join(words)])[0] == [one[w] for w in words]
    assert len(set(one.values())) == len(one)


def test_confusable_words_neither_go_nor_link(spark):
    a, b = thue_morse(1024, 0), thue_morse(1024, 1)
    rng = random.Random(5)
    flips = [rng.random() < 0.5 for _ in range(20)]
    # twenty different words each, which an algebraic hash cannot tell apart
    one = " ".join((a if f else b) + str(i) for i, f in enumerate(flips))
    two = " ".join((b if f else a) + str(i) for i, f in enumerate(flips))
    docs = spark.createDataFrame([(1, one), (2, two), (3, a), (4, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_windows_of_one_hash_are_told_apart_by_their_words():
    rng = np.random.default_rng(4)
    words = [rng.choice([b"a", b"bb", b"ab"]) for _ in range(400)]
    data, at = b"", []
    for w in words:
        at.append((len(data), len(data) + len(w)))
        data += w + bytes(rng.choice([b" ", b"\n", b"  "]))
    begin, end = np.array([at[p][0] for p in range(390)]), np.array([at[p + 4][1] for p in range(390)])
    windows = [tuple(words[p : p + 5]) for p in range(390)]
    for h in (np.zeros(390, np.uint64), np.sort(rng.integers(0, 4, 390).astype(np.uint64))):
        got = substring_dedup._told_apart(h, data, begin, end)
        for x in range(390):
            for y in range(x):
                assert (got[x] == got[y]) == (h[x] == h[y] and windows[x] == windows[y])
    assert len(substring_dedup._told_apart(np.zeros(0, np.uint64), b"", np.zeros(0, int), np.zeros(0, int))) == 0


def test_the_greatest_id_is_no_null(spark):
    long = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(2**63 - 1, long), (None, long), (None, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(2**63 - 1, 0), (None, 25), (None, 0)], key=str)
