"""Containment against brute force over items and documents of all sizes."""

import collections
import random

import pytest

from sequor.llm import decontaminate


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def tables(seed=1):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("aBcdefgh") + str(rng.randrange(4)) for _ in range(n)]
    items = [words(n) for n in (0, 1, 2, 4, 5, 5, 6, 7, 8, 9, 12, 20, 37, 64, 130, 300)]
    docs = [words(rng.choice([0, 1, 3, 5, 6, 9, 30, 200])) for _ in range(60)]
    for w in items:
        for share in (0.6, 0.8, 0.9, 1):
            cut = w[: max(1, round(len(w) * share))]
            docs.append(words(rng.choice([0, 0, 3, 400])) + cut + words(rng.choice([0, 2, 50])))
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    docs += [docs[5], docs[70], (70, "another text"), (None, docs[80][1]), (900, None), (901, " ".join(words(20_000) + items[-2]))]
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    return docs, items + [items[9], (9, "a second text of one id which is long"), (50, None)]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_every_size_of_item_is_found(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    docs, items = tables()
    want = collections.Counter()
    for i, t in set(docs):
        for j, u in set(items):
            q = shingles(u)
            if q and 100 * len(q & shingles(t)) >= 75 * len(q):
                want[i, j, len(q & shingles(t)), len(q)] += 1
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, h long")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, doc_key long")
    got = collections.Counter((r.doc_id, r.item_id, r.n_common, r.n_item) for r in decontaminate.containments(d, b).collect())
    assert got == want and len(want) > 25


def test_bounds_hold_and_short_items_do_not_loosen_them(spark):
    _, items = tables()
    make = lambda rows: decontaminate.signatures(spark.createDataFrame(rows, "item_id long, text string"), 75, 5)
    long_ = [r for r in items if len((r[1] or "").split()) >= 100]
    alone = decontaminate.bounds(make(long_), 75)
    mixed = decontaminate.bounds(make(items), 75)
    assert set(alone) <= set(mixed) and len(mixed) > 6
    assert [p for p, _, _ in mixed] == sorted({p for p, _, _ in mixed}) and all(n <= 2 ** (p + 1) for p, n, _ in mixed if p >= 0)
    assert decontaminate.bounds(make([(0, "two words")]), 75)[0][0] == -1
