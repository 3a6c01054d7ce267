"""Operators on documents against plain versions, with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sequor.llm import decontaminate, jaccard_join, line_dedup, quality, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def make(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), -1, "clash") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    out = [" ".join(w) for w in base]
    for w in base[:20]:
        near = list(w)
        near[rng.randrange(len(near))] = "Changed"
        out.append("  ".join(near))
    out += out[:5] + [base_ + " " + " ".join(base[0]) for base_ in out[10:14]]
    out += [None, "", " \t\n", "one", "ONE", "word " * 3000]
    return list(enumerate(out))


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(texts):
    sets = dict((i, shingles(t)) for i, t in texts)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids[:a]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_SHINGLES, 200])
def test_jaccard_components(spark, texts, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make(spark, texts), block=block).collect()}
    assert got == plain_components(texts)


def test_jaccard_edges(spark):
    docs = make(spark, [(1, "a b c"), (1, "a b c"), (2, "A b  c"), (None, "a b c"), (3, None), (4, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 0, 3), (4, 0, 4)], key=str)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_divide_skip_spans_every_component():
    import numpy as np

    rng = random.Random(1)
    sets = []
    for _ in range(12):
        base = rng.sample(range(10_000), 80)
        sets += [np.array(sorted({*base[: 80 - j], *rng.sample(range(10_000, 20_000), j)})) for j in range(0, 24, 4)]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in jaccard_join.divide_skip(sets, 75):
        up[root(i)] = root(j)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert root(i) == root(j)


def plain_repeats(texts, k):
    words = {i: WORD.findall(t or "") for i, t in texts}
    seen, out = set(), {}
    for i in sorted(words):
        w, gone = words[i], [False] * len(words[i])
        for s in range(len(w) - k + 1):
            window = tuple(w[s : s + k])
            if window in seen:
                gone[s : s + k] = [True] * k
            seen.add(window)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500, "hot": 2}])
def test_substring_dedup(spark, texts, options):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(make(spark, texts), k=20, **options).collect()}
    assert got == plain_repeats(texts, 20)


def test_substring_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    docs = make(spark, [(1, long), (1, long), (None, long), (0, None)])
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 25), (0, 0)], key=str)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def line_key(x):
    return lower(x.strip(" \t\n\x0b\x0c\r"))


def plain_lines(texts, least_docs):
    counts = collections.Counter(k for _, t in texts for k in {line_key(x) for x in (t or "").split("\n")})
    out = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if not line_key(x) or counts[line_key(x)] < least_docs]
        out[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def lined():
    return [(i, "\n".join(["Common line ", f"own {i}", "pair" if i < 2 else f"x{i}", "", "common LINE"])) for i in range(12)] + [(12, None), (13, ""), (14, "  \n")]


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, -1])
def test_line_dedup(spark, limit):
    docs = make(spark, lined())
    index = line_dedup.LineIndex.build(docs, threshold=3)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in index.clean(docs, broadcast_bytes=limit).collect()}
    assert got == plain_lines(lined(), 3)
    assert line_dedup.LineIndex.build(docs.limit(0)).clean(docs.limit(0)).count() == 0


def test_line_dedup_is_reversible(spark):
    docs = make(spark, lined())
    half, rest = docs.where("doc_id < 6"), docs.where("doc_id >= 6")
    first = line_dedup.LineIndex.build(half, threshold=8)
    both = first.insert(rest)
    get = lambda ix, d: {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in ix.clean(d).collect()}
    assert get(both, docs) == plain_lines(lined(), 8)
    undone = both.delete(rest)
    assert get(undone, half) == plain_lines(lined()[:6], 8)
    assert sorted(map(tuple, undone.counts.collect())) == sorted(map(tuple, first.counts.collect()))


def test_cuckoo_filter_deletes():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    f = line_dedup.CuckooFilter.build(keys)
    assert f.contains(keys).all()
    for k in keys[:1500]:
        assert f.delete(k)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(spark, texts):
    more = [(1000, "a|b <c>\na|b <c>\n \nx"), (1001, " ".join(str(i % 9) for i in range(60)))]
    docs = quality.annotate(make(spark, texts + more), out="n_words")
    got = {r.doc_id: r.n_words for r in docs.collect()}
    for i, t in texts + more:
        q = got[i]
        assert (q["n_words"], q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == plain_base(t)
    assert quality.annotate(make(spark, texts).limit(0)).count() == 0


def test_quality_verdicts(spark):
    good = "\n".join(f"This is sentence number {i} of a clean text, with words {i * 7} and more." for i in range(6))
    cases = {
        1: (good, True),
        2: (" | ".join(f"item{i}" for i in range(60)), False),
        3: (" ".join(f"word{i}###" for i in range(60)) + ".", False),
        4: (" ".join(f"W{i}!!" for i in range(60)), False),
        5: (" ".join(w for i in range(30) for w in [f"w{i}"] * 5) + ".", False),
        6: (good + "\nAccept all cookies", True),
    }
    got = {r.doc_id: r.quality for r in quality.annotate(make(spark, [(i, t) for i, (t, _) in cases.items()])).collect()}
    assert {i: got[i].kept for i in cases} == {i: k for i, (_, k) in cases.items()}
    assert got[6].clean_text == good


def test_decontamination(spark):
    rng = random.Random(2)
    words = lambda n: [f"t{rng.randrange(5000)}" for _ in range(n)]
    items = {0: words(20), 1: words(40), 2: words(3), 3: words(30), 4: [], 5: words(12)}
    texts = [(10, " ".join(words(500) + items[0] + words(500))), (11, " ".join(items[1][:35]).upper()), (12, " ".join(items[2])), (13, " ".join(items[2] + ["x"]))]
    texts += [(14, " ".join(items[3][:12] + words(5))), (15, None), (15, " ".join(items[5])), (15, "other"), (16, " ".join(words(30))), (None, " ".join(items[5]))]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(6, None, "x")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.n_common, r.n_item) for r in decontaminate.containments(make(spark, texts), bench).collect()), key=str)
    want = []
    for i, t in texts:
        for j, w in items.items():
            q = shingles(" ".join(w))
            common = len(q & shingles(t))
            if q and 100 * common >= 75 * len(q):
                want.append((i, j, common, len(q)))
    assert got == sorted(want, key=str) and len(want) == 5
    assert decontaminate.containments(make(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.containments(make(spark, texts), bench.limit(0)).count() == 0
    plan = decontaminate.containments(make(spark, texts), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_native_plans_have_no_python(spark):
    plan = quality.annotate(make(spark, [(1, "a")])).select(F.col("quality.kept"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)
